"""Word and window hashes of texts as numpy arrays, shared by the substring and similarity operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hashes a worker keeps at once.
CACHE_WORDS = 400_000
_MIX1, _MIX2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """bytes to 64-bit hash; unknown words are hashed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = WordHashes()


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def hash_words(words: pa.Array) -> np.ndarray:
    """Hash of each word of an Arrow array."""
    found = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; empty if there are fewer."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * _BASE + h[i : i + n])
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words [start, end) for each pair, from sums of powers modulo 2^64."""
    n = len(h)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(h) * powers[:n])])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
