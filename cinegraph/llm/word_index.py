"""Words of many texts as numbers: Arrow splits the texts and numbers the distinct words, so that Python sees each once."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The allocator's own way to shrink, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: Rows and bytes of text that are split at once; a longer text is split alone.
ROWS, BYTES = 2048, 8 << 20


@dataclass
class WordIndex:
    """dictionary: the distinct words; index: the number of each word of all texts, in order; offsets: where each text starts in it."""

    dictionary: pa.Array
    index: np.ndarray
    offsets: np.ndarray

    @property
    def words(self) -> list[str]:
        return self.dictionary.to_pylist()

    def text(self, k: int) -> np.ndarray:
        return self.index[self.offsets[k] : self.offsets[k + 1]]


def index_words(texts: pa.Array) -> WordIndex:
    """Words between ASCII white space; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(texts) else pa.array([], pa.large_string())
    coded = flat.dictionary_encode()
    dictionary, index = coded.dictionary, coded.indices.to_numpy()
    offsets = offsets - offsets[0]
    blank = pc.index(dictionary, "").as_py()
    if blank >= 0:  # white space at a text's ends
        real = index != blank
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        index = index[real]
    return WordIndex(dictionary, index, offsets)


def portions(batch: pa.RecordBatch, column: int | str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and bytes of the text column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        used = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, used + size, side="right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Returns freed memory to the system: workers stay between stages, and what they keep is missing to the next one."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(work):
    """The worker function, with give_back at its end."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run
