"""Substring deduplication: recurring passages of words, located by sharded Aho-Corasick automata.

A word is removed if a window of `size` words covers it whose word sequence also
starts in a document with a smaller id. Every window counts; none is sampled:

1. A window's key is the least hash of its `gram`-word sequences, so equal
   windows have equal keys wherever they stand. Runs of windows with one key
   are segments; a document has about two for every `size - gram + 2` words. Only (key,
   segment hash, id) is shuffled. Documents of one batch that share a segment
   send it once, for the least id, which keeps hot passages small.
2. Sorted by key, each key's rows pass through in a stream. A segment that a
   smaller id has too is confirmed as a whole. Segments of a key that differ are
   open: they may share some windows and not others.
3. The open segments' windows are compared by 128-bit hashes; those that a smaller id
   holds are confirmed. Documents of one batch that share a window send it once too.
4. Each shard of documents compiles the confirmed passages of its documents, runs of confirmed segments and windows, into one
   automaton over numbered words and streams all its documents through it, to locate every occurrence. A passage of a
   document counts in it and in those with greater ids.

Null ids count as one document after all others; rows that share an id are one
document, and a window does not repeat within it. Null and empty texts have no words. Only id and
text are read, so other columns cannot clash; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import NULL_ID, cut, free_shuffles, small_batches, whole_text
from cinegraph.llm.shingle_hash import gram_hashes, hash_words, mix, sliding_min, span_hashes
from cinegraph.llm.word_index import WordIndex, index_words, portions, tidy

SIZE, GRAM = 13, 5
#: Documents of a shard that has an automaton of its own.
SHARD = 512
FULL, OPEN = 0, 1
#: A word's number is written in digits of 7 bits; the first digit is marked, so that matches begin and end with words.
DIGIT, FIRST = 7, 0x80


def segments(h: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, segment hash, first window, last window + 1 of the segments of texts; windows are numbered as the words that they start at."""
    windows = len(h) - size + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = sliding_min(gram_hashes(h, gram), size - gram + 1)
    whole = owner[:windows] == owner[size - 1 :]  # windows of one text
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:windows] != owner[: windows - 1])])
    first = np.flatnonzero(whole & new)
    ends = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]])) + 1
    return owner[first], least[first], span_hashes(h, first, ends + size - 1), first, ends


def _marks(key: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return key ^ (seg << np.uint64(1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def document_segments(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """state, key, seg, id: distinct segments of the documents; FULL ones are settled already, for a smaller id of their batch has them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                split = index_words(part.column(1))
                text, key, seg, _, _ = segments(hash_words(split.dictionary)[split.index], split.offsets, size, gram)
                owner = part.column(0).to_numpy()[text]
                order = np.lexsort((owner, seg, key))
                key, seg, owner = key[order], seg[order], owner[order]
                same = np.concatenate([[False], (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])])[: len(key)]
                fresh = ~same | (np.concatenate([[0], owner[:-1]])[: len(owner)] != owner)  # a document's own repeats are one
                key, seg, owner, same = key[fresh], seg[fresh], owner[fresh], same[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(same, FULL, OPEN).astype(np.int32)), _signed(key), _signed(seg), pa.array(owner)], names=["state", "key", "seg", "id"])

    return docs.mapInArrow(tidy(work), "state int, key long, seg long, id long")


def settle(rows: DataFrame) -> DataFrame:
    """id, key, seg, state of the segments that matter: FULL is removed, OPEN is to be compared.

    Rows come sorted by (state, key, seg, id); the stream remembers one segment. Open rows that repeat the id of
    the row before them are one row, for chunks and batches each send a shared or null id's segment.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, bool] | None = None  # key, seg, id of the key's first segment, and whether it went out
        last = None  # key, seg of the row before
        last_id = None
        for batch in batches:
            state, key, seg, ids = (batch.column(i).to_numpy() for i in range(4))
            done = state == FULL
            fresh = np.ones(len(key), bool)
            fresh[1:] = done[1:] | done[:-1] | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]) | (ids[1:] != ids[:-1])
            if len(key) and last is not None and not done[0]:
                fresh[0] = (key[0], seg[0], ids[0]) != (*last, last_id)
            if not fresh.any():
                continue
            key, seg, ids, done = key[fresh], seg[fresh], ids[fresh], done[fresh]
            before_key, before_seg = np.empty_like(key), np.empty_like(seg)
            before_key[1:], before_seg[1:] = key[:-1], seg[:-1]
            usable = np.ones(len(key), bool)
            usable[0] = last is not None
            if last is not None:
                before_key[0], before_seg[0] = last
            open_at = np.flatnonzero(~done)
            starts_open = np.zeros(len(key), bool)
            if len(open_at):
                starts_open[open_at[0]] = open_at[0] > 0  # the row before it is a settled one
            like_key = usable & (before_key == key) & ~done & ~starts_open
            again = like_key & (before_seg == seg)
            out = [np.flatnonzero(done), np.flatnonzero(again)]
            # first rows of further segments of a key, and the key's first row once
            more = np.flatnonzero(like_key & ~again)
            heads = np.flatnonzero(~done & ~like_key)
            extra = []
            if len(more):
                owner = np.searchsorted(heads, more, side="right") - 1
                for k in np.unique(owner):
                    if k >= 0:
                        out.append(heads[k : k + 1] * 1)
                    elif held and not held[3]:
                        extra.append(held[:3])
                        held = (*held[:3], True)
                went = bool(len(heads)) and owner[-1] == len(heads) - 1
            else:
                went = False
            if len(heads):
                h = heads[-1]
                held = (int(key[h]), int(seg[h]), int(ids[h]), went)
            if len(key) and not done[-1]:
                last, last_id = (key[-1], seg[-1]), ids[-1]
            opened = np.concatenate([more, *out[2:]]) if len(out) > 2 else more
            pick = np.concatenate([out[0], out[1], opened]).astype(np.int64)
            kind = np.concatenate([np.full(len(out[0]) + len(out[1]), FULL), np.full(len(opened), OPEN)]).astype(np.int32)
            names = ["id", "key", "seg", "state"]
            yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(key[pick]), pa.array(seg[pick]), pa.array(kind)], names=names)
            if extra:
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in extra]), pa.array([x[0] for x in extra]), pa.array([x[1] for x in extra]), pa.array(np.full(len(extra), OPEN, np.int32))], names=names)

    deal = F.when(F.col("state") == FULL, F.xxhash64("id")).otherwise(F.col("key"))  # settled rows need no company
    ordered = rows.repartition(deal).sortWithinPartitions("state", "key", "seg", "id")
    return ordered.mapInArrow(work, "id long, key long, seg long, state int")


def window_hashes(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window."""
    return gram_hashes(h, size), gram_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), size)


def open_windows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """state, p1, p2, id: the distinct windows of the open segments of (id, text, opened), by their hashes; FULL as for segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                split = index_words(part.column(1))
                h = hash_words(split.dictionary)[split.index]
                text, key, seg, first, last = segments(h, split.offsets, size, gram)
                wanted = held_by(part.column(2), text, _marks(key, seg))
                starts = _runs(first[wanted], last[wanted])
                owner = part.column(0).to_numpy()[np.repeat(text[wanted], (last - first)[wanted])]
                p1, p2 = (p[starts] for p in window_hashes(h, size))
                order = np.lexsort((owner, p2, p1))
                p1, p2, owner = p1[order], p2[order], owner[order]
                same = np.concatenate([[False], (p1[1:] == p1[:-1]) & (p2[1:] == p2[:-1])])[: len(p1)]
                fresh = ~same | (np.concatenate([[0], owner[:-1]])[: len(owner)] != owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(same, FULL, OPEN)[fresh].astype(np.int32)), _signed(p1[fresh]), _signed(p2[fresh]), pa.array(owner[fresh])], names=["state", "p1", "p2", "id"])

    return rows.mapInArrow(tidy(work), "state int, p1 long, p2 long, id long")


def confirm(windows: DataFrame) -> DataFrame:
    """id, p1 of the windows that a smaller id holds too. Sorted rows pass in a stream that remembers one window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the window of the row before, and its least id
        for batch in batches:
            state, p1, p2, ids = (c.to_numpy() for c in batch.columns)
            done = int(np.searchsorted(state, OPEN))
            yield pa.RecordBatch.from_arrays([pa.array(ids[:done]), pa.array(p1[:done])], names=["id", "p1"])
            p1, p2, ids = p1[done:], p2[done:], ids[done:]
            if not len(p1):
                continue
            new = np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])])
            least = ids[new]
            if held and held[:2] == (p1[0], p2[0]):
                least[0] = held[2]
            later = ids > least[np.cumsum(new) - 1]
            held = (p1[-1], p2[-1], least[-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(p1[later])], names=["id", "p1"])

    deal = F.when(F.col("state") == FULL, F.xxhash64("id")).otherwise(F.col("p1"))
    return windows.repartition(deal).sortWithinPartitions("state", "p1", "p2", "id").mapInArrow(work, "id long, p1 long")


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    n = ends - starts
    out = np.repeat(starts - (np.cumsum(n) - n), n)
    return out + np.arange(len(out))


def held_by(lists: pa.Array, text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values[k] is in the list of row text[k]; text ascends."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) if len(lists) else np.zeros(0, np.uint64), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(text, np.arange(len(lists) + 1))
    for k in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(bounds) > 0)).tolist():
        a, b = bounds[k], bounds[k + 1]
        out[a:b] = np.isin(values[a:b], flat[offsets[k] : offsets[k + 1]])
    return out


def written(split: WordIndex) -> tuple[str, int]:
    """The texts' words as digits, and the digits of a word."""
    digits = 1
    while len(split.dictionary) > 1 << (DIGIT * digits):
        digits += 1
    out = np.empty((len(split.index), digits), np.uint8)
    for k in range(digits):
        out[:, k] = (split.index >> (DIGIT * (digits - 1 - k))) & ((1 << DIGIT) - 1)
    out[:, 0] |= FIRST
    return out.tobytes().decode("latin-1"), digits


def locate(split: WordIndex, ids: list[int], confirmed: np.ndarray, size: int) -> np.ndarray:
    """Whether each word of a shard is in an occurrence of a confirmed passage.

    confirmed: whether the window that starts at a word is. Passages are the longest runs of words that confirmed windows cover;
    an occurrence counts from the least id on that has the passage confirmed.
    """
    import ahocorasick

    gone = np.zeros(len(split.index), bool)
    starts = np.flatnonzero(confirmed)
    if not len(starts):
        return gone
    text = np.searchsorted(split.offsets, starts, side="right") - 1
    apart = np.concatenate([[True], (starts[1:] > starts[:-1] + size) | (text[1:] != text[:-1])])
    begin, end = starts[apart], starts[np.append(np.flatnonzero(apart)[1:] - 1, len(starts) - 1)] + size
    line, digits = written(split)
    passages: dict[str, int] = {}
    for k, a, b in zip(text[apart].tolist(), (begin * digits).tolist(), (end * digits).tolist(), strict=True):
        passage = line[a:b]
        if passages.get(passage, NULL_ID + 1) > ids[k]:
            passages[passage] = ids[k]
    automaton = ahocorasick.Automaton()
    for passage, least in passages.items():
        automaton.add_word(passage, (len(passage) // digits, least))
    automaton.make_automaton()
    offsets = split.offsets.tolist()
    for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
        for at, (n, least) in automaton.iter(line[a * digits : b * digits]):
            if least <= i:
                last = a + (at + 1) // digits
                gone[last - n : last] = True
    return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one space) for each row."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), whole_text(text).alias("text"))
    mark = F.col("key").bitwiseXOR(F.shiftleft("seg", 1))
    texts = rows.repartition("id")
    empty = F.array().cast("array<bigint>")
    with small_batches(docs.sparkSession):
        found = settle(document_segments(rows, size, gram))
        per_doc = cut(found.groupBy("id").agg(F.collect_set(F.when(F.col("state") == FULL, mark)).alias("full"), F.collect_set(F.when(F.col("state") == OPEN, mark)).alias("opened")))
        free_shuffles(docs.sparkSession)
        windows = open_windows(texts.join(per_doc.where(F.size("opened") > 0).select("id", "opened"), "id").select("id", "text", "opened"), size, gram)
        confirmed = cut(confirm(windows).groupBy("id").agg(F.collect_set("p1").alias("windows")))
        free_shuffles(docs.sparkSession)
    joined = texts.join(per_doc.select("id", "full"), "id", "left").join(confirmed, "id", "left").select("id", "text", F.coalesce("full", empty).alias("full"), F.coalesce("windows", empty).alias("windows"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, SHARD):
                ids = part.column(0).to_pylist()
                split = index_words(part.column(1))
                h = hash_words(split.dictionary)[split.index]
                owner, key, seg, first, last = segments(h, split.offsets, size, gram)
                full = held_by(part.column(2), owner, _marks(key, seg))
                known = np.zeros(len(h) + 1, bool)
                known[_runs(first[full], last[full])] = True
                starts = _runs(first, last)
                known[starts[held_by(part.column(3), np.repeat(owner, last - first), gram_hashes(h, size)[starts] if len(starts) else np.zeros(0, np.uint64))]] = True
                gone = locate(split, ids, known[: len(h)], size)
                words, stays = np.array(split.words, object), ~gone
                n_words = np.diff(split.offsets)
                kept = [" ".join(words[split.text(k)[stays[a:b]]]) for k, (a, b) in enumerate(zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True))]
                removed = np.concatenate([[0], np.cumsum(gone)])[split.offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), pa.array(n_words, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept, pa.string()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept])],
                    names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return joined.mapInArrow(tidy(finish), f"`{id_col}` long, n_words long, n_removed long, kept string, kept_sha256 string")
