"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of two blocks of BLOCK words, one block apart. Their
TF-IDF vectors over the benchmark's vocabulary are projected onto the leading singular
directions, which a randomised SVD finds in sums over the executors. Each passage's
cosine with every benchmark item is taken (the passage by its whole length, the item by
its projection); those from COSINE on are candidates. Up to PART_PIECES items share RANK directions;
a larger benchmark has several sets of directions, each with its own items' vocabulary, so
its size does not blur an item. Items of more than LONG_ITEM words are sought by
their passages. A candidate counts if the longest common subsequence of the item and the words around it,
as many as the item's length asks for, covers LCS_SHARE of the item, and the item's last third (its answer) is covered
by ANSWER_SHARE as well. So paraphrases that keep most words in order are found, and
texts on the same subject are not.

Term counts cover all passages of all documents, the directions are fitted on all of
them and on all items, and every passage is searched. Null texts are empty and match nothing; empty items are no queries; an
empty benchmark leaves all documents clean. Rows are judged one by one, so repeated rows,
null ids and other columns stay as they are. An item that several passages match is
reported once a row, with its best passage (the first, at a tie).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import cut, drop, whole_text
from cinegraph.llm.word_index import index_words, portions, tidy

BLOCK = 24
RANK = 112
COSINE = 0.36
LCS_SHARE = 0.7
ANSWER_SHARE = 0.6
#: The items' share in the fit against the passages', so that the directions serve the queries.
ITEM_WEIGHT = 10.0
#: The benchmark is held by every worker; a larger one is searched in parts of this size.
MAX_ITEMS = 20_000
#: Pieces of items that share RANK directions; with many more, an item's projection keeps too little of its passage.
PART_PIECES = 200
#: An item of more words is sought by its passages, for one passage is too small a part of the whole.
LONG_ITEM = 4 * BLOCK
POWER_STEPS = 2
TERM_BLOCK = 2048
#: Parts that a job fits at once, tasks of such a job for each core, and the lanes in which their sums are added first.
FITTED, FIT_TASKS, LANES = 8, 4, 16
#: Blocks in a row of the written passages: how many of a block's words are known, and marks.
ROW_BLOCKS, COUNT, JOINED, GHOST = 512, 31, 32, 64
#: Blocks whose words make a matrix of counts at once.
FIT_BLOCKS = 128
STRIP = ".,;:!?\"'()[]{}"
#: Blocks whose projections are held at once.
STRIP_BLOCKS = 384


def normalized(words: pa.Array) -> pa.Array:
    """Words in lower case without punctuation at their ends; a word of punctuation stays."""
    lower = pc.utf8_lower(words)
    bare = pc.utf8_trim(lower, characters=STRIP)
    return pc.if_else(pc.equal(bare, ""), lower, bare)


def terms(text: str | None) -> list[str]:
    """Normalized words of a text in order."""
    split = index_words(pa.array([text], pa.string()))
    words = normalized(split.dictionary).to_pylist()
    return [words[k] for k in split.index]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table held as bits of one integer."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def margin_of(n: int) -> int:
    """Words on each side of a passage in which an item of n words is looked for.

    A passage may lie on any part of an item, also one whose words stand apart as far as LCS_SHARE lets the kept ones.
    """
    return max(BLOCK, math.ceil(n / LCS_SHARE))


def pieces_of(ws: list[str]) -> list[list[str]]:
    """An item as the queries that find it: itself, or passages side by side, the last at its end, if it is long."""
    if len(ws) <= LONG_ITEM:
        return [ws]
    return [ws[k : k + 2 * BLOCK] for k in (*range(0, len(ws) - 2 * BLOCK, 2 * BLOCK), len(ws) - 2 * BLOCK)]


@dataclass
class Part:
    """Up to PART_PIECES pieces of items, with a vocabulary and directions of their own."""

    local: np.ndarray  # the index's code of a term to the part's; -1 if no piece has it, as for code -1
    weight: np.ndarray  # idf squared, by term, and a 0
    directions: np.ndarray  # terms x rank, times idf
    owners: np.ndarray  # the item of each piece
    vectors: np.ndarray  # pieces x rank, of length 1

    def candidates(self, codes: np.ndarray, starts: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, piece, cosine) from COSINE on. starts: of the blocks in codes; joined: whether the next block is the same text's.

        Blocks are taken STRIP_BLOCKS at a time, each with its next, so that what is held does not grow with the texts.
        """
        codes = self.local[codes]
        known = codes >= 0
        before = np.concatenate([[0], np.cumsum(known)])
        first = before[np.append(starts, len(codes))]
        codes = codes[known]
        for at in range(0, len(starts), STRIP_BLOCKS):
            end = min(at + STRIP_BLOCKS, len(starts))
            last = min(end + 1, len(starts))
            lo, hi = first[at], first[last]
            c = np.append(codes[lo:hi], len(self.directions) - 1)  # its last row is 0
            cuts, empty = first[at:last] - lo, first[at:last] == first[at + 1 : last + 1]
            sums, norms = np.add.reduceat(self.directions[c], cuts, axis=0), np.add.reduceat(self.weight[c], cuts)
            sums[empty], norms[empty] = 0, 0  # reduceat gives an empty block its next row
            pair = np.flatnonzero(joined[at : last - 1])
            passages, lengths = sums[: end - at].copy(), norms[: end - at].copy()
            pair = pair[pair < end - at]
            passages[pair] += sums[pair + 1]
            lengths[pair] += norms[pair + 1]
            cosine = passages @ self.vectors.T
            cosine /= np.sqrt(np.maximum(lengths, 1e-9))[:, None]
            for p, piece in np.argwhere(cosine >= COSINE).tolist():
                yield at + p, piece, float(cosine[p, piece])


def blocks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of texts whose words begin at offsets: start in the words, text, and number in the text."""
    count = -(-np.diff(offsets) // BLOCK)
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[owner] + number * BLOCK, owner, number


@dataclass
class Index:
    """What a worker needs to search: vocabulary, items, and the parts of their pieces."""

    vocabulary: list[str]
    item_ids: list
    item_codes: list[list[int]]
    parts: list[Part]

    def __post_init__(self):
        self.item_sets = [set(ws) for ws in self.item_codes]
        self.terms = pa.array(self.vocabulary, pa.large_string())

    def hits(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text: (item id, cosine, share of the item, start, end of the passage in words)."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        if not self.item_ids or not len(texts):
            return out
        codes, offsets = coded(texts, self.terms)
        starts, owner, number = blocks_of(offsets)
        if not len(starts):
            return out
        joined = owner[1:] == owner[:-1]
        best: dict[tuple[int, int], tuple] = {}
        for part in self.parts:
            last, windows, shares = -1, {}, {}
            for p, piece, cosine in part.candidates(codes, starts, joined):
                d, q = int(owner[p]), int(part.owners[piece])
                words = codes[offsets[d] : offsets[d + 1]]
                if p != last:
                    last, at, windows, shares = p, int(number[p]) * BLOCK, {}, {}
                if q not in shares:
                    old = best.get((d, q))
                    shares[q] = 0.0 if old and old[1] >= 1 and old[2] <= at else self.share(q, words, at, windows)
                if not shares[q]:
                    continue
                found = (cosine, shares[q], at, min(len(words), at + 2 * BLOCK))
                if (d, q) not in best or (found[1], -at, found[0]) > (best[d, q][1], -best[d, q][2], best[d, q][0]):
                    best[d, q] = found
        for (d, q), found in sorted(best.items()):
            out[d].append((self.item_ids[q], *found))
        return out

    def share(self, q: int, words: np.ndarray, at: int, windows: dict) -> float:
        """What the words around the passage at `at` hold of item q. windows: those of the passage by margin."""
        item = self.item_codes[q]
        margin = margin_of(len(item))
        if margin not in windows:
            window = words[max(0, at - margin) : at + 2 * BLOCK + margin]
            window = window[window >= 0].tolist()  # words that no item has cannot be in a common subsequence
            windows[margin] = window, set(window)
        window, known = windows[margin]
        # each word of the item that is not there costs the subsequence one word at least
        return 0.0 if len(self.item_sets[q] - known) > (1 - LCS_SHARE) * len(item) else self.covered(item, window)

    @staticmethod
    def covered(item: list, window: list) -> float:
        """Share of the item that the window holds in order; 0 if it or the answer is too small."""
        share = lcs_length(item, window) / len(item)
        answer = item[-max(1, len(item) // 3) :]
        return share if share >= LCS_SHARE and lcs_length(answer, window) >= ANSWER_SHARE * len(answer) else 0.0


def coded(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as places in `known` (-1 for others), and where each text starts."""
    split = index_words(texts)
    places = pc.fill_null(pc.index_in(normalized(split.dictionary), value_set=known), -1).to_numpy(zero_copy_only=False)
    return places[split.index], split.offsets


def _count_terms(docs: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """One pass: passage counts of the terms (kind 0; term -1 is the number of passages), and all passages (kind 1), as packed() has them."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.large_string())
        v = len(known)
        counts = np.zeros(v + 1, np.int64)
        for batch in batches:
            for part in portions(batch, 0):
                codes, offsets = coded(part.column(0), known)
                starts, owner, number = blocks_of(offsets)
                counts[-1] += len(starts)
                block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
                known_word = codes >= 0
                key = np.int32 if len(starts) * v < 2**31 else np.int64
                here = np.unique(block[known_word].astype(key) * key(v) + codes[known_word].astype(key))  # terms of the blocks, sorted
                at, term = np.divmod(here, key(v))
                # a passage holds its block's terms and the next one's: those of a block that has one before it count for that too
                later = number[at] > 0
                before = here[later] - key(v)
                place = np.minimum(np.searchsorted(here, before), max(len(here) - 1, 0))
                counts[:-1] += np.bincount(term, minlength=v) + np.bincount(term[later][here[place] != before], minlength=v)
                rows = list(packed(codes[known_word].astype(code_kind(v)), np.bincount(block[known_word], minlength=len(starts)), owner))
                if rows:
                    yield _rows(1, [0] * len(rows), [0] * len(rows), *zip(*rows, strict=True))
        seen = np.flatnonzero(counts)
        yield _rows(0, np.where(seen == v, -1, seen), counts[seen], [b""] * len(seen), [b""] * len(seen))

    return docs.select(whole_text(text).alias("text")).mapInArrow(tidy(work), "kind int, term long, n long, codes binary, blocks binary")


def _rows(kind: int, term, n, codes, blocks) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(term), kind, np.int32)), pa.array(np.asarray(term, np.int64)), pa.array(np.asarray(n, np.int64)), pa.array(codes, pa.binary()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "term", "n", "codes", "blocks"])


def code_kind(v: int) -> type:
    return np.uint16 if v < 1 << 16 else np.uint32


def packed(codes: np.ndarray, count: np.ndarray, owner: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Known words and blocks in rows of ROW_BLOCKS. A block is a byte: its known words, and whether the next is the same text's.

    A row whose last block is joined ends with the next one as a ghost, which is no passage here.
    """
    joined = np.append(owner[1:] == owner[:-1], False)[: len(owner)]
    marks, first = (count + JOINED * joined).astype(np.uint8), np.concatenate([[0], np.cumsum(count)])
    for at in range(0, len(owner), ROW_BLOCKS):
        end = min(at + ROW_BLOCKS, len(owner))
        ghost = bool(joined[end - 1])
        yield codes[first[at] : first[end + ghost]].tobytes(), marks[at:end].tobytes() + bytes([GHOST + int(count[end])] if ghost else [])


def _column(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    """All bytes of a binary column, side by side."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)


def gram_times(codes: np.ndarray, blocks: np.ndarray, weight: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A q) to total; A has a row of length 1 for each passage. weight, q and total have a last row of 0 for terms of others.

    q is by weight already, and total is to be multiplied by it: both are sums over a block's words then, and a passage is two of them.
    """
    count = (blocks & COUNT).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    square, place = weight * weight, np.zeros(len(weight), np.int64)
    for at in range(0, len(blocks), FIT_BLOCKS):
        end = min(at + FIT_BLOCKS, len(blocks))
        last = min(end + 1, len(blocks))  # the next block, for a passage's second half
        c = codes[first[at] : first[last]]
        here = np.flatnonzero(np.bincount(c, minlength=len(weight)))
        place[here] = np.arange(len(here))
        block = np.repeat(np.arange(last - at), count[at:last])
        times = np.bincount(block * len(here) + place[c], minlength=(last - at) * len(here)).reshape(last - at, len(here)).astype(q.dtype)
        sums, norms = times @ q[here], times @ square[here]
        pair = np.flatnonzero(blocks[at:end] & JOINED)
        own, length = sums[: end - at].copy(), norms[: end - at].copy()
        own[pair] += sums[pair + 1]
        length[pair] += norms[pair + 1]
        own /= np.maximum(length, 1e-9)[:, None]
        own[(blocks[at:end] & GHOST) > 0] = 0
        back = np.zeros_like(sums)  # what each block's words get: of its own passage and of the one before
        back[: end - at] = own
        back[pair + 1] += own[pair]
        total[here] += times.T @ back


def _gram_times(passages: DataFrame, v: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A'(A q) over all passages for each part (local, idf, q), summed in blocks of terms; the driver gets one block of each."""
    held = passages.sparkSession.sparkContext.broadcast([(local, np.append(idf, 0).astype(np.float32), np.vstack([q * idf[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32)) for local, idf, q in parts])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(q.shape) for _, _, q in held.value]
        for batch in batches:
            codes, blocks = _column(batch, "codes", code_kind(v)), _column(batch, "blocks", np.uint8)
            for (local, weight, q), total in zip(held.value, totals, strict=True):
                own = local[codes]
                gram_times(np.where(own < 0, len(q) - 1, own).astype(code_kind(len(q))), blocks, weight, q, total)
        lane = TaskContext.get().partitionId() % LANES
        for k, ((_, weight, _), total) in enumerate(zip(held.value, totals, strict=True)):
            total = (total * weight[:, None])[:-1]
            for at in range(0, len(total), TERM_BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (k, at, lane)] + [pa.array([total[at : at + TERM_BLOCK].tobytes()], pa.binary())], names=["part", "block", "lane", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("part", "block", "lane")}, "sums": pa.array([total.tobytes()], pa.binary())})

    shape = "part int, block int, lane int, sums binary"
    found = passages.mapInArrow(tidy(work), shape).groupBy("part", "block", "lane").applyInArrow(add, shape).groupBy("part", "block").applyInArrow(add, shape).collect()
    out = [np.zeros(q.shape) for _, _, q in parts]
    for r in found:
        sums = np.frombuffer(r["sums"], np.float64).reshape(-1, out[r["part"]].shape[1])
        out[r["part"]][r["block"] : r["block"] + len(sums)] = sums
    return out


def _fit_parts(passages: DataFrame, n_passages: int, idf: np.ndarray, vocabulary: dict[str, int], parts: list[list[tuple[int, list[str]]]], rank: int) -> list[Part]:
    """parts: each the (item, terms) of its pieces. A few jobs over the passages for all of them."""
    fits = []
    for pieces in parts:
        mine = np.unique([vocabulary[w] for _, ws in pieces for w in ws])
        local = np.full(len(vocabulary) + 1, -1, np.int64)
        local[mine] = np.arange(len(mine))
        own = np.zeros((len(pieces), len(mine)))
        for row, (_, ws) in zip(own, pieces, strict=True):
            for w, n in Counter(ws).items():
                row[local[vocabulary[w]]] = n * idf[vocabulary[w]]
        own /= np.linalg.norm(own, axis=1)[:, None]
        fits.append((local, idf[mine], own, ITEM_WEIGHT * max(1.0, n_passages / len(pieces))))
    qs = [np.linalg.qr(np.random.default_rng(7).standard_normal((len(weight), min(rank, len(weight)))))[0] for _, weight, _, _ in fits]

    def step() -> list[np.ndarray]:
        sums = _gram_times(passages, len(vocabulary), [(local, weight, q) for (local, weight, _, _), q in zip(fits, qs, strict=True)])
        return [g + share * (own.T @ (own @ q)) for g, (_, _, own, share), q in zip(sums, fits, qs, strict=True)]

    for _ in range(POWER_STEPS):
        qs = [np.linalg.qr(g)[0] for g in step()]
    out = []
    for pieces, (local, weight, own, _), q in zip(parts, fits, qs, strict=True):
        directions = q.astype(np.float32)  # all are kept, so turning them towards the singular vectors would change no cosine
        vectors = (own @ directions).astype(np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        weighted = np.vstack([directions * weight.astype(np.float32)[:, None], np.zeros((1, q.shape[1]), np.float32)])
        out.append(Part(local, np.append(weight * weight, 0).astype(np.float32), weighted, np.array([i for i, _ in pieces]), vectors))
    return out


def build_index(docs: DataFrame, items: list[tuple], text: str = "text", rank: int = RANK) -> Index:
    """items: (id, text). One job over all documents, and a few over their coded passages for every FITTED parts."""
    listed = [(i, w) for i, t in items if (w := terms(t))]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    if not vocabulary:
        return Index([], [], [], [])
    counted = cut(_count_terms(docs, text, list(vocabulary)))
    df = np.zeros(len(vocabulary) + 1)
    for r in counted.where("kind = 0").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the benchmark
        df[r["term"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    passages = counted.where("kind = 1").select("codes", "blocks")
    passages = passages.coalesce(max(1, min(passages.rdd.getNumPartitions(), FIT_TASKS * docs.sparkSession.sparkContext.defaultParallelism)))
    pieces = [(k, piece) for k, (_, ws) in enumerate(listed) for piece in pieces_of(ws)]
    n_parts = -(-len(pieces) // PART_PIECES)
    bounds = [len(pieces) * k // n_parts for k in range(n_parts + 1)]
    split = [pieces[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    parts = [part for k in range(0, n_parts, FITTED) for part in _fit_parts(passages, int(df[-1]), idf, vocabulary, split[k : k + FITTED], rank)]
    drop(counted)
    return Index(list(vocabulary), [i for i, _ in listed], [[vocabulary[w] for w in ws] for _, ws in listed], parts)


def _parts(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple]]:
    """The items in parts of MAX_ITEMS, in the order of their ids."""
    held: list[tuple] = []
    for r in benchmark.select(item_col, text).orderBy(item_col, text).toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == MAX_ITEMS:
            yield held
            held = []
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id") -> DataFrame:
    """id_col, item_id, cosine, share, start, end: one row for each document and item that it holds."""
    spark = docs.sparkSession
    schema = f"`{id_col}` long, item_id long, cosine double, share double, start long, end long"
    found = spark.createDataFrame([], schema)
    for items in _parts(benchmark, item_col, text):
        held = spark.sparkContext.broadcast(build_index(docs, items, text))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch, 1):
                    hits = held.value.hits(part.column(1))
                    rows = [(i, *h) for i, hs in zip(part.column(0).to_pylist(), hits, strict=True) for h in hs]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "item_id", "cosine", "share", "start", "end"])

        found = found.unionByName(docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text).alias("text")).mapInArrow(tidy(work), schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that hold no item, with their own columns; no join and no shuffle."""
    left, place = docs, docs.columns.index(text)
    for items in _parts(benchmark, item_col, text):
        held = docs.sparkSession.sparkContext.broadcast(build_index(docs, items, text))  # of all rows, not of those that earlier items left

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in portions(batch, place):
                    hits = held.value.hits(part.column(place))
                    yield part.filter(pa.array([not h for h in hits], pa.bool_()))

        left = left.mapInArrow(tidy(work), docs.schema)
    return left
