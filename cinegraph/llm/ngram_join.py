"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of
0.75 or more. The product's rows are the shingles, its blocks the shuffle
partitions of the shingles; each block adds up, for pairs of documents, the shingles
that they share. Pairs whose count cannot reach the bound that their sizes set
are discarded; the rest are compared by their whole sets.

* Exact frequencies: every shingle of every text is sent once, as 32 bits in one of many buckets, and each bucket counts
  its own. A shingle that stands in one text only goes no further.
* Only a prefix of each set is multiplied: with the shingles in one order, rarest first,
  sets of n that reach the threshold share one of their first n - ceil(0.75 n) + 1. Shingles
  that share bucket and 32 bits count as one; that adds candidates at most. The order decides speed only: any order loses no pair.
* Equal sets are one class, a node of the graph of links; one row stands for it in the product.
* A row of the product with up to LONG_ROW classes gives all its pairs. A longer one gives
  the pairs with its least class, its centre; rows of HOT_ROW texts or more find their centre by
  partial sums and are joined to it, so no task holds them. What the centres leave open is decided by a second product, of the members'
  whole sets, one centre's rows together: members of the component that holds most of them are not compared with one another, the rest
  with all. Members are dealt into blocks by size and hash, and a task multiplies two blocks and sends a
  spanning forest of their links, so neither pairs nor links of a large group are written out.

Null and empty texts have no shingles and link with nothing; a text of fewer than five
words is one shingle. Rows that share an id are one document: each of their texts has its links, and all have one component. Rows with
a null id are documents of their own; their component is the least id that they reach, or null. Ties do
not matter, empty tables give empty results, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import NULL_ID, cut, drop, planned_bytes, small_batches, whole_text
from cinegraph.llm.shingle_hash import gram_hashes, hash_words, mix
from cinegraph.llm.word_index import index_words, portions, tidy
from cinegraph.operators.components import connected_components

SHINGLE = 5
PART, WHOLE = 75, 100  # the similarity, as a fraction
LONG_ROW = 24
#: Texts of a shingle from which on its row is not streamed through one task.
HOT_ROW = 4096
#: Shingles that a bucket should hold; a worker counts one bucket at a time. Input bytes (by the planner) for each.
BUCKET_SHINGLES, BYTES_PER_SHINGLE = 4_000_000, 3
#: Members and shingles of a block of the second product; a block's size bounds a task's memory.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Classes whose sizes differ by two bands or more cannot link; the width is above WHOLE / PART.
BAND = 1.35
#: At most so many keys of texts are broadcast to fetch their sets; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
SALTS = 16
_FIELDS = ("bucket int, kind int, portion long, doc int, id long, n long, s1 long, s2 long, d1 long, d2 long, tokens binary, owners binary, often binary")


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    split = index_words(texts)
    h = hash_words(pc.ascii_lower(split.dictionary))[split.index]
    grams, out = gram_hashes(h, k), []
    for a, b in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) + np.uint64(1) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_length(n: np.ndarray | int):
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def scaled(df: np.ndarray) -> np.ndarray:
    """Frequencies in one byte: exact up to 64, eight steps a doubling above, none higher than 255."""
    return np.minimum(255, np.where(df <= 64, df, 64 + 8 * np.log2(np.maximum(df, 64) / 64))).astype(np.uint8)


def _batch(names: str, columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    """A batch of the fields `names` (name type, ...); those that are not given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c].cast(kinds[k]) if c in columns else pa.nulls(rows, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def spread_shingles(rows: DataFrame, buckets: int) -> DataFrame:
    """kind 0: a text with its set's size and digest; kind 1: the shingles of one portion of texts that fall in a bucket, and whose they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in portions(batch, 1):
                sets = shingle_sets(part.column(1))
                size = np.array([len(s) for s in sets], np.int64)
                s1 = np.array([int(np.add.reduce(mix(s)).astype(np.int64)) if len(s) else 0 for s in sets], np.int64)
                s2 = np.array([int(np.add.reduce(mix(s ^ np.uint64(0x5BD1E9955BD1E995))).astype(np.int64)) if len(s) else 0 for s in sets], np.int64)
                portion = xxhash.xxh64_intdigest(np.array([task, count], np.int64).tobytes() + s1.tobytes()) >> 1
                count += 1
                same = lambda x, m: pa.array(np.full(m, x, np.int64))
                m = part.num_rows
                columns = {"bucket": pa.array((np.arange(m) + portion % buckets) % buckets), "kind": same(0, m), "portion": same(portion, m), "doc": pa.array(np.arange(m))}
                columns |= {"id": part.column(0), "n": pa.array(size), "s1": pa.array(s1), "s2": pa.array(s2), "d1": part.column(2), "d2": part.column(3)}
                yield _batch(_FIELDS, columns, m)
                # a set that the portion holds already need not be counted twice
                seen: set[tuple] = set()
                new = [k for k in range(m) if size[k] and not ((size[k], s1[k], s2[k]) in seen or seen.add((size[k], s1[k], s2[k])))]
                if not new:
                    continue
                tokens = np.concatenate([sets[k] for k in new])
                owners = np.repeat(np.array(new, np.uint16), size[new])
                bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                tokens, owners, bucket = tokens[by].astype(np.uint32), owners[by], bucket[by]
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(starts[1:], len(bucket)).tolist()
                pack = lambda x, starts=starts, ends=ends: pa.array([x[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary())
                yield _batch(_FIELDS, {"bucket": pa.array(bucket[starts]), "kind": same(1, len(starts)), "portion": same(portion, len(starts)), "tokens": pack(tokens), "owners": pack(owners)}, len(starts))

    return rows.mapInArrow(tidy(work), _FIELDS)


def count_shingles(spread: DataFrame) -> DataFrame:
    """The texts (kind 0) as they are, and of each portion's shingles those that stand in several texts, with their scaled frequency."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> pa.RecordBatch:
            tokens = [np.frombuffer(t, np.uint32) for _, t, _ in held]
            _, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            count = count[place]
            ends, columns = np.cumsum([len(t) for t in tokens]), {"portion": [], "tokens": [], "owners": [], "often": []}
            for (portion, _, owners), own, end in zip(held, tokens, ends.tolist(), strict=True):
                df = count[end - len(own) : end]
                shared = df > 1
                if shared.any():
                    columns["portion"].append(portion)
                    columns["tokens"].append(own[shared].tobytes())
                    columns["owners"].append(np.frombuffer(owners, np.uint16)[shared].tobytes())
                    columns["often"].append(scaled(df[shared]).tobytes())
            m = len(columns["portion"])
            arrays = {c: pa.array(v, pa.int64() if c == "portion" else pa.binary()) for c, v in columns.items()}
            return _batch(_FIELDS, arrays | {"bucket": pa.array(np.full(m, now)), "kind": pa.array(np.ones(m, np.int32))}, m)

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            if (kinds == 0).any():
                yield batch.filter(pa.array(kinds == 0))
            some = batch.filter(pa.array(kinds == 1))
            for bucket, portion, tokens, owners in zip(*(some.column(i).to_pylist() for i in (0, 2, 10, 11)), strict=True):
                if bucket != now:
                    if held:
                        yield finish()
                    now, held = bucket, []
                held.append((portion, tokens, owners))
        if held:
            yield finish()

    return spread.repartition("bucket").sortWithinPartitions("bucket", "kind", "portion").mapInArrow(work, _FIELDS)


def prefixes(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """token, n, node, hot: the rarest shingles of each class that the bound asks for, without those that no other text has.

    texts: portion, doc, n, node of the texts that stand for a class; shared: kind 1 of count_shingles.
    """
    names = "portion long, kind int, doc int, n long, node long, bucket int, tokens binary, owners binary, often binary"
    head = texts.selectExpr("portion", "0 as kind", "doc", "n", "node", "0 as bucket", "cast(null as binary) as tokens", "cast(null as binary) as owners", "cast(null as binary) as often")
    body = shared.selectExpr("portion", "1 as kind", "0 as doc", "0L as n", "0L as node", "bucket", "tokens", "owners", "often")
    hot_from = int(scaled(np.array([HOT_ROW]))[0])
    out = "token long, n long, node long, hot boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, parts = None, [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if not docs or not parts:
                return
            last = max(d for d, _, _ in docs) + 1
            n, node = np.zeros(max(last, 1 << 16), np.int64), np.zeros(max(last, 1 << 16), np.int64)
            for d, size, v in docs:
                n[d], node[d] = size, v
            owner = np.concatenate([np.frombuffer(o, np.uint16) for _, _, o, _ in parts]).astype(np.int64)
            token = np.concatenate([np.frombuffer(t, np.uint32).astype(np.int64) | (b << 32) for b, t, _, _ in parts])
            often = np.concatenate([np.frombuffer(f, np.uint8) for _, _, _, f in parts])
            real = n[owner] > 0
            owner, token, often = owner[real], token[real], often[real]
            by = np.lexsort((token, often, owner))
            owner, token, often = owner[by], token[by], often[by]
            count = np.bincount(owner, minlength=len(n))
            place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
            alone = n - count  # shingles of no other text come first
            taken = place < (prefix_length(n) - alone)[owner]
            taken[1:] &= (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            if taken.any():
                o = owner[taken]
                yield pa.RecordBatch.from_arrays([pa.array(token[taken]), pa.array(n[o]), pa.array(node[o]), pa.array(often[taken] >= hot_from)], names=["token", "n", "node", "hot"])

        for batch in batches:
            for portion, kind, doc, n, node, bucket, tokens, owners, often in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if portion != now:
                    yield from finish()
                    now, docs, parts = portion, [], []
                if kind == 0:
                    docs.append((doc, n, node))
                else:
                    parts.append((bucket, tokens, owners, often))
        yield from finish()

    assert len(names.split(", ")) == 9
    return head.unionByName(body).repartition("portion").sortWithinPartitions("portion", "kind").mapInArrow(work, out)


def multiply(entries: DataFrame, long_row: int = LONG_ROW) -> DataFrame:
    """Pairs and long rows of the product. kind 0: a pair of a short row (a < b); kind 1: a member b of a
    long row `token` with centre a. Sorted rows pass in a stream; of a long row only the centre and the first
    long_row members are held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, row, centre, last = None, [], None, None
        out: list[tuple] = []

        def finish():
            for y in range(1, len(row)):
                for x in range(y):
                    (na, a), (nb, b) = row[x], row[y]
                    if a != b and WHOLE * min(na, nb) >= PART * max(na, nb):
                        out.append((0, 0, *((a, na, b, nb) if a < b else (b, nb, a, na))))

        def batch_of():
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "token", "a", "na", "b", "nb"])

        for batch in batches:
            tokens = batch.column(0).to_numpy()
            # rows whose token stands alone give nothing
            like = np.concatenate([[token is not None and len(tokens) and tokens[0] == token], tokens[1:] == tokens[:-1]])[: len(tokens)]
            matter = like | np.concatenate([like[1:], [True]])[: len(tokens)]
            picked = np.flatnonzero(matter)
            ns, ids = (batch.column(i).to_numpy()[picked].tolist() for i in (1, 2))
            for t, n, i in zip(tokens[picked].tolist(), ns, ids, strict=True):
                if t != token:
                    finish()
                    token, row, centre, last = t, [], None, None
                    if len(out) > 20_000:
                        yield batch_of()
                        out.clear()
                if last == i:
                    continue  # a class that two equal rows stand for
                last = i
                if centre is not None:
                    out.append((1, t, centre[1], centre[0], i, n))
                elif len(row) < long_row:
                    row.append((n, i))
                else:
                    centre = row[0]
                    out.extend((1, t, centre[1], centre[0], b, nb) for nb, b in row[1:])
                    out.append((1, t, centre[1], centre[0], i, n))
                    row = []
            if len(tokens) and tokens[-1] != token:
                finish()
                token, row, centre, last = int(tokens[-1]), [], None, None
            if len(out) > 20_000:
                yield batch_of()
                out.clear()
        finish()
        yield batch_of()

    schema = "kind long, token long, a long, na long, b long, nb long"
    ordered = entries.where("not hot").select("token", "n", "node").repartition("token").sortWithinPartitions("token", "n", "node")
    hot = entries.where("hot")
    centres = hot.groupBy("token").agg(F.min(F.struct("n", "node")).alias("c"))
    stars = hot.join(centres, "token").where("node <> c.node").selectExpr("1L as kind", "token", "c.node as a", "c.n as na", "node as b", "n as nb")
    return ordered.mapInArrow(work, schema).unionByName(stars)


def reachable(pairs: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb, c) whose prefix count c leaves the bound within reach.

    Beyond the prefixes the sets can share no more than the longer rest. Shingles of equal bits may be counted as one, so
    a count stands for at least as many.
    """
    rest = lambda n: n - (n - F.ceil(F.lit(PART) * n / WHOLE) + 1)
    need = F.ceil(F.lit(PART) * (F.col("na") + F.col("nb")) / (PART + WHOLE))
    return pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).where(F.col("c") + F.greatest(rest(F.col("na")), rest(F.col("nb"))) >= need)


def sets_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (packed hashes) of the wanted classes (column node, distinct), from the texts that stand for them."""
    wanted = cut(classes.join(nodes, "node").select("node", F.col("rid").alias("id"), F.col("rd1").alias("d1"), F.col("rd2").alias("d2")))
    found = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["id", "d1", "d2"]).select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["node", "set"])

    return found.mapInArrow(tidy(work), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))  # equal rows have equal sets


def compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared, na, nb of each pair, by the whole sets. sets: node, set; pairs: a, b, distinct.

    A set is sent once for each centre a that it meets; a centre's members are dealt out by a salt, so no
    centre is one task, and a worker holds one centre's set.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    centres = pairs.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("member"), F.col("node").alias("id"), "set")
    members = pairs.join(sets, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("member"), F.col("node").alias("id"), "set")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, member, i, packed in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                s = np.frombuffer(packed, np.uint64)
                if not member:
                    centre, base = a, s
                elif centre == a:
                    out.append((a, i, common(base, s), len(base), len(s)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "na", "nb"])

    ordered = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id")
    return ordered.mapInArrow(work, "a long, b long, shared long, na long, nb long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _links(compared: DataFrame) -> DataFrame:
    return compared.where(WHOLE * F.col("shared") >= PART * (F.col("na") + F.col("nb") - F.col("shared")))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each left with each right set: the product of their incidence matrices, some columns at a time.

    Where left is right itself, shingles of one set only are left out, so the diagonal falls short.
    """
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    if left is right:
        found, times = np.unique(flat[0], return_counts=True)
        common = found[times > 1]
    else:
        common = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    places = []
    for side, tokens in zip((left, right), flat, strict=True):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
        held = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        by = np.argsort(at[held], kind="stable")
        places.append((row[held][by], at[held][by]))
    for start in range(0, len(common), 4096):
        width, parts = min(4096, len(common) - start), []
        for side, (row, at) in zip((left, right), places, strict=True):
            lo, hi = np.searchsorted(at, (start, start + width))
            part = np.zeros((len(side), width), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that join the same rows and columns as all of them; fewer than twice the rows and the columns."""
    owner, kept = np.full(linked.shape[1], -1), []
    for i in range(linked.shape[0]):
        columns = np.flatnonzero(linked[i])
        new, old = columns[owner[columns] < 0], columns[owner[columns] >= 0]
        others, first = np.unique(owner[old], return_index=True)
        kept.extend((i, int(c)) for c in (*new, *old[first]))
        owner[np.isin(owner, others)] = i
        owner[new] = i
    return kept


def open_blocks(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """block, side, id: the members that the blocks of the second product hold, for centres whose members are in several components.

    Side 1 is missing where a block meets itself. A centre whose members fit one block has that block only.
    """
    members = stars.select("a", "b", F.col("nb").alias("n")).union(stars.select("a", "a", "na")).distinct()
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")  # a centre's members are not one task
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    placed = cut(members.join(parts.select(F.col("node").alias("b"), "component"), "b", "left").select("a", "b", "n", F.coalesce("component", "b").alias("part"), salt))
    per = placed.groupBy("a", "part").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    small = ((F.sum("m") <= BLOCK) & (F.sum("t") <= BLOCK_SHINGLES)).alias("small")
    cores = per.groupBy("a").agg(F.max_by("part", F.struct("m", "part")).alias("core"), F.count("*").alias("k"), small).where("k > 1").select("a", "core", "small")
    band = F.when(F.col("small"), 0).otherwise(F.floor(F.log(F.col("n")) / F.log(F.lit(BAND)))).alias("band")
    dealt = placed.join(cores.select("*", salts), ["a", "salt"]).select("a", "b", "n", "salt", (~F.col("small") & (F.col("part") == F.col("core"))).alias("inner"), band)
    group = ["a", "inner", "band"]
    counts = dealt.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    listed = counts.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = listed.where("not inner").select("a", *(F.col(c).alias(f"{c}1") for c in ("inner", "band", "i")))
    two = listed.select("a", *(F.col(c).alias(f"{c}2") for c in ("inner", "band", "i")))
    met = one.join(two, "a").where("abs(band1 - band2) <= 1 and (inner2 or struct(band1, i1) <= struct(band2, i2))")
    met = met.withColumn("block", F.xxhash64("a", "band1", "i1", "inner2", "band2", "i2"))
    sides = met.select("a", "block", F.lit(0).alias("side"), F.col("inner1").alias("inner"), F.col("band1").alias("band"), F.col("i1").alias("i")).union(
        met.where("inner2 or band1 <> band2 or i1 <> i2").select("a", "block", F.lit(1), "inner2", "band2", "i2")
    )
    homes = dealt.join(counts.select("*", salts), [*group, "salt"]).withColumn("i", F.pmod(F.xxhash64("b"), F.col("blocks")))
    return homes.join(sides, [*group, "i"]).select("block", "side", F.col("b").alias("id"))


def multiply_blocks(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """src, dst: a spanning forest of the links between the two sides of each block. sets: node, set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, ([], []), ([], [])

        def links() -> pa.RecordBatch:
            other = bool(ids[1])
            shared = overlaps(held[0], held[other])
            sizes = [np.array([len(x) for x in held[k]], np.int64) for k in (0, other)]
            union = sizes[0][:, None] + sizes[1][None, :] - shared
            kept = forest((shared > 0) & (WHOLE * shared >= PART * union))
            return pa.RecordBatch.from_arrays([pa.array([ids[0][x] for x, _ in kept], pa.int64()), pa.array([ids[other][y] for _, y in kept], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for block, side, i, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if block != now:
                    if ids[0]:
                        yield links()
                    now, ids, held = block, ([], []), ([], [])
                ids[side].append(i)
                held[side].append(np.frombuffer(packed, np.uint64))
        if ids[0]:
            yield links()

    sent = blocks.join(sets, blocks["id"] == sets["node"]).select("block", "side", "id", "set").repartition("block").sortWithinPartitions("block", "side", "id")
    return sent.mapInArrow(work, "src long, dst long").where("src <> dst")


def buckets_for(rows: DataFrame) -> int:
    """Partitions of the shuffle, times what keeps a bucket below BUCKET_SHINGLES by the planner's size of the input."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partitions * max(1, -(-planned_bytes(rows) // (BYTES_PER_SHINGLE * BUCKET_SHINGLES * partitions)))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), whole_text(text).alias("text"))
    return rows.select("id", "text", *_digests(F.col("text")))


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("d1"), F.xxhash64(text, F.lit(1)).alias("d2")]


def link_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (id, d1, d2, n, node, rid), the classes (node, rid: their least id) and the links (src, dst) between them.

    rows: id, text, d1, d2. Texts without shingles have no node.
    """
    with small_batches(rows.sparkSession, 1024):
        counted = cut(count_shingles(spread_shingles(rows, buckets_for(rows))))
        texts = counted.where("kind = 0").select("portion", "doc", "id", "n", "s1", "s2", "d1", "d2")
        # one row a class, numbered; the numbers are those of a written table, so they are the same whenever they are read
        classes = cut(texts.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "d1", "d2")).alias("r")).select("n", "s1", "s2", F.col("r.id").alias("rid"), F.col("r.d1").alias("rd1"), F.col("r.d2").alias("rd2")))
        classes = classes.withColumn("node", F.monotonically_increasing_id())
        placed = cut(texts.join(classes, ["n", "s1", "s2"], "left").select("portion", "doc", "id", "d1", "d2", "n", "node", "rid", ((F.col("id") == F.col("rid")) & (F.col("d1") == F.col("rd1")) & (F.col("d2") == F.col("rd2"))).alias("stands")))
        product = cut(multiply(cut(prefixes(placed.where("stands"), counted.where("kind = 1")))))
        drop(counted)
        stars = product.where("kind = 1").select("token", "a", "b", "na", "nb")
        first = reachable(product.where("kind = 0")).select("a", "b").union(stars.where(WHOLE * F.least("na", "nb") >= PART * F.greatest("na", "nb")).select("a", "b"))
        pairs = cut(first.distinct())
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(stars.select("a")).union(stars.select("b")).distinct()
        sets = cut(sets_of(rows, classes, ends))
        links = cut(_links(compare(sets, pairs)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        if not stars.isEmpty():
            links = cut(links.union(multiply_blocks(sets, cut(open_blocks(stars, connected_components(links))))))
        drop(sets)
    return placed.select("id", "d1", "d2", "n", "node", "rid"), classes.select("node", "rid"), links


def _least(classes: DataFrame, links: DataFrame) -> DataFrame:
    """node, least: the least id that the links of a class reach; classes without a link have no row."""
    found = connected_components(links)
    least = found.join(classes, "node").groupBy("component").agg(F.min("rid").alias("least"))
    return found.join(least, "component").select("node", "least")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each row: the least id that links reach."""
    placed, classes, links = link_texts(_keyed(docs, id_col, text))
    # rows of one id are one document, those without shingles too
    several = cut(placed.where(F.col("id") != NULL_ID).groupBy("id").agg(F.min("node").alias("m"), F.max("node").alias("x"), F.count_if(F.col("node").isNull()).alias("z")).where("m <> x or (z > 0 and m is not null)"))
    if not several.isEmpty():
        links = links.union(placed.join(several, "id").where("node is not null and node <> m").select("m", "node"))
        placed = placed.join(several.select("id", "m"), "id", "left").withColumn("node", F.coalesce("node", "m"))
    out = placed.join(_least(classes, links), "node", "left").withColumn("c", F.coalesce("least", "rid", "id"))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(known("id").alias(id_col), F.col("n").alias("n_shingles"), known("c").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without later copies: of each group of linked texts the rows of its least id stay.

    Each text of a shared id has its own links. Rows without an id or without a word are groups of their own.
    """
    placed, classes, links = link_texts(_keyed(docs.where(F.col(id_col).isNotNull()), id_col, text))
    reached = placed.where("node is not null").join(_least(classes, links), "node", "left")
    later = cut(reached.where(F.coalesce("least", "rid") < F.col("id")).select(F.col("id").alias("_later"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).distinct())
    listed = F.broadcast(later) if later.count() <= BROADCAST_IDS else later
    d1, d2 = _digests(whole_text(text))
    return docs.join(listed, (docs[id_col] == listed["_later"]) & (d1 == listed["_d1"]) & (d2 == listed["_d2"]), "left_anti")
