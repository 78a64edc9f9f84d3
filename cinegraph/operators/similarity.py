"""Perceptual similarity: a band join on duration, whose blocks are compared as matrices of hashes.

Durations fall in bands as wide as the tolerance, so a match is in the same or the next band. A band of many items is cut into
slices, and each task compares two slices: neither a hot duration nor the items of unknown duration, which match all, are
ever in one task or held at once. A product of matrices bounds all pairs of two slices, and those it cannot rule out are compared
frame by frame. Only pairs that match leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.components import written

#: Seconds that durations may differ by; a good frame, the share of them, and the average distance that make two items alike.
TOLERANCE = 60
GOOD_FRAME, GOOD_RATIO, THRESHOLD = 8, 0.6, 10.0
#: Items of a slice, and the hash distances that are held at once.
SLICE, HELD = 4096, 1 << 20
#: Pairs that are compared frame by frame at once, and items whose pairs are bounded at once.
ROWS, TALL = 2048, 512
#: Bounding pairs by sums pays from so many pairs an item on.
PAYS = 100
#: What is added to each product of two frames before it is squared, and the lean from which a bit is left out of the sums.
SHIFT, LEANING = 1, 0.5
#: Pairs of items of the same and of neighbouring bands that a task gets, on average.
TASK_PAIRS = 1 << 25


def guarded_pairs(items: DataFrame, key: str, duration: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs a < b whose durations differ by the tolerance at most; an unknown duration pairs with all.

    An equi-join by band with a residual. Items of unknown duration meet all others by blocks, since every pair of them is a result.
    """
    rows = items.select(F.col(key).alias("k"), F.col(duration).alias("d"))
    band = F.floor(F.col("d") / tolerance)
    one = rows.where("d is not null").select(F.col("k").alias("a"), F.col("d").alias("da"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    two = rows.where("d is not null").select(F.col("k").alias("b"), F.col("d").alias("db"), band.alias("band"))
    near = one.join(two, "band").where((F.col("a") < F.col("b")) & (F.abs(F.col("da") - F.col("db")) <= tolerance)).select("a", "b")
    unknown = rows.where("d is null")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("m")).first()
    if not counts["m"]:
        return near
    left, right = -(-counts["m"] // SLICE), -(-counts["n"] // SLICE)
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("k"), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = deal(unknown, left, "i").select(F.col("k").alias("x"), "i", every(right).alias("j"))
    y = deal(rows, right, "j").select(F.col("k").alias("y"), F.col("d").isNotNull().alias("known"), "j", every(left).alias("i"))
    wide = x.join(y, ["i", "j"]).where((F.col("x") < F.col("y")) | (F.col("known") & (F.col("x") > F.col("y"))))
    return near.unionByName(wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def best_match(query: Column, target: Column) -> Column:
    """Native distances of the query's frames to their best frames; for small data and as a check."""
    return F.transform(query, lambda x: F.array_min(F.transform(target, lambda y: F.bit_count(x.bitwiseXOR(y)))))


def padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array of hashes as a matrix (rows, longest), and the rows' lengths."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    out = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], n)] = flat
    return out, n


def distances(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average distance and share of good frames of pairs of signatures, row by row; the shorter is the query, x at a tie."""
    average, good = np.empty(len(x)), np.empty(len(x))
    for rows, *found in _matched(x, nx, y, ny, np.inf, 0):
        average[rows], good[rows] = found
    return average, good


def _matched(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, threshold: float, good_ratio: float, second: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that are alike, with their average distance and share of good frames; a row is left as soon as its other frames cannot make it alike.

    second: where y is the query at a tie.
    """
    for at in range(0, len(x), ROWS):
        rows = np.arange(at, min(at + ROWS, len(x)))
        swap = nx[rows] > ny[rows] if second is None else (nx[rows] > ny[rows]) | ((nx[rows] == ny[rows]) & second[rows])
        n, m = np.where(swap, ny[rows], nx[rows]), np.where(swap, nx[rows], ny[rows])
        one, two = np.zeros((2, max(x.shape[1], y.shape[1]), len(rows)), np.uint64)  # by frame, so that each step below runs over all rows
        one[: x.shape[1]], two[: y.shape[1]] = x[rows].T, y[rows].T
        query, target = np.where(swap, two, one), np.where(swap, one, two)
        target = np.where(np.arange(len(target))[:, None] < m, target, target[0])  # a frame once more does not change which is nearest
        total, good = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k in range(int(n.max(initial=0))):
            best = np.bitwise_count(query[k] ^ target[0])
            for frame in target[1 : int(m.max())]:
                np.minimum(best, np.bitwise_count(query[k] ^ frame), out=best)
            real = k < n
            total += best * real
            good += (best <= GOOD_FRAME) & real
            rest = np.maximum(n - k - 1, 0)
            left = (total / n <= threshold) | ((good + rest) / n >= good_ratio)
            if 2 * np.count_nonzero(left) < len(left):
                rows, n, m, total, good, query, target = rows[left], n[left], m[left], total[left], good[left], query[:, left], target[:, left]
                if not len(rows):
                    break
        if len(rows):
            average, share = total / n, good / n
            alike = (average <= threshold) | (share >= good_ratio)
            yield rows[alike], average[alike], share[alike]


class Sums:
    """A bound that alike pairs reach, for all pairs of two sides by one product of matrices.

    With frames as vectors of +1 and -1, x . y = bits - 2 * distance. The sum of (x . y + SHIFT) ** 2 over all pairs of frames of two items
    is a scalar product of sums over each item's own frames: of products of two bits, of bits, and of ones. Every term is at least 0, and the terms of the frames
    that make two items alike have a least sum, `need`. So a pair below it is not alike; what reaches it must be compared. All values are halves
    of whole numbers that the float type holds exactly. Bits that hardly vary tell little and are left out, which lowers distances only.
    """

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray]], threshold: float, good_ratio: float):
        frames = np.concatenate([s[np.arange(s.shape[1]) < n[:, None]] for s, n in sides])
        lean = np.abs(2 * self.bits(frames).mean(0, dtype=np.float64) - 1)
        self.used = np.flatnonzero(lean < LEANING)
        b, most = len(self.used), max(s.shape[1] for s, _ in sides)
        n = np.arange(most + 1)
        close = lambda distance: max(0.0, b - 2 * distance + SHIFT) ** 2
        self.need = np.minimum(n * close(threshold), np.ceil(good_ratio * n - 1e-6) * close(GOOD_FRAME)) / 2 - 0.25  # sums are halves
        self.ones = (b + SHIFT**2) / 2
        self.sharp = self.need[most] > most * most * self.ones  # a chance pair of whole signatures has that sum
        self.kind = np.float32 if most * most * (b + SHIFT) ** 2 < 1 << 22 else np.float64
        self.pairs = np.triu_indices(b, 1)

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1)

    def of(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each item's sums: of its frames' products of two bits, of their bits, and their number."""
        b, cut = len(self.used), len(self.pairs[0])
        out = np.empty((len(s), cut + b + 1), self.kind)
        for at in range(0, len(s), 256):
            part = slice(at, at + 256)
            signs = 2 * self.bits(s[part])[:, :, self.used].astype(self.kind) - 1
            signs[np.arange(s.shape[1]) >= n[part, None]] = 0
            out[part, :cut] = (signs.swapaxes(1, 2) @ signs).reshape(len(signs), -1)[:, self.pairs[0] * b + self.pairs[1]]
            out[part, cut:-1] = signs.sum(1)
        out[:, -1] = n
        return out

    def query(self, sums: np.ndarray) -> np.ndarray:
        """The other side of the product."""
        out = sums.copy()
        out[:, len(self.pairs[0]) : -1] *= SHIFT
        out[:, -1] *= self.ones
        return out

    def reached(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that may be alike. x: of query(); need grows with the frames, so the fewer of both decide by the less."""
        sums, one, two = x @ y.T, self.need[nx].astype(self.kind), self.need[ny].astype(self.kind)
        at = np.flatnonzero(sums >= one[0]) if (one == one[0]).all() and (two == one[0]).all() else np.flatnonzero((sums >= one[:, None]) | (sums >= two))
        return np.divmod(at, len(y))


def _blocks(items: DataFrame, tolerance: float) -> DataFrame:
    """The items (k, d, s) once for each block (band, kind, i, j) that they are in. kind 0: slices of a band; 1: of it and the next; 2: of unknown durations and all."""
    known = items.where("d is not null").withColumn("band", F.floor(F.col("d") / tolerance))
    slices = known.groupBy("band").agg(F.ceil(F.count("*") / SLICE).alias("own"))
    sizes = slices.join(slices.select((F.col("band") - 1).alias("band"), F.col("own").alias("next")), "band", "left").join(slices.select((F.col("band") + 1).alias("band"), F.col("own").alias("before")), "band", "left")
    placed = known.join(sizes, "band").withColumn("at", F.pmod(F.xxhash64("k"), F.col("own")))
    none = F.array().cast("array<struct<band:bigint,kind:int,i:bigint,j:bigint,side:int>>")
    block = lambda band, kind, i, j, side: F.struct(band.cast("bigint").alias("band"), F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(side).alias("side"))
    upto = lambda first, end, make: F.when(first < end, F.transform(F.sequence(first, end - 1), make)).otherwise(none)
    at, band, zero = F.col("at"), F.col("band"), F.lit(0).cast("bigint")
    homes = F.concat(
        upto(at, F.col("own"), lambda j: block(band, 0, at, j, 0)), upto(zero, at, lambda i: block(band, 0, i, at, 1)),
        upto(zero, F.coalesce("next", zero), lambda j: block(band, 1, at, j, 0)), upto(zero, F.coalesce("before", zero), lambda i: block(band - 1, 1, i, at, 1)),
    )
    near = placed.select("k", "d", "s", F.explode(homes).alias("b")).select("k", "d", "s", "b.*")
    counts = items.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("m")).first()
    if not counts["m"]:
        return near
    left, right = -(-counts["m"] // SLICE), -(-counts["n"] // SLICE)
    mine = lambda n: F.pmod(F.xxhash64("k"), F.lit(n))
    one = items.where("d is null").select("k", "d", "s", F.explode(F.transform(F.sequence(zero, F.lit(right - 1).cast("bigint")), lambda j: block(zero, 2, mine(left), j, 0))).alias("b"))
    two = items.select("k", "d", "s", F.explode(F.transform(F.sequence(zero, F.lit(left - 1).cast("bigint")), lambda i: block(zero, 2, i, mine(right), 1))).alias("b"))
    return near.unionByName(one.unionByName(two).select("k", "d", "s", "b.*"))


def similar_pairs(items: DataFrame, key: str, duration: str, signature: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, good_ratio: float = GOOD_RATIO) -> DataFrame:
    """a, b, avg_distance, good_ratio of the guarded pairs a < b that are alike: by the average distance or the share of good frames.

    Items without a frame are like none.
    """
    return _compared(items, key, duration, signature, threshold, tolerance, good_ratio, False)


def similar_links(items: DataFrame, key: str, duration: str, signature: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, good_ratio: float = GOOD_RATIO) -> DataFrame:
    """a, b: of the pairs that similar_pairs lists, as many as it takes to reach the same items from each, in every block.

    Many copies of an item make a row each, not one for every two of them, and two that are linked already are not compared.
    """
    return _compared(items, key, duration, signature, threshold, tolerance, good_ratio, True).select("a", "b")


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after items i and j are linked: each item's is the least place that it reaches."""
    while len(i):
        one, two = label[i], label[j]
        apart = one != two
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != (further := label[label])).any():
            label = further
    return label


def _compared(items: DataFrame, key: str, duration: str, signature: str, threshold: float, tolerance: float, good_ratio: float, links: bool) -> DataFrame:
    """Rows of similar_pairs, or of similar_links with both figures 0."""
    # signatures are read several times below, so they are made and written once
    rows = written(items.select(F.col(key).alias("k"), F.col(duration).cast("double").alias("d"), F.col(signature).alias("s"))).where(F.size("s") > 0)
    kind = rows.schema["k"].dataType.simpleString()
    names = ["a", "b", "avg_distance", "good_ratio"]

    def compare(left: pa.RecordBatch, right: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        sides = []
        for side in [left] if right is None else [left, right]:
            keys, d, (s, n) = side.column(0).to_numpy(zero_copy_only=False), side.column(1).to_numpy(zero_copy_only=False), padded(side.column(2))
            order = np.argsort(d, kind="stable")  # unknown durations are last
            sides.append((keys[order], d[order], s[order], n[order]))
        (kx, dx, x, nx), (ky, dy, y, ny) = sides[0], sides[-1]
        timed = not (np.isnan(dx).any() or np.isnan(dy).any())
        sums = Sums([side[2:] for side in sides], threshold, good_ratio) if len(kx) * len(ky) > PAYS * (len(kx) + len(ky)) else None
        sums = sums if sums and sums.sharp else None
        if sums:
            fy = sums.of(y, ny)
            fx = sums.query(fy if right is None else sums.of(x, nx))
        second = 0 if right is None else len(kx)  # where the other side's items begin in label
        label, every = np.arange(second + len(ky)), kx if right is None else np.concatenate([kx, ky])
        step = max(1, HELD // (x.shape[1] * y.shape[1]))
        height = TALL if sums else max(1, 8 * step // len(ky))
        for top in range(0, len(kx), height):
            end = min(top + height, len(kx))
            lo, hi = (int(np.searchsorted(dy, dx[top] - tolerance, "left")), int(np.searchsorted(dy, dx[end - 1] + tolerance, "right"))) if timed else (0, len(ky))
            lo = max(lo, top) if right is None else lo
            if lo >= hi:
                continue
            i, j = sums.reached(fx[top:end], nx[top:end], fy[lo:hi], ny[lo:hi]) if sums else np.divmod(np.arange((end - top) * (hi - lo)), hi - lo)
            i, j = i + top, j + lo
            wanted = kx[i] != ky[j]
            if right is None:
                wanted &= (i < j) & (np.abs(dx[i] - dy[j]) <= tolerance)
            elif timed:
                wanted &= np.abs(dx[i] - dy[j]) <= tolerance
            else:  # unknown against all: two of them meet twice
                wanted &= ~np.isnan(dy[j]) | (kx[i] < ky[j])
            i, j = i[wanted], j[wanted]
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                if links:
                    apart = label[p] != label[second + q]
                    p, q = p[apart], q[apart]
                swap = kx[p] > ky[q]  # at equal lengths the lesser key is the query
                if links:
                    for alike, *_ in _matched(x[p], nx[p], y[q], ny[q], threshold, good_ratio, swap):
                        label = _joined(label, p[alike], second + q[alike])
                    continue
                a, b = np.where(swap, ky[q], kx[p]), np.where(swap, kx[p], ky[q])
                for alike, average, good in _matched(x[p], nx[p], y[q], ny[q], threshold, good_ratio, swap):
                    yield pa.RecordBatch.from_arrays([pa.array(a[alike], left.schema[0].type), pa.array(b[alike], left.schema[0].type), pa.array(average), pa.array(good)], names=names)
        ends = np.flatnonzero(label != np.arange(len(label)))
        if len(ends):
            none = pa.array(np.zeros(len(ends)))
            yield pa.RecordBatch.from_arrays([pa.array(every[label[ends]], left.schema[0].type), pa.array(every[ends], left.schema[0].type), none, none], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def finish() -> Iterator[pa.RecordBatch]:
            whole = [pa.Table.from_batches(side).combine_chunks().to_batches()[0] if side else None for side in held]
            if now[1] == 0 and now[2] == now[3]:
                yield from compare(whole[0], None)
            elif whole[0] is not None and whole[1] is not None:
                yield from compare(*whole)

        for batch in batches:
            blocks = np.stack([batch.column(c).to_numpy() for c in range(3, 8)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]).any(1)])).tolist() if len(blocks) else []
            for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                block = tuple(blocks[a, :4].tolist())
                if block != now:
                    if held[0] or held[1]:
                        yield from finish()
                    now, held = block, ([], [])
                held[int(blocks[a, 4])].append(batch.select([0, 1, 2]).slice(a, b - a))
        if held[0] or held[1]:
            yield from finish()

    # the rows are few bytes for the work that they are, so their number of tasks is not left to the planner
    pairs = rows.groupBy(F.floor(F.col("d") / tolerance).alias("band")).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.when(F.col("band").isNull(), F.col("n") * rows.count()).otherwise(2 * F.col("n") ** 2))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(pairs / TASK_PAIRS))
    dealt = _blocks(rows, tolerance).select("k", "d", "s", "band", "kind", "i", "j", "side").repartition(tasks, "band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j", "side")
    return dealt.mapInArrow(work, f"a {kind}, b {kind}, avg_distance double, good_ratio double")


def near_hashes(items: DataFrame, key: str, value: str, most: int, bits: int = 64) -> DataFrame:
    """a, b, distance: pairs a < b of hashes that differ in `most` bits at most.

    The bits are cut into most + 1 pieces; such a pair has one piece in common, so it meets by an equi-join on the pieces, and the
    first piece that it shares reports it.
    """
    cuts = [bits * k // (most + 1) for k in range(most + 2)]
    rows = items.select(F.col(key).alias("k"), F.col(value).alias("v"))
    pieces = F.array(*[F.shiftrightunsigned("v", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
    spread = rows.withColumn("p", pieces).select("k", "v", "p", F.posexplode("p").alias("at", "piece"))
    one, two = spread.select(*[F.col(c).alias(f"{c}1") if c not in ("at", "piece") else F.col(c) for c in spread.columns]), spread.select(*[F.col(c).alias(f"{c}2") if c not in ("at", "piece") else F.col(c) for c in spread.columns])
    met = one.join(two, ["at", "piece"]).where("k1 < k2").withColumn("distance", F.bit_count(F.col("v1").bitwiseXOR(F.col("v2")))).where(F.col("distance") <= most)
    first = F.array_position(F.zip_with("p1", "p2", lambda x, y: x == y), True) - 1
    return met.where(first == F.col("at")).select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("distance").cast("int").alias("distance"))
