"""Bracket tags: profiles of tagged groups, and suggestions for untagged files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.operators.components import written
from cinegraph.operators.similarity import HELD, SLICE, distances, padded

#: How many samples make a profile, the distance that is asked for, and what a poor fit costs.
MIN_SAMPLES, TAG_THRESHOLD, FIT_WEIGHT = 3, 12, 10.0
#: Least distance limit, fit, share of good frames, samples and margin of a high confidence; fit and share of the others.
HIGH = (8.0, 0.25, 0.6, 5, 2.0)
MEDIUM, LOW = (0.45, 0.45), (0.6, 0.35)


def tag_profiles(files: DataFrame, tag: str = "tag", duration: str = "duration", aspect: str = "aspect", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Medians of what is known (0 is not), and the number of files of each tag; the files are those with a signature."""
    known = lambda c: F.median(F.when(F.col(c) != 0, F.col(c)))
    return files.where(F.col(tag).isNotNull()).groupBy(tag).agg(known(duration).alias("median_duration"), known(aspect).alias("median_aspect"), F.count("*").alias("sample_count")).where(F.col("sample_count") >= min_samples)


def metadata_fit(duration: Column, aspect: Column, median_duration: Column, median_aspect: Column) -> Column:
    """0 is a perfect fit; an unknown or zero value costs 1."""
    by_length = F.when((duration != 0) & (median_duration != 0), F.abs(duration - median_duration) / median_duration).otherwise(1.0)
    by_shape = F.when((aspect != 0) & (median_aspect != 0), F.abs(aspect - median_aspect)).otherwise(1.0)
    return F.coalesce(by_length, F.lit(1.0)) + F.coalesce(by_shape, F.lit(1.0))


def confidence(distance: Column, fit: Column, ratio: Column, samples: Column, margin: Column, threshold: float) -> Column:
    high = (distance <= max(HIGH[0], threshold - 4)) & (fit <= HIGH[1]) & (ratio >= HIGH[2]) & (samples >= HIGH[3]) & (margin >= HIGH[4])
    near = distance <= threshold
    return F.when(high, "high").when(near & (fit <= MEDIUM[0]) & (ratio >= MEDIUM[1]), "medium").when(near & (fit <= LOW[0]) & (ratio >= LOW[1]), "low")


def perceptual_scores(candidates: DataFrame, references: DataFrame, item: str = "path", tag: str = "tag", signature: str = "signature") -> DataFrame:
    """item, tag, distance, good_ratio: medians, over the tag's references, of a candidate's distance and share of good frames.

    Each candidate meets each reference, since the medians are over all of them; both are dealt into slices, and a task compares two
    slices at a time. Items without a frame have no row.
    """
    candidates, references = written(candidates.select(item, signature)), written(references.select(tag, signature))  # read several times below
    left = candidates.where(F.size(signature) > 0).select(F.col(item).alias("k"), F.lit(None).cast(references.schema[tag].dataType).alias("tag"), F.col(signature).alias("s"))
    right = references.where((F.size(signature) > 0) & F.col(tag).isNotNull()).select(F.lit(None).cast(candidates.schema[item].dataType).alias("k"), F.col(tag).alias("tag"), F.col(signature).alias("s"))
    n, m = (max(1, -(-df.count() // SLICE)) for df in (left, right))
    deal = lambda df, c, n: F.pmod(F.xxhash64(c, "s"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    one = left.select("k", "tag", "s", deal(left, "k", n).alias("i"), every(m).alias("j"), F.lit(0).alias("side"))
    two = right.select("k", "tag", "s", every(n).alias("i"), deal(right, "tag", m).alias("j"), F.lit(1).alias("side"))
    kinds = [candidates.schema[item].dataType.simpleString(), references.schema[tag].dataType.simpleString()]

    def compare(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if not held[0] or not held[1]:
            return
        left, right = (pa.Table.from_batches(side).combine_chunks().to_batches()[0] for side in held)
        (x, nx), (y, ny) = padded(left.column(2)), padded(right.column(2))
        step = max(1, HELD // (x.shape[1] * y.shape[1] * len(y)))
        for at in range(0, len(x), step):
            p = np.repeat(np.arange(at, min(at + step, len(x))), len(y))
            q = np.tile(np.arange(len(y)), len(p) // len(y))
            average, good = distances(x[p], nx[p], y[q], ny[q])
            yield pa.RecordBatch.from_arrays([left.column(0).take(pa.array(p)), right.column(1).take(pa.array(q)), pa.array(average), pa.array(good)], names=["k", "tag", "average", "good"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            blocks = np.stack([batch.column(c).to_numpy() for c in (3, 4, 5)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]).any(1)])).tolist() if len(blocks) else []
            for a, b in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if tuple(blocks[a, :2]) != now:
                    yield from compare(held)
                    now, held = tuple(blocks[a, :2]), ([], [])
                held[int(blocks[a, 2])].append(batch.select([0, 1, 2]).slice(a, b - a))
        yield from compare(held)

    dealt = one.unionByName(two).select("k", "tag", "s", "i", "j", "side").repartition("i", "j").sortWithinPartitions("i", "j", "side")
    pairs = dealt.mapInArrow(work, f"k {kinds[0]}, tag {kinds[1]}, average double, good double")
    return pairs.groupBy(F.col("k").alias(item), F.col("tag").alias(tag)).agg(F.median("average").alias("distance"), F.median("good").alias("good_ratio"))


def best_tags(scores: DataFrame, item: str, threshold: float = TAG_THRESHOLD) -> DataFrame:
    """scores: item, tag, distance, good_ratio, fit, sample_count. The best tag of each item with its confidence; no row where there is none."""
    s = scores.withColumn("combined", F.col("distance") + FIT_WEIGHT * F.col("fit"))
    order = Window.partitionBy(item).orderBy("combined", "fit", F.desc("good_ratio"), F.desc("sample_count"), F.lower(F.col("tag").cast("string")))
    s = s.withColumn("margin", F.coalesce(F.lead("combined").over(order) - F.col("combined"), F.lit(float("inf")))).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return s.withColumn("confidence", confidence(F.col("distance"), F.col("fit"), F.col("good_ratio"), F.col("sample_count"), F.col("margin"), threshold)).where("confidence is not null")


def suggest_tags(files: DataFrame, min_samples: int = MIN_SAMPLES, threshold: float = TAG_THRESHOLD, item: str = "path") -> DataFrame:
    """files: item, tag (null: untagged), signature, duration, aspect. A suggestion for each untagged file that one fits.

    Profiles are one row a tag; tags are far fewer than files, and the join with them is by tag.
    """
    signed = files.where(F.size("signature") > 0)
    profiles = tag_profiles(signed, min_samples=min_samples)
    learned = signed.join(profiles.select("tag"), "tag", "left_semi")
    asked = signed.where(F.col("tag").isNull())
    scores = perceptual_scores(asked, learned, item).join(profiles, "tag").join(asked.select(item, "duration", "aspect"), item)
    fit = metadata_fit(F.col("duration"), F.col("aspect"), F.col("median_duration"), F.col("median_aspect"))
    return best_tags(scores.withColumn("fit", fit), item, threshold).select(item, "tag", "distance", "fit", "good_ratio", "sample_count", "confidence", "margin")


def suggestion_order(name: Column) -> list[Column]:
    """Sort keys of suggestions: confidence, distance, name."""
    return [F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2), F.col("distance"), F.lower(name)]
