"""Exact duplicates by digest, and which copy to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.text import file_name, stem

NOISE = (r"(?U)\(\s*\d+\s*\)", r"(?iU)\bcopy\b", r"(?iU)\bduplicate\b")


def exact_groups(files: DataFrame, digest: str = "digest") -> DataFrame:
    """digest, n for each digest that several files share; files without a digest are left out."""
    return files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def cleanliness(path: Column) -> list[Column]:
    """Sort keys of the cleanest name: noise, length of the stem, odd characters, path."""
    s = stem(file_name(path))
    noise = sum((F.regexp_count(s, F.lit(p)) for p in NOISE[1:]), F.regexp_count(s, F.lit(NOISE[0])))
    return [noise, F.length(s), F.length(F.regexp_replace(s, r"[\p{L}\p{N} \-_.]", "")), F.lower(path)]


def keep_cleanest(files: DataFrame, digest: str = "digest", path: str = "path") -> DataFrame:
    """Adds rank (1 is kept) and group_size to the files that have copies; one shuffle, by digest."""
    group = Window.partitionBy(digest)
    ranked = files.where(F.col(digest).isNotNull()).withColumn("group_size", F.count("*").over(group))
    return ranked.withColumn("rank", F.row_number().over(group.orderBy(*cleanliness(F.col(path)), path))).where("group_size > 1")


def rank_for_keep(files: DataFrame, group: str, ties: list[str], pixels: str = "pixels", bit_rate: str = "bit_rate", duration: str = "duration_sec", size: str = "size") -> DataFrame:
    """Adds median_duration and rank: pixels, bit rate, nearness to the group's median duration, size, then ties."""
    w = Window.partitionBy(group)
    known = F.when(F.col(duration) > 0, F.col(duration))
    near = F.coalesce(F.abs(known - F.col("median_duration")), F.lit(float("inf")))
    order = [F.desc(F.coalesce(pixels, F.lit(0))), F.desc(F.coalesce(bit_rate, F.lit(0))), near, F.desc(F.coalesce(size, F.lit(0))), *ties]
    return files.withColumn("median_duration", F.median(known).over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)))


def keep_or_remove(files: DataFrame, digest: str = "digest", path: str = "path") -> DataFrame:
    """The files that have copies, with keep: the path that stays. Partial sums find it, so a digest of many copies is no single task's."""
    groups = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("group_size"), F.min_by(path, F.struct(*cleanliness(F.col(path)), F.col(path))).alias("keep")).where("group_size > 1")
    return files.join(groups, digest)


def resolve(files: DataFrame, group: str, ties: list[str], **columns: str) -> DataFrame:
    """The best file of each group; a group of one keeps its file."""
    return rank_for_keep(files, group, ties, **columns).where("rank = 1").drop("rank")


def quality_score(width: Column, height: Column, bit_rate: Column, duration: Column) -> Column:
    """Pixels, bit rate and whole seconds; what is unknown is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct((zero(width).cast("bigint") * zero(height).cast("bigint")).alias("pixels"), zero(bit_rate).cast("bigint").alias("bit_rate"), zero(duration).cast("bigint").alias("seconds"))


def safe_size(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)).cast("bigint")
