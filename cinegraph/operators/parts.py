"""Split files: contiguous runs of part numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.names import merged_stem, parse_part_file


def contiguous_runs(parts: DataFrame, keys: list[str], part: str = "part", ties: list[str] = ()) -> DataFrame:
    """Adds run: rows whose part follows the one before by exactly 1 share a run; repeats and gaps break it."""
    order = Window.partitionBy(*keys).orderBy(part, *ties)
    broken = F.when(F.col(part) == F.lag(part).over(order) + 1, 0).otherwise(1)
    return parts.withColumn("_break", broken).withColumn("run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_break")


def run_summary(parts: DataFrame, keys: list[str], part: str = "part", duration: str = "duration", tolerance: float = 0.15, ties: list[str] = ()) -> DataFrame:
    """One row a run of two or more: n_parts, start_part, end_part, total_duration, compatible.

    Runs of three or more must have each duration within the tolerance of their mean; unknown durations pass.
    """
    runs = contiguous_runs(parts, keys, part, ties)
    found = runs.groupBy(*keys, "run").agg(
        F.count("*").alias("n_parts"), F.min(part).alias("start_part"), F.max(part).alias("end_part"), F.avg(duration).alias("_mean"), F.min(duration).alias("_least"), F.max(duration).alias("_most"),
        F.count_if(F.col(duration).isNull() | (F.col(duration) <= 0)).alias("_unknown"), F.coalesce(F.sum(F.when(F.col(duration) > 0, F.col(duration))), F.lit(0.0)).alias("total_duration"),
    ).where("n_parts > 1")
    inside = (F.col("_mean") - F.col("_least") <= tolerance * F.col("_mean")) & (F.col("_most") - F.col("_mean") <= tolerance * F.col("_mean"))
    return found.withColumn("compatible", (F.col("n_parts") < 3) | (F.col("_unknown") > 0) | inside).select(*keys, "n_parts", "start_part", "end_part", "total_duration", "compatible")


def part_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The files that are parts, with parent, prefix, suffix and part; the group is (parent, prefix, suffix), case and all."""
    keep = [F.col(f"`{c}`") for c in files.columns if c not in ("parent", "prefix", "suffix", "part")]
    found = F.filter(F.array(parse_part_file(F.col(path))), lambda p: p.isNotNull())  # exploded, so that a name is parsed once
    return files.select(*keep, F.explode(found).alias("_part")).select(*keep, "_part.parent", "_part.prefix", "_part.suffix", "_part.part")


def merge_groups(files: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """files: path, duration_sec, readable, size_bytes. One row a run that can be merged, in output order by ORDER.

    sources: the parts in order; unreadable: those that cannot be read, which forbid the merge; merged: the name of the result.
    """
    group = ["parent", "prefix", "suffix"]
    runs = contiguous_runs(part_files(files), group, "part", ["path"])
    known = F.col("duration_sec") > 0
    found = runs.groupBy(*group, "run").agg(
        F.count("*").alias("n_parts"), F.min("part").alias("start_part"), F.max("part").alias("end_part"), F.avg("duration_sec").alias("_mean"), F.min("duration_sec").alias("_least"), F.max("duration_sec").alias("_most"),
        F.count_if(F.coalesce(~known, F.lit(True))).alias("_unknown"), F.coalesce(F.sum(F.when(known, F.col("duration_sec"))), F.lit(0.0)).alias("total_duration"), F.sum("size_bytes").alias("size_bytes"),
        # a run's parts are the numbers of one title: few, and in one row of the plan anyway
        F.sort_array(F.collect_list(F.struct("part", "path", "readable"))).alias("_parts"),
    ).where("n_parts > 1")
    near = (F.col("_mean") - F.col("_least") <= tolerance * F.col("_mean")) & (F.col("_most") - F.col("_mean") <= tolerance * F.col("_mean"))
    fits = found.where((F.col("n_parts") < 3) | (F.col("_unknown") > 0) | near)
    bad = F.transform(F.filter("_parts", lambda p: ~p["readable"]), lambda p: p["path"])
    name = F.concat(merged_stem(F.col("prefix"), F.col("suffix"), F.col("start_part"), F.col("end_part")), F.lit(".mp4"))
    return fits.select(*group, "n_parts", "start_part", "end_part", "total_duration", "size_bytes", F.transform("_parts", lambda p: p["path"]).alias("sources"), bad.alias("unreadable"), name.alias("merged"))


#: Output order of merge groups.
ORDER = ("lower(parent)", "lower(prefix)", "lower(suffix)", "start_part")
