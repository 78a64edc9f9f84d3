"""The persistent index: a keyed table with lookup, coalescing upsert, prune and cache tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that follow from a file's content: a changed fingerprint makes them null.
DERIVED = ("exact_hash", "perceptual_hashes")


def quick_fingerprint(size: Column, mtime: Column) -> Column:
    """Of a file's size and time; an empty text where either is unknown."""
    return F.when(size.isNotNull() & mtime.isNotNull(), F.sha2(F.concat_ws(":", F.lit("file"), size.cast("string"), mtime.cast("string")), 256)).otherwise("")


def content_fingerprint(size: Column, mtime: Column) -> Column:
    return F.when(size.isNotNull() & mtime.isNotNull(), F.sha2(F.concat_ws(":", size.cast("string"), mtime.cast("string")), 256)).otherwise("")


def get(index: DataFrame, paths: list[str], key: str = "path") -> DataFrame:
    """The records of a few paths."""
    return index.where(F.col(key).isin(*paths)) if paths else index.limit(0)


def cached_paths(index: DataFrame, key: str = "path") -> DataFrame:
    return index.select(key)


def upsert(index: DataFrame, updates: DataFrame, key: str = "path", fingerprint: str | None = None, stamp: Column | None = None) -> DataFrame:
    """New values where they are not null, old ones else; derived values do not outlive their fingerprint.

    stamp: what updated_at becomes for the keys of the updates; untouched records keep theirs.
    """
    columns = [c for c in index.columns if c != key]
    new = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns if c in updates.columns], F.lit(True).alias("_touched"))
    joined = index.join(new, key, "full_outer")

    def value(c: str) -> Column:
        if c == "updated_at" and stamp is not None:
            return F.when(F.col("_touched"), stamp).otherwise(F.col(c))
        if fingerprint and c in DERIVED:
            changed = F.col(f"_new_{fingerprint}").isNotNull() & ~F.col(f"_new_{fingerprint}").eqNullSafe(F.col(fingerprint))
            kept = F.when(~changed, F.col(c))
            return F.coalesce(F.col(f"_new_{c}"), kept) if c in updates.columns else kept
        if c not in updates.columns:
            return F.col(c)
        return F.coalesce(F.col(f"_new_{c}"), F.col(c))

    return joined.select(key, *[value(c).alias(c) for c in columns])


def last_known(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Folds a log of updates: for each key the last value that is not null, in the given order."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def prune(index: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    return index.join(found.select(key), key, "left_semi")


def stale(index: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """The records that prune drops; their count is what a prune reports."""
    return index.join(found.select(key), key, "left_anti")


def remove(index: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def cache_misses(files: DataFrame, index: DataFrame, key: str = "path", fingerprint: str = "content_fingerprint") -> DataFrame:
    """Files that the index does not hold with this fingerprint."""
    return files.join(index.select(key, fingerprint), [key, fingerprint], "left_anti")


def cache_hits(files: DataFrame, index: DataFrame, key: str = "path", frames: int | None = None) -> DataFrame:
    """The files with scan_hit, content_hit and, given a number of frames, signature_hit; one lookup by path."""
    held = index.select(F.col(key), F.col("quick_fingerprint").alias("_quick"), F.col("content_fingerprint").alias("_content"), *([F.col("perceptual_hashes").alias("_hashes"), F.col("perceptual_num_frames").alias("_frames")] if frames else []))
    same = lambda mine, theirs: F.coalesce(F.col(mine) == F.col(theirs), F.lit(False))
    out = files.join(held, key, "left").withColumn("scan_hit", same("quick_fingerprint", "_quick")).withColumn("content_hit", same("content_fingerprint", "_content"))
    if frames:
        whole = (F.coalesce(F.size("_hashes"), F.lit(0)) > 0) & (F.col("_frames") == frames)
        out = out.withColumn("signature_hit", F.col("content_hit") & F.coalesce(whole, F.lit(False))).drop("_hashes", "_frames")
    return out.drop("_quick", "_content")


def ensure_metadata(index: DataFrame, files: DataFrame, probe, force: bool = False, stamp: Column | None = None) -> DataFrame:
    """The index with every file's metadata: files whose quick fingerprint changed, or whose width is unknown, are probed.

    files: path, size_bytes, mtime_ns; probe: a MediaProbe. Derived values of changed files go.
    """
    from cinegraph.sources.probe import with_metadata

    now = files.select("path", quick_fingerprint(F.col("size_bytes"), F.col("mtime_ns")).alias("quick_fingerprint"), content_fingerprint(F.col("size_bytes"), F.col("mtime_ns")).alias("content_fingerprint"))
    known = index.where(F.col("width").isNotNull()).select("path", "quick_fingerprint")
    wanted = now if force else now.join(known, ["path", "quick_fingerprint"], "left_anti")
    return upsert(index, with_metadata(probe.reports(wanted)).drop("readable"), fingerprint="content_fingerprint", stamp=stamp)
