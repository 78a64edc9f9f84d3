"""SHA-256 of whole files, read in pieces by the executors: Spark's binary source stops at 2 GB and holds a file at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20


def digest_file(path: str | None) -> str | None:
    """Null for a file that is missing or cannot be read."""
    if path is None:
        return None
    state = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while piece := f.read(PIECE):
                state.update(piece)
    except OSError:
        return None
    return state.hexdigest()


def file_digests(files: DataFrame) -> DataFrame:
    """path, exact_hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest_file(p) for p in batch.column(0).to_pylist()], pa.string())], names=["path", "exact_hash"])

    return files.select("path").mapInArrow(work, "path string, exact_hash string")


def collect_digests(files: DataFrame, index: DataFrame, use_cache: bool = True) -> DataFrame:
    """path, exact_hash: from the index where path and content_fingerprint still hold, computed else."""
    if not use_cache:
        return file_digests(files)
    cached = files.select("path", "content_fingerprint").join(index.where(F.col("exact_hash").isNotNull()).select("path", "content_fingerprint", "exact_hash"), ["path", "content_fingerprint"]).select("path", "exact_hash")
    return cached.unionByName(file_digests(files.join(cached.select("path"), "path", "left_anti")))
