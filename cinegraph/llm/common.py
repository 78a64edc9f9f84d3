"""Helpers shared by the corpus operators: word patterns, tables, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what lies between words (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null document id where ids are compared: larger than any other.
NULL_ID = 2**63 - 1
#: A planner's figure from here on means that it does not know.
UNKNOWN_SIZE = 1 << 50
#: Rows of texts that a worker gets at once.
ARROW_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cinegraph-"))
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so when the driver collects what nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Removes the files that cut(df) wrote; the rows must not be read again."""
    plan = df._jdf.queryExecution().logical()
    if not plan.getClass().getSimpleName() == "LogicalRDD":
        return
    where = plan.rdd().getCheckpointFile()
    if where.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of the rows; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # no job
    return size if size < UNKNOWN_SIZE else 0


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Jobs inside send at most so many rows to a worker at once: texts are long, and a batch is held by both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    return F.array_remove(F.split(F.translate(c, "\t\n\x0b\f\r", " " * 5), " "), "")
