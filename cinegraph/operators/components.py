"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which something must be wrong; they grow with the logarithm of the largest component.
MOST_ROUNDS = 60


def written(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder; only a local session may have one of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="cinegraph-"))
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Removes the files of rows that written() wrote and that are not read again."""
    where = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the least node that each node with an edge reaches.

    Null ends and loops are dropped; nodes without an edge have no row. Each
    round writes the edges to the shared folder, so that lost executors cost no
    recomputation. Hubs are reduced by partial sums, and the join can be split by AQE.
    """
    now = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        before, now = now, written(_small_star(_large_star(now)))
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
