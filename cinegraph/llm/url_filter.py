"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed URL is a host (which stands for its subdomains too) and the start of a
path. A page's candidate keys are the suffixes of its host, at label bounds,
with the starts of its path in the lengths that are listed. Only as many labels at
a host's end are taken as the longest listed host has. The filter passes
the keys that may be listed; the join with the list itself removes the false
positives, so the filter decides speed only, never a verdict.

Null or malformed urls have an empty host and path and match nothing. Repeated
rows each get a verdict, empty tables give empty results, and columns of the
pages are kept out of the join, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.llm.common import ascii_lower

#: Bits for a key, and the most bytes of a filter. Past that size there are fewer
#: bits for a key: more possible hits reach the exact join, the results stay whole.
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
#: A list of at most so many keys is broadcast to the exact join.
BROADCAST_KEYS = 200_000
WORDS = 8  # 32-bit words of a block


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty text."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def listed_keys(listed: DataFrame) -> DataFrame:
    """(host, path, ...) to one row for each distinct canonical key."""
    return listed.withColumn("key", F.concat(ascii_lower(F.col("host")), F.coalesce("path", F.lit("")))).where("key is not null and host <> ''")


def build_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The filter as an array (blocks, 8) of 32-bit words; one row a block reaches the driver."""
    blocks = 1
    while blocks * 256 < n_keys * BITS_PER_KEY and blocks * 64 <= MAX_FILTER_BYTES:
        blocks *= 2
    h, g = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(g, {5 * i}) & 31 as int))").alias(f"w{i}") for i in range(WORDS)]
    rows = (
        keys.select(h.alias("h"), g.alias("g")).select((F.col("h").bitwiseAND(blocks - 1)).alias("block"), *bits)
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )
    out = np.zeros((blocks, WORDS), np.uint32)
    got = rows.toPandas()
    out[got["block"].to_numpy(np.int64)] = got[[f"w{i}" for i in range(WORDS)]].to_numpy(np.int64)
    return out


def may_contain(spark: SparkSession, bloom: np.ndarray, key: Column) -> Column:
    """True for each listed key and for few others."""
    held = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = held.value
        for h, g in batches:
            block = words[h.to_numpy(np.int64) & (len(words) - 1)]
            g = g.to_numpy(np.int64)
            hit = np.ones(len(g), bool)
            for i in range(WORDS):
                hit &= (block[:, i] >> ((g >> (5 * i)) & 31).astype(np.uint32)) & 1 == 1
            yield pd.Series(hit)

    return probe(F.xxhash64(key), F.xxhash64(key, F.lit(1)))


def match_urls(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Distinct (host, path) of the pages with the longest listed entry of each level that fits.

    listed: host, path, level, verdict. Returns host, path and for each match one
    row (level, rule, verdict); urls without a match have no row.
    """
    spark = pages.sparkSession
    keys = listed_keys(listed).select("key", "level", "verdict", F.col("host").alias("rule_host"))
    keys = keys.groupBy("key", "level").agg(F.min("verdict").alias("verdict"), F.max(F.length("rule_host")).alias("host_len"))
    n_keys = keys.count()
    bounds = listed_keys(listed).agg(F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    lengths, most_labels = bounds["lengths"], bounds["labels"]
    if not lengths:
        return spark.createDataFrame([], "host string, path string, level int, rule string, verdict string")
    urls = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host <> ''").distinct()
    # the end of the host, with as many labels as a listed host can have, and one more to tell that it goes on
    urls = urls.withColumn("labels", F.split(F.substring_index("host", ".", -(most_labels + 1)), r"\.")).withColumn("labels", F.slice("labels", F.greatest(F.size("labels") - most_labels + 1, F.lit(1)), F.lit(most_labels)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    wanted = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path"))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(wanted, lambda n: F.concat(s, F.substr(F.col("path"), F.lit(1), n)))))
    exploded = urls.select("host", "path", F.explode(F.array_distinct(candidates)).alias("key"))
    possible = exploded.where(may_contain(spark, build_filter(keys, n_keys), F.col("key")))
    exact = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    return (
        possible.join(exact, "key").groupBy("host", "path", "level")
        .agg(F.max(F.struct(F.length("key").alias("n"), "host_len", F.col("key").alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "level", "best.rule", "best.verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, blocked: DataFrame, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """A verdict for each page: the longest rule that fits decides; without one, a listed url is blocked.

    rules: host, path, verdict (allow or block); blocked: host, path. Returns
    id_col, host, path, rule (null without one), verdict, listed (the entry of
    the blocked list that fits, or null).
    """
    listed = rules.select("host", "path", F.lit(0).alias("level"), "verdict").unionByName(blocked.select("host", "path", F.lit(1).alias("level"), F.lit("block").alias("verdict")))
    found = match_urls(pages, listed, url).groupBy("host", "path").agg(
        F.max(F.when(F.col("level") == 0, F.col("rule"))).alias("rule"), F.max(F.when(F.col("level") == 0, F.col("verdict"))).alias("by_rule"), F.max(F.when(F.col("level") == 1, F.col("rule"))).alias("listed")
    )
    page = pages.select(F.col(id_col), host_of(F.coalesce(F.col(url).cast("string"), F.lit(""))).alias("host"), path_of(F.coalesce(F.col(url).cast("string"), F.lit(""))).alias("path"))
    verdict = F.coalesce("by_rule", F.when(F.col("listed").isNotNull(), "block"), F.lit("allow"))
    return page.join(found, ["host", "path"], "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "listed")
