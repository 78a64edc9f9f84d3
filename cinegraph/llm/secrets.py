"""Secret scan with multipart credential linking, in DataFrame expressions only.

Base spans come from fixed patterns. Weak parts - identifiers, secret-looking
tokens, endpoints - mean nothing alone. They are linked by an interval join:
inside a scope (one document, SCOPE characters to either side) a weak part is
reported only if parts of both other roles co-occur; base spans count as
parts. The join is on (row, bucket of SCOPE characters); a bucket's parts are
first reduced to the first and last place of each role, so that a part meets three
rows at most and a document of thousands of parts makes no pairs of them.

A null text is an empty one. Rows are told apart by a number of their own, so
repeated rows and null ids are treated one by one; empty tables give empty results, and ties
in place are ordered by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import cut, whole_text
from cinegraph.llm.spans import find_spans, outside

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: The base patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Weak parts of the method.
ID = r"(?i:client_?id|user_?name|login|account(?:_?id)?|access_?key(?:_?id)?)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9@._-]{3,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?i:https?|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x09-\x0D\x20\"'<>]{4,}+|(?i:endpoint|host(?:_?name)?|server)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9.-]{4,}+"
SCOPE = 300


def value_of(match: Column) -> Column:
    """The second group of an assignment."""
    return F.regexp_extract(match, r"[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)$", 1)


#: What a span of each kind can be in a credential; the first three kinds are the base.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}


def _as_parts(spans: Column, kind: str, rank: int) -> Column:
    fixed = (F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
    return F.transform(spans, lambda s: F.struct(*fixed, s["start"].alias("start"), s["end"].alias("end"), F.lit(ROLES[kind]).alias("role"), F.lit(rank < 3).alias("base")))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _sec_p: (kind, rank, start, end, role, base) of a row. One scan of the text."""
    t = F.col("_sec_t")
    has = lambda x: F.contains(t, F.lit(x))
    df = docs.withColumn("_sec_t", whole_text(text))
    df = df.withColumns({
        "_sec_assign": F.filter(find_spans(t, ASSIGN, has("=") | has(":")), lambda s: F.length(value_of(s["text"])) >= 8),
        "_sec_access": F.filter(find_spans(t, ACCESS, has("AKIA")), lambda s: s["end"] - s["start"] >= 16),
        "_sec_hex": find_spans(t, HEX),
        "_sec_id": find_spans(t, ID, has("=") | has(":")),
        "_sec_secret": F.filter(find_spans(t, TOKEN), lambda s: F.regexp_like(s["text"], F.lit("[0-9]")) & F.regexp_like(s["text"], F.lit("[a-z]")) & F.regexp_like(s["text"], F.lit("[A-Z]"))),
        "_sec_endpoint": find_spans(t, ENDPOINT, has("=") | has(":")),
    })
    each = [_as_parts(F.col(f"_sec_{k}"), k, i) for i, k in enumerate(KINDS)]
    return df.withColumn("_sec_p", F.concat(*each)).drop("_sec_t", *[f"_sec_{k}" for k in KINDS])


def link(narrow: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_sec_row, kind, rank, start, end) of the weak parts whose complements co-occur."""
    flat = narrow.where(F.exists("_sec_p", lambda p: ~p["base"])).select("_sec_row", F.explode("_sec_p").alias("p")).select("_sec_row", "p.*").withColumn("bucket", F.floor(F.col("start") / scope))
    ends = flat.groupBy("_sec_row", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = flat.where(~F.col("base")).withColumn("near", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    met = weak.alias("w").join(ends.alias("e"), (F.col("w._sec_row") == F.col("e._sec_row")) & (F.col("near") == F.col("e.bucket")) & (F.col("w.role") != F.col("e.role")))
    inside = (F.abs(F.col("first") - F.col("w.start")) <= scope) | (F.abs(F.col("last") - F.col("w.start")) <= scope) | (F.col("near") == F.col("w.bucket"))
    return (
        met.where(inside).groupBy(*[F.col(f"w.{c}").alias(c) for c in ("_sec_row", "kind", "rank", "start", "end")])
        .agg(F.count_distinct("e.role").alias("roles")).where("roles = 2").drop("roles")
    )


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The rows without text, with _sec_base and _sec_spans: arrays of (kind, rank, start, end)."""
    narrow = cut(parts(docs, text).drop(text).withColumn("_sec_row", F.monotonically_increasing_id()))
    plain = lambda ps: F.transform(ps, lambda p: F.struct(p["kind"], p["rank"], p["start"], p["end"]))
    linked = link(narrow, scope).groupBy("_sec_row").agg(F.collect_list(F.struct("kind", "rank", "start", "end")).alias("_sec_linked"))
    out = narrow.withColumn("_sec_base", plain(F.filter("_sec_p", lambda p: p["base"]))).drop("_sec_p").join(linked, "_sec_row", "left").drop("_sec_row")
    # a weak part that overlaps a base span says nothing new
    new = out.withColumn("_sec_new", F.when(F.col("_sec_linked").isNotNull(), outside(F.col("_sec_linked"), F.col("_sec_base"))))
    return new.withColumn("_sec_spans", F.when(F.col("_sec_new").isNull(), F.col("_sec_base")).otherwise(F.concat("_sec_base", "_sec_new"))).drop("_sec_linked", "_sec_new")
