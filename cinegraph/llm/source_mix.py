"""Mixing sources to target token counts by entropy balancing.

Targets: a share of all tokens by weight, none above `cap` times its source's
size; the excess goes to the others by weight. Rates: each document is taken
rate times, and the rates are the ones closest in entropy to the base rate of each document
(cap / 2 without a prior) that give each source its target of tokens. Their dual is convex with one unknown lambda a
source: rate = cap * sigmoid(prior + lambda * size / mean size), an exponential tilt by the document's tokens kept
under the cap: a source that must grow takes more of its long documents, for they cost the least entropy a token. Distributed Newton
steps, each one sum over the documents' classes, find lambda; a bracket that each sum narrows catches steps that go too far. Rounding:
documents of one source, prior and size form a class; classes are taken from the
longest down, each passing its rounding error on to the next, so that a source
ends within a few words of its target. Inside a class the copies are dealt
out over hash buckets, and then by the order of a hash of the id, so no class
is ever in one task and a rerun gives the same copies.

Null texts have size 0; a null source is a source of its own, last in order.
Repeated rows are documents of their own. A source without words has target
0, and an empty table an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import cut

CAP = 2
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Steps after which something must be wrong; a target is met when the rates' sum is that near to it.
NEWTON_STEPS, TOLERANCE = 100, 1e-9
#: At most so many rows of copies are broadcast to the documents; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Hash buckets of a class for dealing copies; more than a class's share of the tasks needs.
BUCKETS = 512


def count_words(text: Column) -> Column:
    """Number of words of a text: places where a word starts."""
    flat = F.translate(text, "\t\n\x0b\f\r", " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def source_key(source: Column) -> Column:
    """Orders sources by code point with null last, and never is null itself."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets_of(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source_size) to skey, source_size, target. One row a source; a window over sources only.

    The level at which sources fill up is found in closed form: with sources in
    the order of cap * size / weight, those before the level are full.
    """
    n = len(weights)
    order = Window.orderBy("skey")
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % n + 1).cast("int"))
    by_fill = Window.orderBy("_fill", "skey")
    full = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_fill", F.col("_cap") / F.col("_w"))
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = full.withColumn("_before", F.sum("_cap").over(by_fill) - F.col("_cap")).withColumn("_rest", F.sum("_w").over(everything) - F.sum("_w").over(by_fill) + F.col("_w"))
    full = full.withColumn("_level", (F.sum("source_size").over(everything) * share - F.col("_before")) / F.col("_rest"))
    level = F.first(F.when(F.col("_level") <= F.col("_fill"), F.col("_level")), ignorenulls=True).over(everything)
    return full.select("skey", "source_size", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def rate_of(prior: Column, lam: Column, size: Column, mean: Column, cap: float) -> Column:
    """Copies of a document: the base rate, tilted by its size."""
    return F.lit(float(cap)) / (1 + F.exp(-(prior + lam * size / mean)))


def balance(classes: DataFrame, targets: DataFrame, cap: float = CAP, most: int = NEWTON_STEPS) -> DataFrame:
    """lam and mean (the mean size) of each source: Newton steps on the dual, each one sum over (skey, prior, size, n), until every target is met.

    If the share p of its size is wanted from a source, each class alone would need lambda = (logit p - prior) * mean / size; the
    least and the greatest of these bracket the answer. A step beyond the bracket, which each sum narrows, is replaced by its
    middle. Targets of nothing or of the whole cap need no step.
    """
    inside = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(cap))
    odds = F.log(F.when(inside, F.col("target") / (F.col("source_size") * float(cap) - F.col("target"))).otherwise(1.0))
    counted = targets.join(classes.where("size > 0").groupBy("skey").agg((F.sum("tokens") / F.sum("n")).alias("mean")), "skey", "left").withColumn("odds", odds).withColumn("mean", F.coalesce("mean", F.lit(1.0)))
    alone = (F.col("odds") - F.col("prior")) * F.col("mean") / F.col("size")
    edges = classes.where("size > 0").join(counted.select("skey", "odds", "mean"), "skey").groupBy("skey").agg(F.min(alone).alias("low"), F.max(alone).alias("high"))
    columns = ["skey", "source_size", "target", "mean", "lam", "low", "high"]
    bounded = counted.join(edges, "skey", "left").withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(0.0)))
    lam = cut(bounded.withColumn("lam", F.greatest("low", F.least("high", F.col("odds")))).select(*columns))
    for _ in range(most):
        rate = rate_of(F.col("prior"), F.col("lam"), F.col("size"), F.col("mean"), cap)
        sums = classes.join(lam.select("skey", "lam", "mean"), "skey").groupBy("skey").agg(
            F.sum(F.col("tokens") * rate).alias("got"), F.sum(F.col("tokens") * F.col("size") / F.col("mean") * rate * (1 - rate / float(cap))).alias("slope")
        )
        now = cut(lam.join(sums, "skey", "left").withColumn("miss", F.when(inside, F.col("target") - F.col("got")).otherwise(0.0)))
        if now.where(F.abs("miss") > TOLERANCE * F.col("target")).isEmpty():
            return now.select("skey", "source_size", "target", "mean", "lam")
        low, high = F.when(F.col("miss") > 0, F.col("lam")).otherwise(F.col("low")), F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("high"))
        moved = now.withColumn("low", low).withColumn("high", high).withColumn("_to", F.col("lam") + F.when(F.col("slope") > 0, F.col("miss") / F.col("slope")))
        held = F.when((F.col("_to") >= F.col("low")) & (F.col("_to") <= F.col("high")), F.col("_to")).otherwise((F.col("low") + F.col("high")) / 2)
        lam = moved.withColumn("lam", F.when(F.col("miss") == 0, F.col("lam")).otherwise(held)).select(*columns)
    raise RuntimeError("the rates did not settle")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, prior: Column | None = None) -> DataFrame:
    """id_col, key (a hash of the text), size, source_size, target, rate, copies, taken for each row.

    prior: log-odds of a document's base rate over the cap, before balancing (0 if not given).
    """
    prior = F.lit(0.0) if prior is None else F.round(F.coalesce(prior.cast("double"), F.lit(0.0)), 2)
    rows = docs.select(F.col(id_col).alias("_id"), count_words(F.col(text)).alias("size"), source_key(F.col(source)).alias("skey"), prior.alias("prior"), text_key(F.col(text)).alias("key"))
    rows = cut(rows.withColumn("_h", F.xxhash64("_id", "key")).withColumn("bucket", F.expr(f"pmod(shiftright(_h, 40), {BUCKETS})").cast("int")))
    key = ["skey", "prior", "size"]
    counts = rows.groupBy(*key, "bucket").agg(F.count("*").alias("m"))
    classes = cut(counts.groupBy(*key).agg(F.sum("m").alias("n"))).withColumn("tokens", F.col("n") * F.col("size"))
    targets = cut(targets_of(classes.groupBy("skey").agg(F.sum("tokens").alias("source_size")), weights, share, cap))
    lam = cut(balance(classes, targets, cap))
    dealt = cut(_deal_classes(classes, lam, cap))
    within = Window.partitionBy(*key).orderBy("bucket")
    share_of = lambda upto: F.floor(upto * F.col("extra") / F.col("n"))
    quota = counts.join(dealt, key).withColumn("_upto", F.sum("m").over(within)).select(
        *key, "bucket", "base", "rate", (share_of(F.col("_upto")) - share_of(F.col("_upto") - F.col("m"))).alias("quota")
    )
    place = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("_h", "_id", "key"))
    out = rows.withColumn("_p", place).join(quota, [*key, "bucket"]).withColumn("copies", F.col("base") + (F.col("_p") <= F.col("quota")).cast("long"))
    return out.join(targets, "skey").select(F.col("_id").alias(id_col), "key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _deal_classes(classes: DataFrame, lam: DataFrame, cap: int) -> DataFrame:
    """Copies for each class: base for every member, and extra for that many of them.

    The classes of a source, one for each size that occurs, are folded from the
    longest down. A source's array holds sizes, not documents, and the sizes of
    a corpus grow as the root of its words at most.
    """
    rated = classes.join(lam, "skey").withColumn("rate", F.when(F.col("target") >= F.col("source_size") * float(cap), F.lit(float(cap))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(rate_of(F.col("prior"), F.col("lam"), F.col("size"), F.col("mean"), cap)))
    down = Window.partitionBy("skey").orderBy(F.desc("size"), "prior")
    wanted = rated.withColumn("_wish", F.sum(F.col("tokens") * F.col("rate")).over(down))
    items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("k"), "prior", "size", "n", "rate", F.col("_wish").alias("wish"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        size = F.greatest(x["size"], F.lit(1))
        k = F.greatest(F.lit(0), F.least(x["n"] * cap, F.round((x["wish"] - acc["sum"]) / size).cast("long")))
        return F.struct((acc["sum"] + k * x["size"]).alias("sum"), F.array_append(acc["taken"], k).alias("taken"))

    folded = wanted.groupBy("skey").agg(items.alias("items")).withColumn("k", F.aggregate("items", start, step)["taken"])
    flat = folded.select("skey", F.explode(F.arrays_zip("items", "k")).alias("z"))
    k, n = F.col("z.k"), F.col("z.items.n")
    base = F.floor(k / n)
    return flat.select("skey", F.col("z.items.prior").alias("prior"), F.col("z.items.size").alias("size"), n.alias("n"), F.col("z.items.rate").alias("rate"), base.alias("base"), (k - base * n).alias("extra"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns. mixed: mix(...) of the same documents, with its key column.

    Rows that share an id are told apart by their texts. Rows that share both take the copies of all of them, dealt
    out one by one, so that a source's target holds whatever is repeated.
    """
    copies = cut(mixed.groupBy(F.col(id_col).alias("_mix_id"), F.col("key").alias("_mix_key")).agg(F.sum("copies").alias("_mix_n"), F.count("*").alias("_mix_m")))
    listed = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies  # so that the texts need no shuffle
    joined = docs.join(listed, docs[id_col].eqNullSafe(copies["_mix_id"]) & (text_key(docs[text]) == copies["_mix_key"]))
    dealt = joined.where("_mix_m = 1").withColumn("_mix_own", F.col("_mix_n").cast("int"))
    if not copies.where("_mix_m > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("_mix_id", "_mix_key").orderBy(F.lit(0)))
        several = joined.where("_mix_m > 1").withColumn("_mix_place", place)
        dealt = dealt.unionByName(several.withColumn("_mix_own", F.floor((F.col("_mix_n") + F.col("_mix_m") - F.col("_mix_place")) / F.col("_mix_m")).cast("int")).drop("_mix_place"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return dealt.where("_mix_own > 0").withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_own")))).select(*names)
