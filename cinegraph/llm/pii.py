"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from fixed patterns. The candidates are these and looser ones
(numbers that only look like cards, phone numbers without a country code, spelt-out
addresses). Labelers vote on each candidate: a format check, gazetteers, words
before it that speak for or against it, and its layout. Votes are 1, 0 or null.
Expectation-maximisation over the counts of vote patterns (at most 4 kinds x 3^5
rows) estimates how reliable each labeler is and how likely each pattern is
personal data. A naive Bayes classifier on the votes, length and surroundings of a
candidate is trained with these as soft labels, over all candidates, and adds
the spans that it is sure of; base spans always stay.

A null text is an empty one; rows are treated one by one, so repeated rows, null
ids, ties and columns of other names need no care. Without candidates (an empty table)
nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import cut, whole_text
from cinegraph.llm.spans import find_spans, outside

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a run of characters is entered at its start only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser patterns of the method.
SPELT_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?i:dot)[\])]|\.) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])"
#: Gazetteers and context words.
TOP_DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "co", "me", "app", "dev", "ai",
    "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es", "eu", "fi", "fr", "gr", "hu", "ie", "il", "in", "it", "jp", "kr", "mx",
    "nl", "no", "nz", "pl", "pt", "ro", "ru", "se", "sg", "sk", "tr", "tw", "ua", "uk", "us", "za",
)
#: Blocks of addresses that belong to no host of the open network.
SPECIAL_IPS = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\.|^0*192\.0*0\.0*2\.|^0*198\.0*51\.0*100\.|^0*203\.0*0\.0*113\."
#: First digits of card issuers.
CARD_STARTS = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[0689]|3[47]|35(?:2[89]|[3-8])|6(?:011|4[4-9]|5|2|0|3|7))"
#: Country codes of the telephone network: zones, and the two- and three-digit codes of each.
DIAL_CODES = r"^\+?(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[578][0-9]|9[0-58]|9[679][0-9])"
FOR_WORDS = {"email": r"\b(?:e-?mail|mail|contact|write|reach)\b", "ip": r"\b(?:ip|host|server|address|from|login)\b", "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b", "phone": r"\b(?:tel|phone|call|mobile|cell|fax|contact)\b"}
AGAINST_WORDS = r"\b(?:version|order|invoice|isbn|issn|serial|build|section|chapter|ticket|id|no)\b[^a-z]*$"
LABELERS = ("v_format", "v_gazetteer", "v_for", "v_against", "v_layout")
EM_STEPS = 8
#: A candidate beside the base is added from this probability on, and only if a context or gazetteer labeler speaks for it.
SURE = 0.9


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit holds; null-safe for an empty text."""
    value = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), doubled), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def is_base(kind: str, s: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's test."""
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits_of(s)).between(13, 19) & luhn(digits_of(s))
    if kind == "phone":
        return F.length(digits_of(s)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, s: Column, before: Column) -> dict[str, Column]:
    one = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else ~yes, 0)
    d = digits_of(s)
    none = F.lit(None).cast("int")
    form = {"email": F.contains(s, F.lit("@")), "ip": is_base("ip", s), "card": luhn(d), "phone": F.startswith(s, F.lit("+"))}[kind]
    listed = {
        "email": F.lower(F.regexp_extract(s, r"([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS),
        "ip": ~F.regexp_like(s, F.lit(SPECIAL_IPS)),
        "card": F.regexp_like(d, F.lit(CARD_STARTS)),
        "phone": F.regexp_like(s, F.lit(DIAL_CODES)) | F.regexp_like(d, F.lit("^[2-9]")),
    }[kind]
    layout = {"email": F.length(s) <= 64, "ip": F.length(s) >= 7, "card": F.length(d).isin(15, 16), "phone": F.length(d).between(10, 12)}[kind]
    return {
        "v_format": one(form), "v_gazetteer": one(listed), "v_for": F.when(F.regexp_like(before, F.lit(FOR_WORDS[kind])), 1).otherwise(none),
        "v_against": F.when(F.regexp_like(before, F.lit(AGAINST_WORDS)), 0).otherwise(none), "v_layout": one(layout),
    }


def _candidates(kind: str, rank: int, spans: Column, base: Column | bool) -> Column:
    def build(s):
        before = F.lower(s["before"])
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), (is_base(kind, s["text"]) if base is True else F.lit(False)).alias("base"),
            *[v.cast("int").alias(k) for k, v in _votes(kind, s["text"], before).items()],
            F.least(F.length(s["text"]), F.lit(24)).alias("f_length"), F.when(before == "", "start").when(F.endswith(before, F.lit(" ")), "space").when(F.regexp_like(before, F.lit(r"[a-z0-9]$")), "joined").otherwise("mark").alias("f_before"),
        )

    return F.transform(spans, build)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _pii_c: all candidates of a row, base ones marked. One scan of the text."""
    t = F.col("_pii_t")
    df = docs.withColumn("_pii_t", whole_text(text))
    has = lambda x: F.contains(t, F.lit(x))
    df = df.withColumns({
        "_pii_email": find_spans(t, EMAIL, has("@")), "_pii_ip": find_spans(t, IP), "_pii_phone": find_spans(t, PHONE, has("+")),
        "_pii_card": F.filter(find_spans(t, CARD), lambda s: (s["end"] - s["start"] >= 13) & F.length(digits_of(s["text"])).between(13, 19)),
        "_pii_spelt": find_spans(t, SPELT_EMAIL, has("at)") | has("at]") | has("AT)") | has("AT]")), "_pii_local": find_spans(t, LOCAL_PHONE),
    })
    strict = [_candidates(k, i, F.col(f"_pii_{k}"), True) for i, k in enumerate(KINDS)]
    loose = [_candidates("email", 0, F.col("_pii_spelt"), False), _candidates("phone", 3, F.col("_pii_local"), False)]
    # matches of the ip and phone patterns that fail are no candidates; of cards they are
    kept = F.filter(F.concat(*strict), lambda c: c["base"] | (c["kind"] == "card"))
    return df.withColumn("_pii_c", F.concat(kept, *loose)).drop("_pii_t", *[f"_pii_{k}" for k in ("email", "ip", "phone", "card", "spelt", "local")])


def _log_odds(kind: Column, model: dict, vote: Column, j: int) -> Column:
    """Log-odds that the vote of labeler j gives; one CASE over kinds and votes."""
    out = F.lit(0.0)
    for k, m in model.items():
        for value in (1, 0):
            a, b = m["yes"][j][value], m["no"][j][value]
            out = F.when((kind == k) & (vote == value), F.lit(math.log(a / b))).otherwise(out)
    return out


def _prior(kind: Column, model: dict) -> Column:
    out = F.lit(0.0)
    for k, m in model.items():
        out = F.when(kind == k, F.lit(math.log(m["prior"] / (1 - m["prior"])))).otherwise(out)
    return out


def estimate(patterns: DataFrame, steps: int = EM_STEPS) -> dict:
    """Reliabilities by EM over (kind, votes, n). Each step is one sum by kind, of at most 4 rows.

    Start: a labeler is right 8 times of 10. Counts are smoothed by one of each.
    """
    model = {k: {"prior": 0.5, "yes": [{1: 0.8, 0: 0.2}] * len(LABELERS), "no": [{1: 0.2, 0: 0.8}] * len(LABELERS)} for k in KINDS}
    for _ in range(steps):
        z = _prior(F.col("kind"), model)
        for j, v in enumerate(LABELERS):
            z = z + _log_odds(F.col("kind"), model, F.col(v), j)
        soft = patterns.withColumn("p", 1 / (1 + F.exp(-z)))
        yes, no = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(yes).alias("yes"), F.sum(no).alias("no")]
        for j, v in enumerate(LABELERS):
            sums += [F.sum(F.when(F.col(v) == x, w)).alias(f"{c}{j}{x}") for c, w in (("y", yes), ("n", no)) for x in (1, 0)]
        for row in soft.groupBy("kind").agg(*sums).collect():
            rate = lambda c, j: {x: ((row[f"{c}{j}{x}"] or 0.0) + 1 * w) / ((row[f"{c}{j}1"] or 0.0) + (row[f"{c}{j}0"] or 0.0) + 2) for x, w in ((1, 1), (0, 1))}  # noqa: B023, E731
            model[row["kind"]] = {"prior": (row["yes"] + 1) / (row["yes"] + row["no"] + 2), "yes": [rate("y", j) for j in range(len(LABELERS))], "no": [rate("n", j) for j in range(len(LABELERS))]}
    return model


FEATURES = ("f_length", "f_before")


def train(counted: DataFrame, model: dict) -> dict[tuple[str, str, str], float]:
    """Weights of the final classifier: (kind, feature, value) to log-odds, from soft labels of all candidates.

    Lengths are at most 24 and places of four sorts, so the table has at most 4 x 28 rows.
    """
    z = _prior(F.col("kind"), model)
    for j, v in enumerate(LABELERS):
        z = z + _log_odds(F.col("kind"), model, F.col(v), j)
    soft = counted.withColumn("p", 1 / (1 + F.exp(-z))).select("kind", "n", "p", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("x")) for f in FEATURES])).alias("z"))
    sums = soft.groupBy("kind", "z.f", "z.x").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()
    total: dict = {}
    for r in sums:
        a, b = total.get((r["kind"], r["f"]), (2.0, 2.0))
        total[r["kind"], r["f"]] = (a + r["yes"], b + r["no"])
    return {(r["kind"], r["f"], r["x"]): math.log((r["yes"] + 1) / total[r["kind"], r["f"]][0]) - math.log((r["no"] + 1) / total[r["kind"], r["f"]][1]) for r in sums}


def probability(c: Column, model: dict, weights: dict) -> Column:
    z = _prior(c["kind"], model)
    for j, v in enumerate(LABELERS):
        z = z + _log_odds(c["kind"], model, c[v], j)
    for (kind, f, x), w in sorted(weights.items()):
        z = z + F.when((c["kind"] == kind) & (c[f].cast("string") == x), F.lit(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without text, with _pii_base and _pii_spans: arrays of (kind, rank, start, end)."""
    narrow = cut(candidates(docs, text).drop(text))
    flat = narrow.select(F.explode("_pii_c").alias("c")).select("c.*")
    counted = cut(flat.groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n")))
    model = estimate(cut(counted.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))))
    weights = train(counted, model)
    plain = lambda cs: F.transform(cs, lambda c: F.struct(c["kind"], c["rank"], c["start"], c["end"]))
    base = F.filter("_pii_c", lambda c: c["base"])
    backed = lambda c: (F.coalesce(c["v_for"], F.lit(0)) == 1) | (c["v_gazetteer"] == 1)
    weak = F.filter("_pii_c", lambda c: ~c["base"] & backed(c))
    sure = F.when(F.size("_pii_weak") > 0, F.filter("_pii_weak", lambda c: probability(c, model, weights) >= SURE)).otherwise(F.col("_pii_weak"))
    out = narrow.withColumn("_pii_base", plain(base)).withColumn("_pii_weak", weak).withColumn("_pii_sure", plain(sure)).withColumn("_pii_sure", outside(F.col("_pii_sure"), F.col("_pii_base")))
    return out.withColumn("_pii_spans", F.concat("_pii_base", "_pii_sure")).drop("_pii_c", "_pii_weak", "_pii_sure")


