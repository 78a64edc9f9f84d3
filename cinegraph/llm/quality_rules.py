"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Each rule names a measure and its least and greatest allowed value; a row is
kept if it breaks none. Measures are column expressions over the whole text: lengths,
symbol, stop-word and line ratios, repeats of 5-word windows. A null or empty text
has no words and fails the length rule. Ids may be null or repeated: rows are judged one
by one, so ties, repeated rows, empty tables and extra columns need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import whole_text, words

#: The common words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on", "be", "this", "are", "by",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "qui", "pour", "dans",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "con", "por", "para", "es", "no", "su",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: (measure, least, greatest, from): None means no bound; a rule holds for texts of at
#: least `from` words. Ratios are in hundredths and compared in whole numbers. Hard rules are those of the base.
HARD_RULES = (("n_words", 10, None, 0), ("repeat_pct", None, 20, 0))
RULES = HARD_RULES + (
    ("mean_word_pct", 200, 1200, 0),
    ("symbol_pct", None, 40, 0),
    ("stop_pct", 2, None, 40),
    ("dup_line_pct", None, 50, 0),
)
#: A ratio's measures: a hundred times the first over the second.
RATIOS = {
    "repeat_pct": ("n_repeat_words", "n_words"), "mean_word_pct": ("word_chars", "n_words"), "symbol_pct": ("n_symbols", "n_words"),
    "stop_pct": ("n_stop", "n_words"), "dup_line_pct": ("n_dup_lines", "n_lines"),
}


def _windows(w: Column, size: int) -> Column:
    """64-bit hashes of the windows, in order; none if there are fewer than two."""
    n = F.size(w) - size + 1
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _by_hash(win: Column) -> Column:
    """(hash, place) sorted; empty if no hash repeats, so that only texts with a repeat are sorted."""
    placed = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(win)) == F.size(win), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(placed)


def _covered(placed: Column, size: int) -> Column:
    """Words in the windows whose hash stands next to its like in placed, which must be a plain column."""
    same = lambda x, k: F.coalesce(x["h"] == F.get(placed, k)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(size), i + size - acc["end"])).alias("n"), (i + size).alias("end"))
    return F.aggregate(places, start, step)["n"]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop")


def measures(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """Adds the MEASURES as columns _qr_<name>; all expressions are native.

    They are columns of their own, not a struct, so that the optimizer does not
    repeat an expensive expression at each place that reads it.
    """
    df = docs.withColumn("_qr_t", whole_text(text)).withColumn("_qr_w", words(F.col("_qr_t"))).withColumn("_qr_win", _windows(F.col("_qr_w"), size))
    lines = F.filter(F.split("_qr_t", "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", " " * 4))) > 0)
    df = df.withColumn("_qr_placed", _by_hash(F.col("_qr_win"))).withColumn("_qr_lines", lines)
    values = {
        "n_words": F.size("_qr_w"),
        "word_chars": F.length(F.translate("_qr_t", " \t\n\x0b\f\r", "")),
        "n_symbols": F.length("_qr_t") - F.length(F.translate("_qr_t", SYMBOLS, "")),
        "n_dup_lines": F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines")),
        "n_lines": F.size("_qr_lines"),
        "n_repeat_words": _covered(F.col("_qr_placed"), size),
        "n_stop": F.size(F.filter("_qr_w", lambda x: x.isin(*STOP_WORDS))),
    }
    return df.withColumns({f"_qr_{k}": v.cast("long") for k, v in values.items()}).drop("_qr_t", "_qr_w", "_qr_win", "_qr_placed", "_qr_lines")


def _sides(name: str) -> tuple[Column, Column]:
    """What a measure is compared by: value and unit, value >= bound * unit; whole numbers."""
    m = lambda x: F.col(f"_qr_{x}")
    if name in MEASURES:
        return m(name), F.lit(1)
    part, whole = RATIOS[name]
    return 100 * m(part), F.greatest(m(whole), F.lit(1))


def compile_rules(rules) -> Column:
    """One boolean expression: true if the row breaks a rule of the table."""
    broken = F.lit(False)
    for name, least, most, start in rules:
        (value, unit), holds = _sides(name), F.col("_qr_n_words") >= start
        if least is not None:
            broken = broken | (holds & (value < F.lit(least) * unit))
        if most is not None:
            broken = broken | (holds & (value > F.lit(most) * unit))
    return broken


def apply_rules(docs: DataFrame, rules=RULES, hard=HARD_RULES, text: str = "text") -> DataFrame:
    """The input columns with the measures (_qr_<name>), _qr_base_failed and _qr_kept."""
    return measures(docs, text).withColumn("_qr_base_failed", compile_rules(hard)).withColumn("_qr_kept", ~F.col("_qr_base_failed") & ~compile_rules(rules))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns.

    The row number in the test keeps the filter above the measures: pushed below them, it
    would spell each of them out again and again.
    """
    judged = apply_rules(docs).withColumn("_qr_go", F.col("_qr_kept") & (F.monotonically_increasing_id() >= 0))
    return judged.where("_qr_go").select(*[F.col(f"`{c}`") for c in docs.columns])
