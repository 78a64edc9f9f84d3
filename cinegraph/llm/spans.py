"""Native regex spans: matches of a pattern with their code-point offsets, in one expression.

A pattern's matches and the pieces between them, laid end to end, are the text;
so their lengths give the offsets, and a piece's end is a match's context. Patterns must be written so that no text
makes them backtrack far: a run is entered at its start only (look-behind or
the end of the last match, \\G) and taken whole (possessive).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: before: what stands right before the match, back to the match before it, at most CONTEXT characters.
SPAN = "struct<start:int,end:int,text:string,before:string>"
CONTEXT = 24
#: A span without its text.
PLAIN = "struct<kind:string,rank:int,start:int,end:int>"
#: Matches that are folded together; a fold copies its result at each step, so many matches are folded in chunks.
CHUNK = 256


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (start, end, text, before), leftmost and non-overlapping; guard: a cheap test that a match needs."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.substr(g, F.lit(-CONTEXT)).alias("b"), F.length(g).alias("g"), F.length(h).alias("n")))
    found = F.when(F.regexp_like(text, F.lit(pattern)), with_offsets(pairs)).otherwise(empty_spans())
    return found if guard is None else F.when(guard, found).otherwise(empty_spans())


def with_offsets(pairs: Column) -> Column:
    """(h, b, g, n): match, what is before it, length of the gap before it, its own length; to spans.

    Offsets are summed inside chunks, then over the chunks, so that a text of n matches takes n * CHUNK steps, not n squared.
    """
    span = lambda x, at: F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["text"].alias("text"), x["before"].alias("before"))

    def inside(acc, x):
        begin = acc["at"] + x["g"]
        one = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["h"].alias("text"), x["b"].alias("before"))
        return F.struct((begin + x["n"]).alias("at"), F.array_append(acc["out"], one).alias("out"))

    def over(acc, chunk):
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.array_append(acc["out"], F.transform(chunk["out"], lambda x: span(x, acc["at"]))).alias("out"))

    summed = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("at"), empty_spans().alias("out")), inside)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.flatten(F.aggregate(F.transform(_chunks(pairs), summed), start, over)["out"])


def let(value: Column, body) -> Column:
    """body(value), with the value computed once; a column that a lambda names is computed at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column) -> Column:
    return let(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))))


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: two passes in order of place, so that many of both cost no products.

    The spans of either side may overlap among themselves. Both are arrays of PLAIN.
    """
    weak = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("weak"), s["end"].alias("end"), s.cast(PLAIN).alias("own")))
    firm = F.transform(others, lambda s: F.struct(s["start"].alias("at"), F.lit(0).alias("weak"), s["end"].alias("end"), F.lit(None).cast(PLAIN).alias("own")))

    def after(acc, x):  # ends of the others before it
        kept = F.when((x["weak"] == 1) & (x["at"] >= acc["edge"]), F.array_append(acc["out"], x)).otherwise(acc["out"])
        return F.struct(F.when(x["weak"] == 0, F.greatest(acc["edge"], x["end"])).otherwise(acc["edge"]).alias("edge"), kept.alias("out"))

    def before(acc, x):  # starts of the others after it
        kept = F.when((x["weak"] == 1) & (x["end"] <= acc["edge"]), F.array_append(acc["out"], x)).otherwise(acc["out"])
        return F.struct(F.when(x["weak"] == 0, F.least(acc["edge"], x["at"])).otherwise(acc["edge"]).alias("edge"), kept.alias("out"))

    none = F.array().cast(f"array<struct<at:int,weak:int,end:int,own:{PLAIN}>>")
    # at one place the others come first; in the second pass, from the end, they come last, as the first pass has dealt with them
    first = _fold_chunks(F.sort_array(F.concat(firm, weak)), -1, none, after)
    second = _fold_chunks(F.reverse(F.sort_array(F.concat(firm, first))), 2**31 - 1, none, before)
    return F.when(F.size(spans) > 0, F.transform(F.reverse(second), lambda s: s["own"])).otherwise(spans)


def _fold_chunks(items: Column, edge: int, none: Column, step) -> Column:
    """What the steps put out, with their edge carried from chunk to chunk; a step copies a chunk's result only."""

    def one(acc, chunk):
        folded = F.aggregate(chunk, F.struct(acc["edge"].alias("edge"), none.alias("out")), step)
        return let(folded, lambda f: F.struct(f["edge"].alias("edge"), F.array_append(acc["out"], f["out"]).alias("out")))

    start = F.struct(F.lit(edge).alias("edge"), F.array().cast(f"array<array<struct<at:int,weak:int,end:int,own:{PLAIN}>>>").alias("out"))
    return F.flatten(F.aggregate(_chunks(items), start, one)["out"])


def digest_text(spans: Column, order_by_kind: bool) -> Column:
    """kind:start:end joined by commas. spans: array of (kind, rank, start, end, ...)."""
    first, second = ("rank", "start") if order_by_kind else ("start", "rank")
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["end"].alias("end"), s["start"].alias("start"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
