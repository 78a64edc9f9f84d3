"""Sizes, durations and bit rates as text, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegraph.functions.text import half_even

UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def format_size(n: Column) -> Column:
    """0 B for null; whole bytes below 1024, else two decimals."""
    n = F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint"))
    sign, size = F.when(n < 0, "-").otherwise(""), F.abs(n)
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS, 1):
        unit_size = F.lit(1024**k)
        # a hundred times the rest of an exabyte is no bigint: the rest and the unit are halved by 2^10 each, which loses less than a tie can see
        cents = half_even((size % unit_size) * 100, unit_size) if k < 6 else half_even(F.shiftright(size % unit_size, 10) * 100, F.lit(1024**k >> 10))
        total = F.floor(size / unit_size).cast("bigint") * 100 + cents
        text = F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = F.when(size >= unit_size, text).otherwise(out)
    return F.concat(sign, out)


def format_duration(s: Column) -> Column:
    t = F.bround(s.cast("double")).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    known = F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))
    return F.when(s.isNull() | (s <= 0), "unknown duration").otherwise(known)


def format_bitrate(bps: Column) -> Column:
    b = bps.cast("bigint")
    tenths, kilo = half_even(b, F.lit(100_000)), half_even(b, F.lit(1000))
    return F.when(b.isNull() | (b == 0), "unknown bitrate").when(b >= 1_000_000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" Mbps"))).otherwise(F.concat(kilo.cast("string"), F.lit(" Kbps")))
