"""Text helpers that follow Unicode-aware rules on both sides of a dialect gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Java's class leaves out.
BLANK = r"[\s\x1c-\x1f\p{Z}\x85]"


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


def raw_extension(name: Column) -> Column:
    """The last extension as it is written, with its dot, or an empty text."""
    return F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1)


def extension(name: Column) -> Column:
    """The last extension in lower case with its dot, or an empty text."""
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to the nearest whole number, ties to even; both whole and not negative."""
    whole = F.floor(numerator / denominator).cast("bigint")
    rest = numerator - whole * denominator
    up = (2 * rest > denominator) | ((2 * rest == denominator) & (whole % 2 == 1))
    return whole + up.cast("bigint")
