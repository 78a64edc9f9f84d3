"""Names of media files as Column expressions: cleaning, part numbers, bracket tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinegraph.functions.text import BLANK, file_name, parent, raw_extension, stem, strip

#: Characters that names may not hold, and brackets of other scripts.
INVALID = r'[<>:"/\\|?*]'
WIDE_BRACKETS, BRACKETS = "【】［］「」『』（）", "[][][][]()"
#: What ends a name that is merged already, and how part numbers are written, in order.
MERGED = r"(?iU)(?:_part_|_pt_|_cd|_disc|\s)\d+to\d+\s*$"
PART_FORMS = (
    r"(?iU)^(.+?_part_)(\d+)$", r"(?iU)^(.+?_pt_)(\d+)$", r"(?iU)^(.+?_cd)(\d+)$", r"(?iU)^(.+?-cd)(\d+)$", r"(?iU)^(.+?_disc)(\d+)$", r"(?U)^(.+ )(\d+)$", r"(?U)^(.+-)(\d+)$",
)
#: Words that mark a bracket as a technical note.
METADATA_MARKERS = (
    "1080p", "720p", "2160p", "4k", "bluray", "webrip", "web-dl", "hdtv", "remux", "x264", "x265", "hevc", "aac", "dts",
    "english", "chinese", "subbed", "subtitles", "complete", "uncut", "director's cut", "directors cut",
)
#: One leading bracket of the five kinds, up to the first closer of its kind.
BRACKETED = r"\[[^\]]*\]|\([^)]*\)|（[^）]*）|【[^】]*】|［[^］]*］"
#: The words that a clean name leaves out, and what brackets are spaced by: a mark before an opening one, a mark after a closing one.
NOISE_WORDS = ("copy", "duplicate")
BEFORE_OPENING, AFTER_CLOSING = r"(?U)(?<=[^(\[\s])([(\[])", r"(?U)([)\]])(?=[^)\](\[\s])"
DIGITS_WIDE, DIGITS = "０１２３４５６７８９", "0123456789"


def standardize_stem(name: Column) -> Column:
    """A clean stem; the stripped original if nothing is left."""
    x = F.regexp_replace(strip(name), INVALID, "")
    copy_number = F.regexp_extract(x, rf"(?U)\({BLANK}*(\d+){BLANK}*\){BLANK}*$", 1)
    is_year = F.regexp_like(copy_number, F.lit(r"^(?:19|20)\d\d$"))
    x = strip(F.when((copy_number != "") & ~is_year, F.regexp_replace(x, rf"(?U)\({BLANK}*\d+{BLANK}*\){BLANK}*$", "")).otherwise(x))
    for word in NOISE_WORDS:
        x = F.regexp_replace(x, rf"(?iU)(?:^|{BLANK}){word}(?:{BLANK}|$)", " ")
    x = F.translate(x, WIDE_BRACKETS, BRACKETS)
    x = F.regexp_replace(x, BEFORE_OPENING, " $1")
    x = F.regexp_replace(x, AFTER_CLOSING, "$1 ")
    x = F.btrim(F.regexp_replace(x, rf"(?U){BLANK}+", " "), F.lit(" ."))
    return F.coalesce(F.nullif(x, F.lit("")), strip(name))


def standard_file_name(name: Column, ext: str = ".mp4") -> Column:
    return F.concat(standardize_stem(stem(name)), F.lit(ext))


def parse_part(stem_: Column) -> Column:
    """struct(prefix, suffix, part), or null if the stem is no part of a split file.

    The prefix of the first form that fits decides, and the number is what follows it; no prefix is empty, so an empty extract means no match.
    """
    prefix = F.coalesce(*[F.nullif(F.regexp_extract(stem_, p, 1), F.lit("")) for p in PART_FORMS])
    part = lambda p: F.translate(F.substr(stem_, F.length(p) + 1), DIGITS_WIDE, DIGITS).cast("decimal(38,0)")
    # the prefix is bound in a lambda, for its forms are tried wherever it is spelt out
    found = F.get(F.transform(F.array(prefix), lambda p: F.when(p.isNotNull(), F.struct(p.alias("prefix"), F.lit("").alias("suffix"), part(p).alias("part")))), F.lit(0))
    return F.when(F.regexp_like(stem_, F.lit(r"(?U)\d$")) & ~F.regexp_like(stem_, F.lit(MERGED)), found)


def is_metadata_tag(tag: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in METADATA_MARKERS]), lambda m: F.contains(F.lower(tag), m))


def _leading_brackets(stem_: Column) -> Column:
    """Texts inside the leading brackets, stripped, in order."""
    found = F.regexp_extract_all(stem_, F.lit(rf"(?U)\G\s*({BRACKETED})"), F.lit(1))
    return F.transform(found, lambda b: strip(F.substr(b, F.lit(2), F.length(b) - 2)))


def _peeled(stem_: Column) -> Column:
    """Leading brackets before the first empty one."""
    tags = _leading_brackets(stem_)
    empty = F.array_position(tags, "")
    return F.when(empty > 0, F.slice(tags, F.lit(1), (empty - 1).cast("int"))).otherwise(tags)


def leading_tag(stem_: Column) -> Column:
    """The first leading bracket that is no technical note; an empty one ends the search."""
    return F.try_element_at(F.filter(_peeled(stem_), lambda t: ~is_metadata_tag(t)), F.lit(1))


def title_without_tag(stem_: Column) -> Column:
    """The stem without its leading brackets, up to and with the first empty one; the stem if nothing is left."""
    tags = _leading_brackets(stem_)
    empty = F.array_position(tags, "").cast("int")
    count = F.when(empty > 0, empty).otherwise(F.size(tags))
    whole = F.regexp_extract_all(stem_, F.lit(rf"(?U)\G(\s*(?:{BRACKETED}))"), F.lit(1))
    taken = F.aggregate(F.slice(whole, F.lit(1), count), F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(F.nullif(strip(F.substr(stem_, taken + 1)), F.lit("")), strip(stem_))


def proposed_tagged_name(name: Column, tag: Column) -> Column:
    ext = raw_extension(name)
    return F.concat(F.lit("["), tag, F.lit("] "), title_without_tag(stem(name)), ext)


def is_untagged(stem_: Column) -> Column:
    return leading_tag(stem_).isNull()


def parse_part_file(path: Column) -> Column:
    """struct(path, parent, prefix, suffix, part) of a part file, or null. Parent, prefix and suffix are its group."""
    whole = lambda p: F.when(p.isNotNull(), F.struct(path.alias("path"), parent(path).alias("parent"), p["prefix"].alias("prefix"), p["suffix"].alias("suffix"), p["part"].alias("part")))
    return F.get(F.transform(F.array(parse_part(stem(file_name(path)))), whole), F.lit(0))


def merged_stem(prefix: Column, suffix: Column, first: Column, last: Column) -> Column:
    return standardize_stem(F.concat(prefix, first.cast("string"), F.lit("to"), last.cast("string"), suffix))


def numbered(name: Column, number: Column) -> Column:
    """The name itself for 1, else with __number before its ending."""
    ext = raw_extension(name)
    return F.when(number <= 1, name).otherwise(F.concat(stem(name), F.lit("__"), number.cast("string"), ext))


def compounded(name: Column, tries: Column) -> Column:
    """A name after so many collisions in the trash: each one adds its number to the name before (x, x__1, x__1__2)."""
    marks = F.when(tries > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(tries, F.lit(1))), lambda k: F.concat(F.lit("__"), k.cast("string"))), "")).otherwise("")
    return F.concat(stem(name), marks, raw_extension(name))
