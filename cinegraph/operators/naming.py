"""Names for new files that collide with none that exists and with none of each other, and the paths that conversions work at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.names import numbered
from cinegraph.functions.text import raw_extension, stem


def unique_names(planned: DataFrame, taken: DataFrame, order: list[str], parent: str = "parent", name: str = "name") -> DataFrame:
    """Adds unique_name: the name, or name__2, name__3 ... where it is taken; planned rows of one name get one each, in order.

    taken: parent, name of the files that exist. Only taken names of a planned name's own forms matter, and the free numbers of a name are
    among the first as many as its taken and its planned ones.
    """
    key = [parent, name]
    at = Window.partitionBy(*key)
    asked = planned.withColumn("_place", F.row_number().over(at.orderBy(*order)))
    forms = planned.select(*key).distinct().withColumn("_stem", stem(F.col(name))).withColumn("_ext", raw_extension(F.col(name)))
    ending = r"^(.*)__([1-9][0-9]{0,8})$"
    held = taken.select(parent, F.col(name).alias("_file")).distinct()
    number = F.try_to_number(F.regexp_extract(stem(F.col("_file")), ending, 2), F.lit("999999999")).cast("int")
    plain = held.select(parent, F.col("_file").alias(name), F.lit(1).alias("_number"))
    marked = held.where(F.regexp_like(stem(F.col("_file")), F.lit(ending))).select(parent, F.concat(F.regexp_extract(stem(F.col("_file")), ending, 1), raw_extension(F.col("_file"))).alias(name), number.alias("_number")).where("_number > 1")
    used = plain.unionByName(marked).join(forms.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_set("_number").alias("_used"))
    free = F.array_except(F.sequence(F.lit(1), F.col("_place") + F.size("_used")), F.col("_used"))
    out = asked.join(used, key, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    return out.withColumn("unique_name", numbered(F.col(name), F.element_at(free, F.col("_place")))).drop("_place", "_used")


def work_name(in_place: Column, exists: Column, target: Column, unique: Column, temporary: Column, keep_originals: Column) -> Column:
    """Where a conversion writes: beside its source if that has the target's name, at a free name if the target exists, else at the target.

    in_place: the source has the target's name; unique, temporary: free names for the target and for a hidden file beside it.
    """
    return F.when(in_place, F.when(keep_originals, unique).otherwise(temporary)).when(exists, unique).otherwise(target)


def temporary_name(tries: Column, ext: str = ".mp4") -> Column:
    """The hidden file that a conversion in place writes, after so many collisions."""
    return F.when(tries <= 0, F.lit(f".cinegraph_convert{ext}")).otherwise(F.concat(F.lit(".cinegraph_convert_"), tries.cast("string"), F.lit(ext)))
