"""Plans: what a run would do, as rows. Nothing here changes a file.

Each phase reads the files that the phases before it leave, and gives actions. An action is approved unless a decision says
otherwise; decisions are rows too, by phase and group, and can name another file to keep. A dry run is a plan that is not committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegraph.functions.formats import format_bitrate, format_duration, format_size
from cinegraph.functions.names import leading_tag, proposed_tagged_name, standard_file_name
from cinegraph.functions.text import extension, file_name, parent, stem
from cinegraph.operators.components import connected_components
from cinegraph.operators.conversion import TARGET_EXT, needs_container_or_codec, needs_conversion, remuxes
from cinegraph.operators.duplicates import keep_or_remove, quality_score, rank_for_keep, safe_size
from cinegraph.operators.naming import unique_names
from cinegraph.operators.parts import merge_groups
from cinegraph.operators.similarity import GOOD_RATIO, THRESHOLD, TOLERANCE, similar_links
from cinegraph.operators.tags import MIN_SAMPLES, TAG_THRESHOLD, suggest_tags
from cinegraph.sources.probe import aspect_ratio

ACTION = "phase string, op string, group_id string, src string, sources array<string>, dst string, size_bytes bigint, reason string, approved boolean"
#: What a plan reads of a file; others are carried along.
FILE = "path string, size_bytes bigint, duration_sec double, width int, height int, bit_rate bigint, video_codec string, audio_codec string, readable boolean, exact_hash string, signature array<bigint>"


def _actions(rows: DataFrame, phase: str, op: Column, group_id: Column, src: Column, sources: Column, dst: Column, size: Column, reason: Column, approved: Column | bool = True) -> DataFrame:
    approved = F.lit(approved) if isinstance(approved, bool) else approved
    values = (F.lit(phase), op, group_id.cast("string"), src, sources, dst, size.cast("bigint"), reason, approved)
    return rows.select(*[v.alias(f.split(" ")[0]) for v, f in zip(values, ACTION.split(", "), strict=True)])


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def plan_exact(files: DataFrame) -> DataFrame:
    """Copies with the digest of another file go; the one with the cleanest name stays."""
    copies = keep_or_remove(files, "exact_hash").where("path <> keep")
    return _actions(copies, "exact", F.lit("trash"), F.col("exact_hash"), F.col("path"), _none("array<string>"), F.col("keep"), safe_size(F.col("size_bytes")), F.lit("same content as the file that is kept"))


def rank_groups(files: DataFrame, groups: DataFrame) -> DataFrame:
    """files of the groups (path, group_id) with rank (1 is recommended) and the group's median duration."""
    scored = files.join(groups, "path").withColumn("_q", quality_score(F.col("width"), F.col("height"), F.col("bit_rate"), F.col("duration_sec"))).withColumn("_pixels", F.col("_q.pixels")).withColumn("_rate", F.col("_q.bit_rate")).withColumn("_size", safe_size(F.col("size_bytes"))).withColumn("_low", F.lower("path"))
    return rank_for_keep(scored, "group_id", ["_low", "path"], "_pixels", "_rate", "duration_sec", "_size").drop("_q", "_pixels", "_rate", "_size", "_low")


def plan_perceptual(files: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, good_ratio: float = GOOD_RATIO) -> DataFrame:
    """Of each group of files that look alike, by links of pairs, the best stays. keep actions show the ranking; they change nothing."""
    pairs = similar_links(files, "path", "duration_sec", "signature", threshold, tolerance, good_ratio)
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("path"), F.col("component").alias("group_id"))
    ranked = rank_groups(files, groups).withColumn("_keep", F.first("path").over(Window.partitionBy("group_id").orderBy("rank")))
    op = F.when(F.col("rank") == 1, "keep").otherwise("trash")
    return _actions(ranked, "perceptual", op, F.col("group_id"), F.col("path"), _none("array<string>"), F.col("_keep"), safe_size(F.col("size_bytes")), F.concat(F.lit("rank "), F.col("rank").cast("string")))


def plan_standardize(files: DataFrame, taken: DataFrame | None = None, keep_originals: bool = False) -> DataFrame:
    """Renames and conversions to the standard name and format; files that must be converted and cannot be read are skipped, with a reason."""
    taken = files if taken is None else taken
    name, ext = F.col("name"), F.col("_ext")
    rows = files.withColumn("parent", parent(F.col("path"))).withColumn("name", file_name(F.col("path"))).withColumn("_ext", extension(F.col("path")))
    codecs = (F.coalesce("readable", F.lit(False)), ext, F.col("video_codec"), F.col("audio_codec"))
    work = rows.withColumn("_work", needs_container_or_codec(*codecs)).where(needs_conversion(name, *codecs) | F.col("_work")).withColumn("_old", name).withColumn("name", standard_file_name(name, TARGET_EXT))
    held = taken.select(parent(F.col("path")).alias("parent"), file_name(F.col("path")).alias("name"))
    in_place = F.col("_old") == F.col("name")
    # a file that is converted in place gives its own name free
    placed = work.where(in_place & ~F.lit(keep_originals)).withColumn("unique_name", name).unionByName(unique_names(work.where(~in_place | F.lit(keep_originals)), held, ["path"]))
    unreadable = F.col("_work") & ~codecs[0]
    op = F.when(unreadable, "skip").when(~F.col("_work"), "rename").when(remuxes(*codecs[1:]), "remux").otherwise("convert")
    reason = F.when(unreadable, "cannot be read").when(~F.col("_work"), "name is not standard").when(remuxes(*codecs[1:]), "container is not standard").otherwise("codecs are not standard")
    dst = F.concat_ws("/", "parent", "unique_name")
    return _actions(placed, "standardize", op, F.col("path"), F.col("path"), _none("array<string>"), dst, safe_size(F.col("size_bytes")), reason, ~unreadable)


def plan_merge(files: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Runs of split parts to one file each; a run with a part that cannot be read is skipped."""
    groups = merge_groups(files.withColumn("readable", F.coalesce("readable", F.lit(False))), tolerance).withColumn("name", F.col("merged"))
    held = files.select(parent(F.col("path")).alias("parent"), file_name(F.col("path")).alias("name"))
    placed = unique_names(groups, held, ["prefix", "suffix", "start_part"])
    whole = F.size("unreadable") == 0
    reason = F.when(whole, F.concat(F.col("n_parts").cast("string"), F.lit(" parts, "), format_duration(F.col("total_duration")))).otherwise(F.concat(F.lit("cannot be read: "), F.array_join(F.transform("unreadable", file_name), ", ")))
    dst = F.concat_ws("/", "parent", "unique_name")
    return _actions(placed, "merge", F.when(whole, "merge").otherwise("skip"), dst, _none("string"), F.col("sources"), dst, safe_size(F.col("size_bytes")), reason, whole)


def plan_tags(files: DataFrame, min_samples: int = MIN_SAMPLES, threshold: float = TAG_THRESHOLD, apply: bool = False) -> DataFrame:
    """Renames that put the suggested tag before the title. Without enough tagged files in all there are none."""
    tagged = files.withColumn("name", file_name(F.col("path"))).withColumn("tag", leading_tag(stem(F.col("name")))).withColumn("duration", F.col("duration_sec")).withColumn("aspect", aspect_ratio(F.col("width"), F.col("height")))
    enough = tagged.where("tag is not null").count() >= min_samples
    found = suggest_tags(tagged.select("path", "tag", "signature", "duration", "aspect").where(F.lit(enough)), min_samples, threshold)
    rows = found.join(tagged.select("path", "name", "size_bytes"), "path").withColumn("parent", parent(F.col("path"))).withColumn("_old", F.col("name")).withColumn("name", proposed_tagged_name(F.col("name"), F.col("tag")))
    placed = unique_names(rows, tagged.select(parent(F.col("path")).alias("parent"), "name"), ["path"])
    reason = F.concat(F.lit("confidence "), F.col("confidence"), F.lit(", distance "), F.format_number("distance", 1), F.lit(", fit "), F.format_number("fit", 2), F.lit(", from "), F.col("sample_count").cast("string"))
    return _actions(placed, "tags", F.lit("rename" if apply else "suggest"), F.col("tag"), F.col("path"), _none("array<string>"), F.concat_ws("/", "parent", "unique_name"), safe_size(F.col("size_bytes")), reason)


def decide(plan: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """The plan with the decisions (phase, group_id, approve, keep) taken. keep names the file of a group that stays instead; null leaves it.

    Actions without a decision stay as they are; what cannot be done is not approved by a decision.
    """
    if decisions is None:
        return plan
    d = decisions.select("phase", "group_id", F.col("approve").alias("_approve"), F.col("keep").alias("_keep"))
    joined = plan.join(d, ["phase", "group_id"], "left")
    other = F.col("_keep").isNotNull() & F.col("op").isin("trash", "keep")
    op = F.when(other, F.when(F.col("src") == F.col("_keep"), "keep").otherwise("trash")).otherwise(F.col("op"))
    out = joined.withColumn("op", op).withColumn("dst", F.when(other, F.col("_keep")).otherwise(F.col("dst"))).withColumn("approved", F.col("approved") & F.coalesce("_approve", F.lit(True)))
    return out.select(*[f.split(" ")[0] for f in ACTION.split(", ")])


def removed(plan: DataFrame) -> DataFrame:
    """path of the files that the approved actions take away, each once."""
    acts = plan.where("approved")
    single = acts.where(F.col("op").isin("trash", "rename", "convert", "remux") & (F.col("src") != F.col("dst"))).select(F.col("src").alias("path"))
    return single.union(acts.where("op = 'merge'").select(F.explode("sources").alias("path"))).distinct()


def created(plan: DataFrame) -> DataFrame:
    """path, size_bytes of the files that the approved actions make; the planned size of their sources."""
    return plan.where("approved and op in ('rename', 'convert', 'remux', 'merge') and (src is null or src <> dst)").select(F.col("dst").alias("path"), "size_bytes")


def remaining(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The files after the plan: without those that it takes away, with those that it makes; what is unknown of these is null."""
    left = files.join(removed(plan), "path", "left_anti")
    return left.unionByName(created(plan).join(_carried(files, plan), "path", "left"), allowMissingColumns=True).select(*files.columns)


def _carried(files: DataFrame, plan: DataFrame) -> DataFrame:
    """What a renamed or converted file keeps of its source."""
    moved = plan.where("approved and op in ('rename', 'convert', 'remux') and src <> dst").select(F.col("src").alias("path"), F.col("dst").alias("_dst"))
    return files.drop("size_bytes").join(moved, "path").drop("path").withColumnRenamed("_dst", "path")


def summary(plan: DataFrame) -> DataFrame:
    """phase, op, actions, bytes of what is approved."""
    return plan.where("approved").groupBy("phase", "op").agg(F.count("*").alias("actions"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def file_label(path: Column, size: Column, duration: Column, width: Column, height: Column, bit_rate: Column) -> Column:
    """How a file is shown in a list."""
    picture = F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise("unknown resolution")
    return F.concat(file_name(path), F.lit(" ("), F.concat_ws(", ", picture, format_bitrate(bit_rate), format_duration(duration), format_size(size)), F.lit(")"))


def group_label(sources: Column) -> Column:
    """How a run of parts is shown."""
    return F.array_join(F.transform(sources, file_name), " + ")
