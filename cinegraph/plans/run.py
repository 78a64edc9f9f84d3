"""A run over a library: scan, index, the phases' plans, their commits and the summary."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.config import RunConfig
from cinegraph.operators import media_index
from cinegraph.operators.components import written
from cinegraph.plans import actions
from cinegraph.plans.commit import Committer, run_command
from cinegraph.sources.digest import collect_digests
from cinegraph.sources.frames import FrameSource, ProgramFrames, collect_signatures, hash_to_hex
from cinegraph.sources.index_store import empty_index, load_index, save_index
from cinegraph.sources.library import scan_library
from cinegraph.sources.probe import MediaProbe, ProgramProbe, is_readable

log = logging.getLogger(__name__)


@dataclass
class Run:
    """What a run found and did: files at the start and end, the plan and the results of each phase, and the index."""

    files: DataFrame
    index: DataFrame
    plans: dict[str, DataFrame] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)
    left: DataFrame | None = None

    def plan(self) -> DataFrame:
        parts = list(self.plans.values())
        whole = self.files.sparkSession.createDataFrame([], actions.ACTION)
        for p in parts:
            whole = whole.unionByName(p)
        return whole

    def summary(self) -> DataFrame:
        """phase, op, actions, bytes: of the results where there are some, of the plans else."""
        rows = None
        for phase, plan in self.plans.items():
            if phase in self.results:
                one = self.results[phase].where("ok").groupBy("phase", "op").agg(F.count("*").alias("actions"), F.sum("bytes").alias("bytes"))
            else:
                one = actions.summary(plan)
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.files.sparkSession.createDataFrame([], "phase string, op string, actions bigint, bytes bigint")


def describe(files: DataFrame, index: DataFrame, probe: MediaProbe, frames: FrameSource, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """The files with all that the plans read, and the index with what was found out; unchanged files come from the index."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pruned = media_index.prune(index, files)
    known = written(media_index.ensure_metadata(pruned, files, probe, force=config.rebuild, stamp=now))
    facts = files.select("path", "size_bytes").join(known, "path")
    need_digest, need_signature = "exact" in config.phases(), bool({"perceptual", "tags"} & set(config.phases()))
    updates = facts.select("path")
    if need_digest:
        updates = updates.join(collect_digests(facts, known, not config.rebuild), "path", "left")
    if need_signature:
        found = collect_signatures(facts, known, frames, config.frames, not config.rebuild)
        updates = updates.join(found.select("path", F.transform("signature", hash_to_hex).alias("perceptual_hashes"), F.col("frames").alias("perceptual_num_frames")), "path", "left")
    full = written(media_index.upsert(known, updates))
    signature = F.transform("perceptual_hashes", lambda h: F.conv(h, 16, -10).cast("bigint"))
    described = probe.reports(files.select("path")).select("path", is_readable(F.col("probe")).alias("readable"))
    rows = files.select("path", "size_bytes").join(full, "path").join(described, "path").withColumn("signature", signature)
    return rows.select(*[f.split(" ")[0] for f in actions.FILE.split(", ")]), full


def plan_phase(phase: str, files: DataFrame, config: RunConfig, taken: DataFrame) -> DataFrame:
    t = config.tagging
    make: dict[str, Callable[[], DataFrame]] = {
        "exact": lambda: actions.plan_exact(files),
        "perceptual": lambda: actions.plan_perceptual(files, config.threshold, config.tolerance, config.good_ratio),
        "standardize": lambda: actions.plan_standardize(files, taken, config.keep_originals),
        "merge": lambda: actions.plan_merge(files),
        "tags": lambda: actions.plan_tags(files, t.min_samples, t.threshold, t.apply),
    }
    return make[phase]()


def plan_run(files: DataFrame, config: RunConfig, decisions: DataFrame | None = None) -> Run:
    """The plans of all phases without touching a file; each sees the files that those before it would leave."""
    run = Run(files, empty_index(files.sparkSession))
    left = files
    for phase in config.phases():
        plan = run.plans[phase] = written(actions.decide(plan_phase(phase, left, config, left), decisions))
        left = written(actions.remaining(left, plan))
    run.left = left
    return run


def run_library(spark: SparkSession, config: RunConfig, probe: MediaProbe | None = None, frames: FrameSource | None = None, decisions: DataFrame | None = None, execute: Callable[[list[str]], bool] = run_command) -> Run:
    """Scans the library, plans each phase and, unless the run is dry, commits it before the next one is planned.

    A committed phase counts what succeeded: files whose move failed stay in the run. The index is saved unless the run is dry.
    """
    if config.problems():
        raise ValueError("; ".join(config.problems()))
    probe, frames = probe or ProgramProbe(), frames or ProgramFrames()
    index = load_index(spark, config.root, config.rebuild)
    scanned = written(scan_library(spark, config.root))
    files, index = describe(scanned, index, probe, frames, config)
    files = written(files)
    if config.dry_run:
        run = plan_run(files, config, decisions)
        run.index = index
        return run
    run, left, committer = Run(files, index), files, Committer(config, execute)
    for phase in config.phases():
        plan = run.plans[phase] = written(actions.decide(plan_phase(phase, left, config, left), decisions))  # planned before anything moves
        run.results[phase] = written(committer.commit(plan))
        done = plan.join(run.results[phase].where("ok").select("phase", "op", "group_id", F.col("src").alias("_src"), F.col("dst").alias("_dst")), ["phase", "op", "group_id"]).where(F.col("src").eqNullSafe(F.col("_src")))
        applied = done.withColumn("dst", F.when(F.col("op") == "trash", F.col("dst")).otherwise(F.col("_dst"))).drop("_src", "_dst")
        left = written(actions.remaining(left, applied))
    run.left = left
    rescanned = written(scan_library(spark, config.root))
    run.index = media_index.ensure_metadata(media_index.prune(index, rescanned), rescanned, probe)
    save_index(run.index, config.root)
    return run
