"""The command line: options to a run, and a run to lines of text."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from cinegraph.config import Encoding, RunConfig, Tagging

#: Exit codes: done, a scan that failed, options that cannot be, an interrupt.
DONE, FAILED, BAD_OPTIONS, INTERRUPTED = 0, 1, 2, 130


def setup_logging(log_file: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        handlers.append(logging.FileHandler(log_file, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)


def parser() -> argparse.ArgumentParser:
    d, p = RunConfig(""), argparse.ArgumentParser(prog="cinegraph", description="Finds duplicates, standardizes, joins and tags the videos below a folder.")
    p.add_argument("--path", required=True, help="folder of the library")
    p.add_argument("--dry-run", action="store_true", help="show the plan, change nothing")
    p.add_argument("--threshold", type=float, default=d.threshold, help="average distance of frames that look alike")
    p.add_argument("--keep-originals", action="store_true", help="leave the sources of conversions where they are")
    p.add_argument("--crf", type=int, default=d.encoding.crf, help="quality of encodings, 1 to 51")
    p.add_argument("--preset", default=d.encoding.preset, help="speed of encodings")
    p.add_argument("--max-file-size-mb", type=float, default=d.encoding.budget_mb, help="size budget of a file; 0 for none")
    p.add_argument("--log-file", help="write the log to this file too")
    p.add_argument("--rebuild-cache", action="store_true", help="start from an empty index")
    p.add_argument("--suggest-tags", action="store_true", help="suggest bracket tags")
    p.add_argument("--apply-tags", action="store_true", help="rename by the suggestions")
    p.add_argument("--tag-min-samples", type=int, default=d.tagging.min_samples, help="files that make a tag's profile")
    p.add_argument("--tag-threshold", type=float, default=d.tagging.threshold, help="distance of a suggestion")
    only = p.add_mutually_exclusive_group()
    only.add_argument("--tags-only", dest="mode", action="store_const", const="tags", default="all")
    only.add_argument("--standardize-only", dest="mode", action="store_const", const="standardize", help="standardize; joins parts too, unless that is skipped")
    only.add_argument("--combine-parts-only", dest="mode", action="store_const", const="combine")
    p.add_argument("--skip-combine-parts", action="store_true", help="do not join split parts")
    return p


def config_of(a: argparse.Namespace) -> RunConfig:
    return RunConfig(
        os.path.realpath(os.path.expanduser(a.path)), a.mode, a.dry_run, a.rebuild_cache, a.keep_originals, not a.skip_combine_parts, a.threshold,
        encoding=Encoding(a.crf, a.preset, a.max_file_size_mb), tagging=Tagging(a.suggest_tags, a.apply_tags, a.tag_min_samples, a.tag_threshold),
    )


def main(argv: list[str] | None = None, spark=None, **sources) -> int:
    args = parser().parse_args(argv)  # exits with BAD_OPTIONS by itself
    setup_logging(args.log_file)
    config = config_of(args)
    problems = config.problems() + ([] if os.path.isdir(config.root) else [f"no such folder: {config.root}"])
    if problems:
        print("\n".join(problems), file=sys.stderr)
        return BAD_OPTIONS
    from cinegraph.plans.run import run_library

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("cinegraph").getOrCreate()
    from cinegraph.session import ship_package

    ship_package(spark)
    try:
        run = run_library(spark, config, **sources)
        for row in run.plan().orderBy("phase", "group_id", "op").toLocalIterator():
            print(f"{row['phase']:12} {row['op']:8} {row['src'] or ' + '.join(row['sources'])} -> {row['dst']} ({row['reason']})")
        for row in run.summary().orderBy("phase", "op").collect():
            print(f"{row['phase']:12} {row['op']:8} {row['actions']} actions, {row['bytes']} bytes")
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception:
        logging.getLogger(__name__).exception("the run failed")
        return FAILED
    return DONE


if __name__ == "__main__":
    sys.exit(main())
