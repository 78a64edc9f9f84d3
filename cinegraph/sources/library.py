"""A directory tree of videos as a Spark data source.

Folders are walked by the executors: each folder below the root is a partition of its own, and the root's own files are
one more. Names that begin with a dot and symbolic links are skipped, a folder that cannot be read is skipped with a
warning, and a root that is missing or no folder gives no rows.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cinegraph.functions.text import extension

#: The file endings of videos.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".mpg", ".mpeg")
FILES = "path string, parent string, name string, extension string, size_bytes long, mtime_ns long"
REPORT = "folders long, files long, videos long, bytes long, unreadable long"

log = logging.getLogger(__name__)


def is_video(name: Column) -> Column:
    return extension(name).isin(*VIDEO_EXTENSIONS)


def is_hidden(path: Column) -> Column:
    """Whether a part of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda part: F.startswith(part, F.lit(".")))


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all below it, or its own files only


def _listed(folder: str) -> list[os.DirEntry] | None:
    try:
        with os.scandir(folder) as entries:
            return [e for e in entries if not e.name.startswith(".") and not e.is_symlink()]
    except OSError as problem:
        log.warning("Cannot read %s: %s", folder, problem)
        return None


class LibraryReader(DataSourceReader):
    def __init__(self, root: str, report: bool):
        self.root, self.report = os.path.realpath(os.path.expanduser(root)), report

    def partitions(self) -> list[Folder]:
        if not os.path.isdir(self.root):
            log.error("The root of the library is missing or no folder: %s", self.root)
            return []
        entries = _listed(self.root) or []
        return [Folder(self.root, False), *[Folder(e.path, True) for e in entries if e.is_dir()]]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # no folder to read
            return
        folders = files = videos = size = unreadable = 0
        waiting = [partition.path]
        while waiting:
            folder = waiting.pop()
            folders += 1
            entries = _listed(folder)
            if entries is None:
                unreadable += 1
                continue
            for e in entries:
                if e.is_dir():
                    if partition.deep:
                        waiting.append(e.path)
                    continue
                if not e.is_file():
                    continue
                files += 1
                ending = os.path.splitext(e.name)[1].lower()
                if ending not in VIDEO_EXTENSIONS:
                    continue
                try:
                    facts = e.stat()
                except OSError:
                    continue
                videos, size = videos + 1, size + facts.st_size
                if not self.report:
                    yield (e.path, folder, e.name, ending, facts.st_size, facts.st_mtime_ns)
        if self.report:
            yield (folders, files, videos, size, unreadable)


class LibrarySource(DataSource):
    """spark.read.format("media_library").load(root); option report gives counts instead of files."""

    @classmethod
    def name(cls) -> str:
        return "media_library"

    def _report(self) -> bool:
        return str(self.options.get("report", "false")).lower() == "true"

    def schema(self) -> str:
        return REPORT if self._report() else FILES

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options["path"], self._report())


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """One row a video below the root."""
    spark.dataSource.register(LibrarySource)
    return spark.read.format("media_library").load(root)


def scan_report(spark: SparkSession, root: str) -> DataFrame:
    """One row: folders and files seen, videos found, their bytes, and folders that could not be read."""
    spark.dataSource.register(LibrarySource)
    found = spark.read.format("media_library").option("report", "true").load(root)
    return found.agg(*[F.coalesce(F.sum(c.split()[0]), F.lit(0)).alias(c.split()[0]) for c in REPORT.split(", ")])
