"""What a file holds, by a probe: a program's JSON report, or a table that stands for it.

One probe a file answers everything: whether it can be read, its length, size of picture, bit rate and codecs of all
streams. The report is parsed by Spark, so a stored table of reports and a run of the program give the same columns.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "streams array<struct<codec_type:string,codec_name:string,width:string,height:string,bit_rate:string>>, format struct<duration:string,bit_rate:string>"
METADATA = ("width", "height", "bit_rate", "duration_sec", "video_codec", "audio_codec")
#: How the program is asked for the report.
PROBE_COMMAND = ("ffprobe", "-v", "error", "-show_entries", "stream=codec_type,codec_name,width,height,bit_rate:format=duration,bit_rate", "-of", "json")
SECONDS = 120


class MediaProbe(Protocol):
    def reports(self, files: DataFrame) -> DataFrame:
        """The files with a column probe: the JSON report, null where there is none."""


@dataclass
class TableProbe:
    """Reports that are known already. table: path, probe."""

    table: DataFrame

    def reports(self, files: DataFrame) -> DataFrame:
        return files.join(self.table.select("path", "probe"), "path", "left")


@dataclass
class ProgramProbe:
    """Runs the program once a file, on the executors; a missing program, a failure or a file that it cannot read gives null."""

    command: tuple[str, ...] = PROBE_COMMAND

    def reports(self, files: DataFrame) -> DataFrame:
        command = list(self.command)

        def ask(path: str | None) -> str | None:
            if path is None:
                return None
            try:
                return subprocess.run([*command, path], check=True, capture_output=True, timeout=SECONDS).stdout.decode("utf-8", "replace")
            except (OSError, subprocess.SubprocessError):
                return None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answers = pa.array([ask(p) for p in batch.column("path").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, answers], names=[*batch.schema.names, "probe"])

        return files.mapInArrow(work, files.selectExpr("*", "cast(null as string) as probe").schema)


def parsed(probe: Column) -> Column:
    return F.from_json(probe, REPORT)


def _first(report: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(F.coalesce(report["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string,width:string,height:string,bit_rate:string>>")), lambda s: s["codec_type"] == kind), F.lit(1))


def is_readable(probe: Column) -> Column:
    """Whether the report holds a video stream; false without a report."""
    return _first(parsed(probe), "video").isNotNull()


def duration_of(probe: Column) -> Column:
    return F.expr("try_cast(null as double)") if probe is None else parsed(probe)["format"]["duration"].try_cast("double")


def stream_codecs(probe: Column) -> tuple[Column, Column]:
    """Codec of the first video and of the first audio stream."""
    report = parsed(probe)
    return _first(report, "video")["codec_name"], _first(report, "audio")["codec_name"]


def with_metadata(files: DataFrame, probe: str = "probe") -> DataFrame:
    """The files with METADATA and readable instead of the report; numbers that are none are null."""
    report = files.withColumn("_report", parsed(F.col(probe))).withColumn("_video", _first(F.col("_report"), "video")).withColumn("_audio", _first(F.col("_report"), "audio"))
    rate = F.coalesce(F.nullif(F.col("_video.bit_rate"), F.lit("")), F.col("_report.format.bit_rate"))
    return report.select(
        *[F.col(f"`{c}`") for c in files.columns if c != probe and c not in (*METADATA, "readable")],
        F.col("_video.width").try_cast("int").alias("width"), F.col("_video.height").try_cast("int").alias("height"), rate.try_cast("bigint").alias("bit_rate"),
        F.when(F.col("_video").isNotNull(), F.col("_report.format.duration").try_cast("double")).alias("duration_sec"), F.col("_video.codec_name").alias("video_codec"), F.col("_audio.codec_name").alias("audio_codec"),
        F.col("_video").isNotNull().alias("readable"),
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height; null if either is null or 0."""
    return F.when((width != 0) & (height != 0), width / height)
