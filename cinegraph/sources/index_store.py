"""The index as a stored table: Parquet in a folder of its own for each version, and one small file that names the current one.

A save writes a new version beside the old one and then replaces the pointer, so that a reader sees either the old or the new
index. A pointer that is missing, unreadable, of another format or of another library gives an empty index.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format of the stored index.
FORMAT = 1
#: The fields of a record, as they are kept and as a JSON export names them.
RECORD = (
    "path string, quick_fingerprint string, content_fingerprint string, exact_hash string, duration_sec double, width int, height int, bit_rate bigint, "
    "video_codec string, audio_codec string, perceptual_hashes array<string>, perceptual_num_frames int, updated_at string"
)
FRAMES = 15

log = logging.getLogger(__name__)


def index_folder(root: str) -> str:
    return f"{root.rstrip('/')}/.cinegraph"


def pointer_path(root: str) -> str:
    return f"{index_folder(root)}/index.json"


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def decode_records(records: DataFrame) -> DataFrame:
    """Rows of RECORD with defaults for what is missing; rows without a path are no records."""
    have = set(records.columns)
    columns = []
    for field in RECORD.split(", "):
        name, kind = field.split(" ")
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        default = {"quick_fingerprint": F.lit(""), "content_fingerprint": F.lit(""), "perceptual_hashes": F.array().cast("array<string>"), "perceptual_num_frames": F.lit(FRAMES), "updated_at": F.lit("")}.get(name)
        columns.append((F.coalesce(value, default) if default is not None else value).alias(name))
    return records.select(*columns).where("path is not null")


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _files(spark, path)
    if not fs.exists(p):
        return None
    try:
        return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    except Exception as problem:  # noqa: BLE001 - whatever the store says, an index that cannot be read is built anew
        log.warning("Cannot read %s: %s", path, problem)
        return None


def load_index(spark: SparkSession, root: str, rebuild: bool = False) -> DataFrame:
    text = None if rebuild else _read_text(spark, pointer_path(root))
    try:
        pointer = json.loads(text) if text else {}
    except ValueError:
        pointer = {}
    if not isinstance(pointer, dict) or pointer.get("format") != FORMAT or pointer.get("root") != root or not pointer.get("data"):
        return empty_index(spark)
    p, fs = _files(spark, f"{index_folder(root)}/{pointer['data']}")
    return decode_records(spark.read.parquet(p.toString())) if fs.exists(p) else empty_index(spark)


def save_index(index: DataFrame, root: str) -> str:
    """Writes a new version, points to it and returns its folder. The version before it is kept, for readers that are at it."""
    spark = index.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    decode_records(index).write.parquet(f"{index_folder(root)}/{name}")
    new, fs = _files(spark, f"{pointer_path(root)}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"format": FORMAT, "root": root, "data": name}, sort_keys=True).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    now = jvm.org.apache.hadoop.fs.Path(pointer_path(root))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, now, overwrite)
    return name


def import_json(spark: SparkSession, path: str, root: str, version: int = 1) -> DataFrame:
    """Records of a JSON file {version, root, videos: {path: record}}; empty if it is missing, bad, or of another version or root."""
    if _read_text(spark, path) is None:
        return empty_index(spark)
    fields = ", ".join(f"{f.split(' ')[0]}:{f.split(' ')[1]}" for f in RECORD.split(", "))
    payload = spark.read.text(path, wholetext=True).select(F.from_json("value", f"version int, root string, videos map<string,struct<{fields}>>").alias("p"))
    good = payload.where((F.col("p.version") == version) & (F.col("p.root") == root))
    return decode_records(good.select(F.explode("p.videos").alias("key", "r")).select("r.*"))


def export_json(index: DataFrame, path: str, root: str, version: int = 1) -> None:
    """Records as JSON lines under path, with the envelope's fields in each line; sorted by path."""
    lines = decode_records(index).orderBy("path").select(F.lit(version).alias("version"), F.lit(root).alias("root"), F.struct("*").alias("video"))
    lines.write.mode("overwrite").json(path)
