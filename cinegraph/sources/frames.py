"""Perceptual signatures: frames at even places of a video, hashed by the low frequencies of their cosine transform."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAMES = 15
#: Fixed values of the standard perceptual hash: pixels of a side, and of the low block that is kept.
SIDE, LOW = 32, 8
SECONDS = 120


def frame_offsets(duration: Column, frames: int = FRAMES) -> Column:
    """Seconds of evenly spaced frames on 10 % to 90 % of a length, the middle for one frame; empty without a length."""
    none = F.array().cast("array<double>")
    if frames <= 0:
        return F.when(F.lit(True), none)
    start, end = duration * 0.1, duration * 0.9
    places = F.array((start + end) / 2) if frames == 1 else F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: start + (end - start) / (frames - 1) * i)
    return F.when(duration > 0, places).otherwise(none)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def phash(gray: np.ndarray) -> np.ndarray:
    """64-bit hashes (as signed integers) of pictures (n, SIDE, SIDE): which low frequencies are above their median."""
    c = _cosines()
    low = np.einsum("ux,nxy,vy->nuv", c, np.asarray(gray, np.float64), c).reshape(len(gray), LOW * LOW)
    bits = low > np.median(low, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def hash_to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hex_to_hash(h: Column) -> Column:
    return F.conv(h, 16, -10).cast("bigint")


class FrameSource(Protocol):
    def frames(self, path: str, offsets: list[float]) -> list[np.ndarray]:
        """Grey pictures (SIDE, SIDE) at the offsets; those that cannot be had are left out."""


@dataclass
class ProgramFrames:
    """Decodes with a program; one run a frame, raw grey pixels from its output."""

    program: str = "ffmpeg"

    def command(self, path: str, at: float) -> list[str]:
        return [self.program, "-v", "error", "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-vf", f"scale={SIDE}:{SIDE},format=gray", "-f", "rawvideo", "-"]

    def frames(self, path: str, offsets: list[float]) -> list[np.ndarray]:
        found = []
        for at in offsets:
            try:
                raw = subprocess.run(self.command(path, at), check=True, capture_output=True, timeout=SECONDS).stdout
            except FileNotFoundError:
                break
            except (OSError, subprocess.SubprocessError):
                continue
            if len(raw) >= SIDE * SIDE:
                found.append(np.frombuffer(raw, np.uint8, SIDE * SIDE).reshape(SIDE, SIDE))
        return found


def signatures(files: DataFrame, source: FrameSource, frames: int = FRAMES) -> DataFrame:
    """path, signature (array of long), frames for each file (path, duration_sec); no row for files without a frame."""
    wanted = files.select("path", frame_offsets(F.col("duration_sec"), frames).alias("offsets")).where(F.size("offsets") > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = [], []
            for path, offsets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pictures = source.frames(path, offsets)
                if pictures:
                    paths.append(path)
                    found.append(phash(np.stack(pictures)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array([frames] * len(paths), pa.int32())], names=["path", "signature", "frames"])

    return wanted.mapInArrow(work, "path string, signature array<long>, frames int")


def collect_signatures(files: DataFrame, index: DataFrame, source: FrameSource, frames: int = FRAMES, use_cache: bool = True) -> DataFrame:
    """path, signature, frames: from the index where it still holds, computed else.

    files: path, duration_sec, content_fingerprint; index: path, content_fingerprint, perceptual_hashes (hex), perceptual_num_frames.
    """
    if not use_cache:
        return signatures(files, source, frames)
    held = index.where((F.size("perceptual_hashes") > 0) & (F.col("perceptual_num_frames") == frames))
    cached = files.select("path", "content_fingerprint").join(held, ["path", "content_fingerprint"]).select("path", F.transform("perceptual_hashes", hex_to_hash).alias("signature"), F.lit(frames).alias("frames"))
    return cached.unionByName(signatures(files.join(cached.select("path"), "path", "left_anti"), source, frames))
