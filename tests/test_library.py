"""The media-library operators: published cases, edge rows, and the catalogue against DuckDB."""

import glob
import hashlib
import json
import os
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinegraph.functions.formats import format_bitrate, format_duration, format_size
from cinegraph.functions.names import leading_tag, parse_part, standard_file_name, standardize_stem, title_without_tag
from cinegraph.operators.components import connected_components
from cinegraph.operators.conversion import needs_container_or_codec
from cinegraph.operators.duplicates import rank_for_keep
from cinegraph.operators.media_index import upsert
from cinegraph.operators.parts import contiguous_runs, run_summary
from cinegraph.operators.similarity import distances, guarded_pairs, padded, similar_pairs
from cinegraph.operators.tags import metadata_fit
from cinegraph.plans import catalogue, library_queries

SMALL = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_names(spark):
    given = {"【A24】Dune  (2021) copy": "[A24] Dune (2021)", "Movie (1)": "Movie", "M（1）": "M (1)", "Movie (1) (2)": "Movie (1)", "a copy copy b": "a copy b", "copy": "copy"}
    assert column(spark, list(given), standardize_stem) == list(given.values())
    assert column(spark, ["[A24] Dune (2021).mp4", "x.MP4"], lambda c: standard_file_name(c) == c) == [True, False]


def test_parts(spark):
    stems = ["LOTR_part_1", "Movie-cd2", "Movie_part_1to2", "Dune 2020", "x", None]
    assert [None if p is None else int(p["part"]) for p in column(spark, stems, parse_part)] == [1, 2, None, 2020, None, None]
    runs = lambda ps: sorted((r["start_part"], r["end_part"]) for r in run_summary(spark.createDataFrame([("k", p, 100.0) for p in ps], "k string, part int, duration double"), ["k"]).collect())
    assert runs([1, 3]) == [] and runs([1, 1, 2]) == [(1, 2)] and runs([1, 2, 2, 4]) == [(1, 2)] and runs([1, 2, 2, 3]) == [(1, 2), (2, 3)]
    fits = lambda ds: [r["compatible"] for r in run_summary(spark.createDataFrame([("k", i, d) for i, d in enumerate(ds)], "k string, part int, duration double"), ["k"]).collect()]
    assert fits([100.0, 100.0, 116.0]) == [True] and fits([100.0, 100.0, 140.0]) == [False] and fits([100.0, None, 140.0]) == [True] and fits([1.0, 99.0]) == [True]
    assert contiguous_runs(spark.createDataFrame([], "k string, part int"), ["k"]).count() == 0


def test_tags(spark):
    names = ["[1080p] Dune (2021)", "[A24] Dune (2021)", "[Isaac] X", "[] [A24] X", "[1080p] [A24] X", "[A24]"]
    assert column(spark, names, leading_tag) == [None, "A24", None, None, "A24", "A24"]
    assert column(spark, names, title_without_tag) == ["Dune (2021)", "Dune (2021)", "X", "[A24] X", "X", "[A24]"]
    near, far = spark.range(1).select(metadata_fit(F.lit(7250.0), F.lit(1.777), F.lit(7250.0), F.lit(1.777)), metadata_fit(F.lit(3600.0), F.lit(1.333), F.lit(7250.0), F.lit(1.777))).first()
    assert near < far


def test_keep_ranking(spark):
    rows = [("short", 2073600, 8000000, 7000.0), ("best", 2073600, 8000000, 7190.0), ("long", 2073600, 8000000, 7300.0)]
    df = spark.createDataFrame([("g", *r, 1) for r in rows], "g string, path string, pixels long, bit_rate long, duration_sec double, size long")
    assert rank_for_keep(df, "g", ["path"]).where("rank = 1").first()["path"] == "best"


def test_conversion(spark):
    assert spark.range(1).select(needs_container_or_codec(F.lit(False), F.lit(".mkv"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0] is True


def test_formats(spark):
    assert column(spark, [0, 1023, 1024, 1536, None, -2048, 1126], format_size, "long") == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "0 B", "-2.00 KB", "1.10 KB"]
    assert column(spark, [3599.5, 59.0, None, 61.0, 0.0], format_duration, "double") == ["1h 00m", "59s", "unknown duration", "1m 01s", "unknown duration"]
    assert column(spark, [0, None, 1_250_000, 128_000], format_bitrate, "long") == ["unknown bitrate", "unknown bitrate", "1.2 Mbps", "128 Kbps"]


def test_index_forgets_stale_hashes(spark):
    schema = "path string, content_fingerprint string, exact_hash string"
    old = spark.createDataFrame([("a", "f1", "h1"), ("b", "f1", "h2")], schema)
    new = spark.createDataFrame([("a", "f2", None), ("b", "f1", None), ("c", "f3", "h3")], schema)
    assert sorted(map(tuple, upsert(old, new, fingerprint="content_fingerprint").collect()), key=str) == [("a", "f2", None), ("b", "f1", "h2"), ("c", "f3", "h3")]


def test_pairs_and_components(spark):
    df = spark.createDataFrame([(1, 10), (2, 65), (3, 200), (4, None), (5, 70)], "k long, d long")
    assert sorted(map(tuple, guarded_pairs(df, "k", "d").collect())) == [(1, 2), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (4, 5)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (7, 7), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_distances_of_padded_signatures():
    x, nx = padded(pa.array([[0, -1], [5], [1, 2, 3]]))
    y, ny = padded(pa.array([[0, -1, 7], [5, 4], [1, 2, 3]]))
    average, good = distances(x, nx, y, ny)
    assert average.tolist() == [0.0, 0.0, 0.0] and good.tolist() == [1.0, 1.0, 1.0]
    average, good = distances(*padded(pa.array([[0]])), *padded(pa.array([[2**40 - 1]])))
    assert (average[0], good[0]) == (40.0, 0.0)


@pytest.mark.parametrize(("slice_", "held"), [(4096, 1 << 20), (3, 600)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_similar_pairs_equal_all_pairs(spark, slice_, held, kind):
    """Slices, unknown durations, signatures of several lengths, none and empty ones: as by comparing all with all."""
    from cinegraph.operators import similarity

    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 6)
    rows = []
    for k in range(40):
        sig = [int(v) ^ int(rng.integers(0, 1 << int(rng.integers(1, 16)))) for v in rng.choice(base, rng.integers(1, 7), replace=False)]
        rows.append((k if kind == "long" else f"/v/{k:02d}", None if k % 9 == 4 else float(rng.integers(0, 200)), [None, [], sig][2 if k % 11 else k % 2]))
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] and b[2] and (a[1] is None or b[1] is None or abs(a[1] - b[1]) <= 60):
                q, t = (a[2], b[2]) if len(a[2]) <= len(b[2]) else (b[2], a[2])
                best = [min(((x ^ y) & (2**64 - 1)).bit_count() for y in t) for x in q]
                if sum(best) / len(best) <= 10 or sum(x <= 8 for x in best) / len(best) >= 0.6:
                    want[a[0], b[0]] = (sum(best) / len(best), sum(x <= 8 for x in best) / len(best))
    df = spark.createDataFrame(rows, f"k {kind}, d double, s array<long>")
    with mock.patch.object(similarity, "SLICE", slice_), mock.patch.object(similarity, "HELD", held):
        got = similar_pairs(df, "k", "d", "s").collect()
        near = guarded_pairs(df, "k", "d").collect()
    assert len(got) == len(want) > 20 and all((abs(r["avg_distance"] - want[r["a"], r["b"]][0]) < 1e-9) and abs(r["good_ratio"] - want[r["a"], r["b"]][1]) < 1e-9 for r in got)
    assert sorted(map(tuple, near)) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] is None or b[1] is None or abs(a[1] - b[1]) <= 60))


@pytest.mark.parametrize("frames", [1, 5, 15])
def test_sums_bound_alike_pairs(frames):
    """Every alike pair reaches the bound, also at its limits, and chance pairs of whole signatures hardly do; the nearest frames are found as by comparing all."""
    from cinegraph.operators.similarity import Sums, _matched

    rng = np.random.default_rng(frames)
    flip = lambda v, n: v ^ int(sum(1 << int(b) for b in rng.choice(60, n, replace=False)))
    base = [[int(v) for v in rng.integers(0, 2**60, frames)] for _ in range(300)]
    near = [[flip(v, int(rng.choice([8, 10, 11] if k % 2 else [0, 8, 30]))) for v in sig][: rng.integers(1, frames + 1)] for k, sig in enumerate(base)]
    (x, nx), (y, ny) = padded(pa.array(base)), padded(pa.array(near))
    sums = Sums([(x, nx), (y, ny)], 10.0, 0.6)
    i, j = sums.reached(sums.query(sums.of(x, nx)), nx, sums.of(y, ny), ny)
    best = np.array([[[min((u ^ v).bit_count() for v in a) for u in b] + [-1] * (frames - len(b)) for b in near] for a in base])  # the shorter is near's
    tie = nx[:, None] == ny[None, :]
    average, good = (best * (best >= 0)).sum(2) / ny, ((best >= 0) & (best <= 8)).sum(2) / ny
    alike = (average <= 10) | (good >= 0.6)
    reached = np.zeros(alike.shape, bool)
    reached[i, j] = True
    assert alike.sum() > 50 and reached[alike].all() and (frames < 15 or reached[ny >= 14].mean() > 0 and reached[:, ny >= 14].mean() < 0.05)
    p, q = np.divmod(np.arange(alike.size), len(ny))
    second = np.ones(len(p), bool)  # at a tie near is the query
    found = {(int(p[r]), int(q[r])): (a, g) for rows, aa, gg in _matched(x[p], nx[p], y[q], ny[q], 10.0, 0.6, second) for r, a, g in zip(rows, aa, gg, strict=True)}
    assert tie.any() and found == {(int(a), int(b)): (average[a, b], good[a, b]) for a, b in np.argwhere(alike)}


def test_similar_pairs_of_one_duration_are_bounded(spark):
    """Thousands of items of one duration: only pairs that the sums cannot rule out are compared frame by frame."""
    from cinegraph.operators import similarity

    rng = np.random.default_rng(5)
    sides = [padded(pa.array([[int(v) for v in rng.integers(0, 2**60, 15)] for _ in range(1500)])) for _ in range(2)]
    sums = similarity.Sums(sides, 10.0, 0.6)
    i, _ = sums.reached(sums.query(sums.of(*sides[0])), sides[0][1], sums.of(*sides[1]), sides[1][1])
    assert sums.sharp and len(i) < 0.01 * 1500**2
    rows = [(k, 5.0, [int(v) for v in s]) for k, s in enumerate(np.concatenate([sides[0][0], sides[0][0][:40]]).astype(np.int64))]
    rows[7] = (7, None, rows[3][2])
    got = similarity.similar_pairs(spark.createDataFrame(rows, "k long, d double, s array<long>"), "k", "d", "s").collect()
    want = {(k, 1500 + k) for k in range(40) if k != 7} | {(3, 7), (7, 1503)}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) and all(r["avg_distance"] == 0 for r in got)


@pytest.mark.parametrize("slice_", [4096, 16])
def test_links_of_copies_are_few(spark, slice_):
    """Links reach what all pairs reach, with a row for each copy and block instead of one for every two copies."""
    from cinegraph.operators import similarity

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**60, (8, 15))
    rows = [(k, None if k % 50 == 3 else float(k % 240), [int(v) ^ int(rng.integers(0, 64)) for v in base[min(7, k % 16)]]) for k in range(200)] + [(1000 + k, 5.0, [int(v) for v in rng.integers(0, 2**60, 15)]) for k in range(20)]
    df = spark.createDataFrame(rows, "k long, d double, s array<long>")
    with mock.patch.object(similarity, "SLICE", slice_):
        pairs, links = similarity.similar_pairs(df, "k", "d", "s").select("a", "b"), similarity.similar_links(df, "k", "d", "s")
        found = [{r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()} for edges in (pairs, links)]
        assert found[0] == found[1] and len(found[0]) == 200 and len(set(found[0].values())) < 20
        assert slice_ < 4096 or links.count() < 0.3 * pairs.count()


def test_codec_targets(spark):
    from cinegraph.operators.conversion import codecs_are_target

    rows = [("H264", None, True), ("h264", "AAC", True), ("h264", "", False), ("h264", "ac3", False), ("", "aac", False), (None, None, False), ("vp9", "aac", False)]
    df = spark.createDataFrame(rows, "v string, a string, want boolean")
    assert df.where(codecs_are_target(F.col("v"), F.col("a")) != F.col("want")).count() == 0


def test_names_of_files(spark):
    from cinegraph.functions.names import compounded, numbered, parse_part_file

    assert column(spark, [0, 1, 2], lambda n: compounded(F.lit("x.mp4"), n), "int") == ["x.mp4", "x__1.mp4", "x__1__2.mp4"]
    assert column(spark, [1, 2, 3], lambda n: numbered(F.lit("a.b.mp4"), n), "int") == ["a.b.mp4", "a.b__2.mp4", "a.b__3.mp4"]
    found = column(spark, ["/lib/M-CD2.mkv", "/lib/M.mkv", "/lib/M_part_1to2.mkv", "/lib/M 12 34.avi"], parse_part_file)
    assert [f and (f["parent"], f["prefix"], int(f["part"])) for f in found] == [("/lib", "M-CD", 2), None, None, ("/lib", "M 12 ", 34)]


def test_phash_and_hex(spark):
    from cinegraph.sources.frames import frame_offsets, hash_to_hex, hex_to_hash, phash

    rng = np.random.default_rng(1)
    waves = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32) + 1) / 64)
    one, two = (waves.T @ rng.normal(0, 10, (8, 8)) @ waves + 128 for _ in range(2))
    a, b, c, d = phash(np.stack([one, one + rng.normal(0, 1, (32, 32)), two, 2 * one + 5]))
    bits = lambda x, y: int(np.bitwise_count(np.uint64(np.int64(x).view(np.uint64) ^ np.int64(y).view(np.uint64))))
    assert bits(a, d) <= 2 and bits(a, b) <= 16 < bits(a, c)
    hashes = [0, 1, -1, -(2**63), 2**63 - 1]
    assert column(spark, hashes, lambda h: hex_to_hash(hash_to_hex(h)), "long") == hashes
    assert column(spark, [1, -1], hash_to_hex, "long") == ["0000000000000001", "f" * 16]
    assert column(spark, [100.0, None, 0.0], lambda x: frame_offsets(x, 3), "double") == [[10.0, 50.0, 90.0], [], []]
    assert column(spark, [100.0], lambda x: frame_offsets(x, 1), "double") == [[50.0]] and column(spark, [100.0], lambda x: frame_offsets(x, 0), "double") == [[]]


def test_index_store(spark, tmp_path):
    from cinegraph.sources import index_store

    root = str(tmp_path)
    assert index_store.load_index(spark, root).count() == 0
    index = index_store.decode_records(spark.createDataFrame([("/a", "q"), ("/b", None), (None, "x")], "path string, quick_fingerprint string"))
    index_store.save_index(index, root)
    index_store.save_index(index_store.load_index(spark, root).where("path = '/a'"), root)
    got = index_store.load_index(spark, root).collect()
    assert [(r["path"], r["quick_fingerprint"], r["perceptual_hashes"], r["perceptual_num_frames"]) for r in got] == [("/a", "q", [], 15)]
    assert index_store.load_index(spark, root, rebuild=True).count() == 0 == index_store.load_index(spark, root + "/other").count()
    (tmp_path / ".cinegraph" / "index.json").write_text("{broken")
    assert index_store.load_index(spark, root).count() == 0
    old = tmp_path / "old.json"
    old.write_text('{"version": 1, "root": "/lib", "updated_at": "t", "videos": {"/lib/a": {"path": "/lib/a", "width": 5, "perceptual_hashes": ["00ff"]}, "/lib/b": {"path": "/lib/b"}}}')
    found = {r["path"]: r for r in index_store.import_json(spark, str(old), "/lib").collect()}
    assert set(found) == {"/lib/a", "/lib/b"} and found["/lib/a"]["width"] == 5 and found["/lib/b"]["perceptual_hashes"] == []
    assert index_store.import_json(spark, str(old), "/else").count() == 0 == index_store.import_json(spark, str(tmp_path / "none"), "/lib").count()


def report(video="h264", audio="aac", seconds=100.0, width=1920, height=1080, rate=1000):
    return json.dumps({"streams": [{"codec_type": "video", "codec_name": video, "width": width, "height": height, "bit_rate": str(rate)}, {"codec_type": "audio", "codec_name": audio}], "format": {"duration": str(seconds)}})


class Pictures:
    """Frames by the content of a file: what it holds seeds a picture."""

    def frames(self, path, offsets):
        with open(path, "rb") as f:
            seed = int.from_bytes(f.read(2).ljust(2, b"0"), "big")
        return [np.random.default_rng(seed).integers(0, 255, (32, 32)) for _ in offsets[:3]]


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


LIBRARY = {
    "a/Dune (2021).mp4": "AA same content", "a/Dune (2021) (1).mp4": "AA same content", "b/Dune big.mp4": "AA other cut", "b/Odd copy.mkv": "BB x", "c/Film_part_1.mp4": "CC 1", "c/Film_part_2.mp4": "DD 2",
    "d/Bad.avi": "EE", ".hidden/x.mp4": "FF", "notes.txt": "n", "e/Plain.mp4": "GG",
}


def library(spark, tmp_path):
    from cinegraph.sources.probe import TableProbe

    tree(tmp_path, LIBRARY)
    os.symlink(tmp_path / "e/Plain.mp4", tmp_path / "link.mp4")
    facts = {"b/Dune big.mp4": report(width=3840, height=2160), "b/Odd copy.mkv": report(seconds=900), "c/Film_part_1.mp4": report(seconds=2000), "c/Film_part_2.mp4": report(seconds=3000), "d/Bad.avi": None, "e/Plain.mp4": report(seconds=5000)}
    rows = [(str(tmp_path / n), facts.get(n, report())) for n in LIBRARY if n.endswith(("mp4", "mkv", "avi"))]
    return TableProbe(spark.createDataFrame(rows, "path string, probe string"))


def test_scan(spark, tmp_path):
    from cinegraph.sources.digest import file_digests
    from cinegraph.sources.library import scan_library, scan_report

    library(spark, tmp_path)
    found = scan_library(spark, str(tmp_path))
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in found.collect()) == sorted(n for n in LIBRARY if n.endswith(("mp4", "mkv", "avi")) and not n.startswith("."))
    seen = scan_report(spark, str(tmp_path)).first()
    assert (seen["folders"], seen["files"], seen["videos"], seen["unreadable"]) == (6, 9, 8, 0)
    assert scan_library(spark, str(tmp_path / "none")).count() == 0 == scan_library(spark, str(tmp_path / "notes.txt")).count()
    digests = {r["path"]: r["exact_hash"] for r in file_digests(spark.createDataFrame([(str(tmp_path / "e/Plain.mp4"),), (str(tmp_path / "gone"),)], "path string")).collect()}
    assert digests == {str(tmp_path / "e/Plain.mp4"): hashlib.sha256(b"GG").hexdigest(), str(tmp_path / "gone"): None}


def test_dry_run_plans_and_changes_nothing(spark, tmp_path):
    from cinegraph.config import RunConfig
    from cinegraph.plans.run import run_library

    probe = library(spark, tmp_path)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    run = run_library(spark, RunConfig(str(tmp_path), dry_run=True), probe, Pictures())
    acts = {(r["phase"], r["op"], os.path.relpath(r["src"] or r["dst"], tmp_path), os.path.relpath(r["dst"], tmp_path)) for r in run.plan().collect()}
    assert ("exact", "trash", "a/Dune (2021) (1).mp4", "a/Dune (2021).mp4") in acts
    assert ("perceptual", "trash", "a/Dune (2021).mp4", "b/Dune big.mp4") in acts and ("perceptual", "keep", "b/Dune big.mp4", "b/Dune big.mp4") in acts
    assert ("standardize", "remux", "b/Odd copy.mkv", "b/Odd.mp4") in acts and ("standardize", "skip", "d/Bad.avi", "d/Bad.mp4") in acts
    assert ("merge", "merge", "c/Film_part_1to2.mp4", "c/Film_part_1to2.mp4") in acts and len(acts) == 6
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before
    assert {(r["phase"], r["op"]): r["actions"] for r in run.summary().collect()}["exact", "trash"] == 1


def test_run_commits_and_decides(spark, tmp_path):
    from cinegraph.config import RunConfig
    from cinegraph.plans.run import run_library
    from cinegraph.sources.index_store import load_index

    probe, commands = library(spark, tmp_path), []

    def convert(command):
        commands.append(command)
        if "concat" in command and "copy" in command:
            return False  # the plain join fails, the encoding follows
        with open(command[-1], "w") as f:
            f.write("made")
        return True

    no = spark.createDataFrame([("perceptual", str(tmp_path / "a/Dune (2021).mp4"), False, None)], "phase string, group_id string, approve boolean, keep string")
    run = run_library(spark, RunConfig(str(tmp_path)), probe, Pictures(), no, convert)
    there = lambda name: (tmp_path / name).exists()
    assert there("a/Dune (2021).mp4") and there(".cinegraph_trash/a/Dune (2021) (1).mp4") and there("b/Dune big.mp4")
    assert there("b/Odd.mp4") and there(".cinegraph_trash/b/Odd copy.mkv") and not there("b/Odd copy.mkv") and there("d/Bad.avi")
    assert there("c/Film_part_1to2.mp4") and there(".cinegraph_trash/c/Film_part_1.mp4") and not there("c/Film_part_2.mp4")
    assert [("copy" in c) for c in commands] == [True, True, False]
    left = sorted(os.path.relpath(r["path"], tmp_path) for r in run.left.collect())
    assert left == ["a/Dune (2021).mp4", "b/Dune big.mp4", "b/Odd.mp4", "c/Film_part_1to2.mp4", "d/Bad.avi", "e/Plain.mp4"]
    saved = load_index(spark, str(tmp_path))
    assert sorted(os.path.relpath(r["path"], tmp_path) for r in saved.collect()) == left
    done = {(r["phase"], r["op"]): r["actions"] for r in run.summary().collect()}
    assert done == {("exact", "trash"): 1, ("standardize", "remux"): 1, ("merge", "merge"): 1}


def test_commit_reports_what_fails(spark, tmp_path):
    from cinegraph.config import Encoding, RunConfig
    from cinegraph.plans.actions import ACTION
    from cinegraph.plans.commit import Committer, free_path, trash_path

    tree(tmp_path, {"x.mp4": "1", "t/x.mp4": "2", "t/x__1.mp4": "3", "y.mkv": "4", "y__2.mkv": "5"})
    assert trash_path(str(tmp_path / "x.mp4"), str(tmp_path / "t"), str(tmp_path)).endswith("t/x__1__2.mp4") and free_path(str(tmp_path / "y.mkv")).endswith("y__3.mkv")
    calls = []

    def convert(command):
        calls.append(command[command.index("-crf") + 1])
        with open(command[-1], "wb") as f:
            f.write(b"0" * (3 << 20 if len(calls) < 3 else 1 << 20))
        return True

    p = lambda n: str(tmp_path / n)
    plan = spark.createDataFrame([("s", "trash", "1", p("none"), None, p("x.mp4"), 0, "", True), ("s", "rename", "2", p("none"), None, p("z.mp4"), 0, "", True), ("s", "convert", "3", p("x.mp4"), None, p("x.mp4"), 0, "", True), ("s", "merge", "4", None, [p("none")], p("m.mp4"), 0, "", True), ("s", "trash", "5", p("y.mkv"), None, None, 0, "", False)], ACTION)
    got = {r["group_id"]: (r["ok"], r["note"]) for r in Committer(RunConfig(str(tmp_path), encoding=Encoding(28, "fast", 2.0)), convert).commit(plan).collect()}
    assert got == {"1": (False, "not moved"), "2": (False, "not found"), "3": (True, "converted"), "4": (False, "a part is missing")}
    assert calls == ["28", "30", "32"] and (tmp_path / "x.mp4").stat().st_size == 1 << 20 and (tmp_path / ".cinegraph_trash/x.mp4").read_text() == "1" and (tmp_path / "y.mkv").exists()


def test_command_line(spark, tmp_path, capsys):
    from cinegraph import cli

    probe = library(spark, tmp_path)
    assert cli.main(["--path", str(tmp_path), "--dry-run", "--standardize-only", "--skip-combine-parts"], spark, probe=probe, frames=Pictures()) == 0
    out = capsys.readouterr().out
    assert "remux" in out and "Odd.mp4" in out and "merge" not in out
    assert cli.main(["--path", str(tmp_path / "none")], spark) == 2 and cli.main(["--path", str(tmp_path), "--crf", "52"], spark) == 2 and cli.main(["--path", str(tmp_path), "--max-file-size-mb", "-1"], spark) == 2
    with pytest.raises(SystemExit) as stop:
        cli.main(["--path", "x", "--tags-only", "--standardize-only"], spark)
    assert stop.value.code == 2
    assert cli.config_of(cli.parser().parse_args(["--path", "/", "--standardize-only"])).phases() == ["standardize", "merge"]
    assert cli.config_of(cli.parser().parse_args(["--path", "/", "--tags-only"])).phases() == ["tags"]


def test_tag_plan_renames_untagged(spark):
    from cinegraph.plans.actions import plan_tags

    rows = [(f"/v/[A24] Film {k}.mp4", 1, 7200.0 + k, 1920, 1080, [5, 6, 7]) for k in range(5)] + [("/v/New one.mp4", 1, 7201.0, 1920, 1080, [5, 6, 7]), ("/v/[1080p] Far.mp4", 1, 100.0, 640, 480, [-1, -2, -3]), ("/v/[A24] New one.mp4", 1, 7200.0, 1920, 1080, None)]
    df = spark.createDataFrame(rows, "path string, size_bytes long, duration_sec double, width int, height int, signature array<long>")
    got = {r["src"]: (r["op"], r["dst"], r["reason"][:15]) for r in plan_tags(df, apply=True).collect()}
    assert got == {"/v/New one.mp4": ("rename", "/v/[A24] New one__2.mp4", "confidence high")}
    assert plan_tags(df.where("path not like '%[A24]%'")).count() == 0


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, tables, name):
    got, want = catalogue.QUERIES[name](spark, SMALL).toPandas(), tables.execute(catalogue.ORACLES[name]).df()
    assert library_queries and sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "exact_duplicate_groups" in e.queries()
