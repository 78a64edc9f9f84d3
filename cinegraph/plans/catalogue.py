"""Queries of the media-library operators over the fixture tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.functions.formats import format_bitrate, format_duration, format_size
from cinegraph.functions.names import leading_tag, parse_part, standard_file_name, standardize_stem, title_without_tag
from cinegraph.operators.components import connected_components
from cinegraph.operators.conversion import needs_codec, needs_container_or_codec, needs_conversion, needs_rename, remuxes, retry_ladder
from cinegraph.operators.duplicates import exact_groups, keep_cleanest, rank_for_keep
from cinegraph.operators.media_index import cache_misses, content_fingerprint, last_known, prune
from cinegraph.operators.parts import contiguous_runs, run_summary
from cinegraph.operators.similarity import guarded_pairs, similar_links, similar_pairs
from cinegraph.operators.tags import metadata_fit, tag_profiles

#: Tag profiles that are sent to each task at once.
PROFILES = 100_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return exact_groups(read(spark, d, "documents").select(F.sha2("text", 256).alias("digest")))


_NAMED = "SELECT doc_id, text, source || ' (' || doc_id || ')' AS path, sha256(text) AS digest FROM documents"
_RANKED = f"""SELECT doc_id, digest, path, octet_length(encode(text)) AS size_bytes, count(*) OVER (PARTITION BY digest) AS n,
 row_number() OVER (PARTITION BY digest ORDER BY len(regexp_extract_all(path, '\\(\\s*\\d+\\s*\\)')), length(path), length(regexp_replace(path, '[A-Za-z0-9 _.-]', '', 'g')), lower(path)) AS rank FROM ({_NAMED})"""


def _named(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat("source", F.lit(" ("), "doc_id", F.lit(")")).alias("path"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(f"SELECT doc_id, digest, rank, CASE WHEN rank = 1 THEN 'keep' ELSE 'remove' END AS action FROM ({_RANKED}) WHERE n > 1")
def exact_keep_remove(spark, d):
    return keep_cleanest(_named(spark, d)).select("doc_id", "digest", F.col("rank").cast("long").alias("rank"), F.when(F.col("rank") == 1, "keep").otherwise("remove").alias("action"))


@query(f"SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_RANKED}) WHERE n > 1 AND rank > 1")
def exact_reclaimed_bytes(spark, d):
    return keep_cleanest(_named(spark, d)).where("rank > 1").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, median_duration, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, abs(l_quantity - median_duration), l_extendedprice DESC, l_linenumber, l_discount, l_tax, l_shipdate) AS rank
FROM (SELECT *, median(l_quantity) OVER (PARTITION BY l_orderkey) AS median_duration FROM lineitem)""")
def rank_copies_for_keep(spark, d):
    ranked = rank_for_keep(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_discount", "l_tax", "l_shipdate"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ranked.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "median_duration", F.col("rank").cast("long").alias("rank"))


@query("SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.doc_id < b.doc_id AND (a.n_chars IS NULL OR b.n_chars IS NULL OR abs(a.n_chars - b.n_chars) <= 60)")
def duration_guarded_pairs(spark, d):
    return guarded_pairs(read(spark, d, "documents"), "doc_id", "n_chars")


#: Shingle signature: the 15 least 60-bit hashes of three-word windows.
_SIGNATURE = """SELECT doc_id, n_chars, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [('0x' || substr(md5(array_to_string(w, ' ')), 1, 15))::BIGINT] ELSE
 list_transform(range(1, len(w) - 1), lambda i: ('0x' || substr(md5(array_to_string(w[i:i+2], ' ')), 1, 15))::BIGINT) END))[1:15] AS sig FROM (SELECT doc_id, n_chars, string_split(text, ' ') AS w FROM documents)"""
_PAIRS = f"""WITH s AS ({_SIGNATURE}), p AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.sig) <= len(b.sig) THEN a.sig ELSE b.sig END AS q, CASE WHEN len(a.sig) <= len(b.sig) THEN b.sig ELSE a.sig END AS t
 FROM s a JOIN s b ON a.doc_id < b.doc_id AND abs(a.n_chars - b.n_chars) <= 60), m AS (SELECT a, b, list_transform(q, lambda x: list_min(list_transform(t, lambda y: bit_count(xor(x, y))))) AS best FROM p),
 e AS (SELECT a, b, round(list_avg(best), 6) AS avg_distance, round(len(list_filter(best, lambda x: x <= 8)) / len(best), 6) AS good_ratio FROM m), edges AS (SELECT * FROM e WHERE avg_distance <= 10 OR good_ratio >= 0.6)"""


def _signed_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", F.split("text", " ").alias("w"))
    w = F.col("w")  # a plain column: inside the lambda it must not be split again
    code = lambda x: F.conv(F.substr(F.md5(x), F.lit(1), F.lit(15)), 16, -10).cast("long")
    windows = F.when(F.size(w) < 3, F.array(code(F.array_join(w, " ")))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: code(F.array_join(F.slice(w, i, 3), " "))))
    return docs.select("doc_id", "n_chars", F.slice(F.sort_array(F.array_distinct(windows)), 1, 15).alias("sig"))


@query(f"SELECT doc_id, len(sig) AS frames, sig[1] AS first_hash, sig[-1] AS last_hash FROM ({_SIGNATURE})")
def frame_signatures(spark, d):
    return _signed_documents(spark, d).select("doc_id", F.size("sig").cast("long").alias("frames"), F.element_at("sig", 1).alias("first_hash"), F.element_at("sig", -1).alias("last_hash"))


@query(f"{_PAIRS} SELECT a, b, avg_distance, good_ratio FROM edges")
def perceptual_pairs(spark, d):
    return similar_pairs(_signed_documents(spark, d), "doc_id", "n_chars", "sig").select("a", "b", F.round("avg_distance", 6).alias("avg_distance"), F.round("good_ratio", 6).alias("good_ratio"))


@query(_PAIRS.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def perceptual_groups(spark, d):
    return connected_components(similar_links(_signed_documents(spark, d), "doc_id", "n_chars", "sig"), "a", "b")


_NAMES = "SELECT p_partkey, '【' || p_brand || '】' || p_name || '  (' || p_size || ') copy' AS name FROM part"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _standard_sql(x: str) -> str:
    """The cleaning of names in SQL without look-around: brackets are spaced twice, as matches may touch."""
    s = f"regexp_replace({_strip_sql(x)}, '[<>:\"/\\\\|?*]', '', 'g')"
    s = f"CASE WHEN regexp_matches({s}, '\\(\\s*(?:19|20)\\d\\d\\s*\\)\\s*$') THEN {s} ELSE regexp_replace({s}, '\\(\\s*\\d+\\s*\\)\\s*$', '') END"
    s = _strip_sql(f"({s})")
    for word in ("copy", "duplicate"):
        s = f"regexp_replace({s}, '(?i)(?:^|\\s){word}(?:\\s|$)', ' ', 'g')"
    s = f"translate({s}, '【】［］「」『』（）', '[][][][]()')"
    for _ in range(2):
        s = f"regexp_replace({s}, '([^(\\[\\s])([(\\[])', '\\1 \\2', 'g')"
        s = f"regexp_replace({s}, '([)\\]])([^)\\](\\[\\s])', '\\1 \\2', 'g')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'), ' .')"
    return f"coalesce(nullif({s}, ''), {_strip_sql(x)})"


def _part_names(spark, d):
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("【"), "p_brand", F.lit("】"), "p_name", F.lit("  ("), "p_size", F.lit(") copy")).alias("name"))


@query(f"SELECT p_partkey, {_standard_sql('name')} AS standard FROM ({_NAMES})")
def standardize_names(spark, d):
    return _part_names(spark, d).select("p_partkey", standardize_stem(F.col("name")).alias("standard"))


@query(f"SELECT p_partkey, name || '.mp4' = {_standard_sql('name')} || '.mp4' AS is_standard FROM ({_NAMES} UNION ALL SELECT -p_partkey, '[' || p_brand || '] Film (2021)' FROM part)")
def names_are_standard(spark, d):
    plain = read(spark, d, "part").select((-F.col("p_partkey")).alias("p_partkey"), F.concat(F.lit("["), "p_brand", F.lit("] Film (2021)")).alias("name"))
    names = _part_names(spark, d).unionByName(plain).withColumn("file", F.concat("name", F.lit(".mp4")))
    return names.select("p_partkey", (F.col("file") == standard_file_name(F.col("file"))).alias("is_standard"))


@query(f"SELECT page_id, {_standard_sql('title')} AS standard FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def page_title_cleanup(spark, d):
    titles = read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return titles.select("page_id", standardize_stem(F.col("title")).alias("standard"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, regexp_extract(n, '^(.+?_part_)\\d+$', 1) AS prefix, CAST(regexp_extract(n, '(\\d+)$', 1) AS BIGINT) AS part FROM (SELECT *, 'O' || l_orderkey || '_part_' || l_linenumber AS n FROM lineitem)")
def parse_parts(spark, d):
    name = F.concat(F.lit("O"), "l_orderkey", F.lit("_part_"), "l_linenumber")
    named = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"))
    parsed = named.select("l_orderkey", "l_linenumber", "l_partkey", parse_part(F.col("name")).alias("p"))
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "p.prefix", F.col("p.part").cast("long").alias("part"))


_RUNS = """WITH o AS (SELECT *, CASE WHEN l_linenumber = lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS brk FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey)),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM o)"""
_TIES = ["l_quantity", "l_partkey", "l_suppkey"]


@query(f"{_RUNS} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_parts, CAST(min(l_linenumber) AS BIGINT) AS start_part, CAST(max(l_linenumber) AS BIGINT) AS end_part FROM r GROUP BY l_orderkey, run HAVING count(*) > 1")
def part_runs(spark, d):
    runs = contiguous_runs(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", _TIES)
    return runs.groupBy("l_orderkey", "run").agg(F.count("*").alias("n_parts"), F.min("l_linenumber").cast("long").alias("start_part"), F.max("l_linenumber").cast("long").alias("end_part")).where("n_parts > 1").drop("run")


_MERGES = f"""{_RUNS}, g AS (SELECT l_orderkey, run, count(*) AS n, min(l_linenumber) AS s, max(l_linenumber) AS e, avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, sum(l_quantity) AS total FROM r GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, CAST(n AS BIGINT) AS n_parts, CAST(s AS BIGINT) AS start_part, CAST(e AS BIGINT) AS end_part, round(total, 6) AS total_duration FROM g WHERE n < 3 OR (m - lo <= 0.15 * m AND hi - m <= 0.15 * m)"""


def _merge_groups(spark, d):
    return run_summary(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", ties=_TIES).where("compatible")


@query(_MERGES)
def part_merge_groups(spark, d):
    return _merge_groups(spark, d).select("l_orderkey", "n_parts", F.col("start_part").cast("long").alias("start_part"), F.col("end_part").cast("long").alias("end_part"), F.round("total_duration", 6).alias("total_duration"))


@query(f"SELECT l_orderkey, 'O' || l_orderkey || '_part_' || start_part || 'to' || end_part || '.mp4' AS merged FROM ({_MERGES})")
def merged_names(spark, d):
    name = standardize_stem(F.concat(F.lit("O"), "l_orderkey", F.lit("_part_"), "start_part", F.lit("to"), "end_part"))
    return _merge_groups(spark, d).select("l_orderkey", F.concat(name, F.lit(".mp4")).alias("merged"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_brand END AS tag, p_name AS title FROM part")
def tag_extraction(spark, d):
    note, brand = F.lit("[1080p] "), F.concat(F.lit("["), "p_brand", F.lit("] "))
    k = F.col("p_partkey") % 3
    names = read(spark, d, "part").select("p_partkey", F.concat(F.when(k == 0, brand).when(k == 1, F.concat(note, brand)).otherwise(note), "p_name").alias("name"))
    return names.select("p_partkey", leading_tag(F.col("name")).alias("tag"), title_without_tag(F.col("name")).alias("title"))


_PROFILES = "SELECT p_brand AS tag, median(p_retailprice) AS median_duration, median(p_size / 10) AS median_aspect, count(*) AS sample_count FROM part GROUP BY 1 HAVING count(*) >= 3"


def _profiles(spark, d):
    return tag_profiles(read(spark, d, "part").select(F.col("p_brand").alias("tag"), F.col("p_retailprice").alias("duration"), (F.col("p_size") / 10).alias("aspect")))


@query(f"SELECT tag, round(median_duration, 6) AS median_duration, round(median_aspect, 6) AS median_aspect, sample_count FROM ({_PROFILES})")
def tag_profile_table(spark, d):
    return _profiles(spark, d).select("tag", F.round("median_duration", 6).alias("median_duration"), F.round("median_aspect", 6).alias("median_aspect"), "sample_count")


@query(f"SELECT p_partkey, tag, round(abs(p_retailprice - median_duration) / median_duration + abs(p_size / 10 - median_aspect), 6) AS fit FROM part, ({_PROFILES})")
def metadata_fit_scores(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") / 10).alias("aspect"))
    fit = metadata_fit(F.col("p_retailprice"), F.col("aspect"), F.col("median_duration"), F.col("median_aspect"))
    profiles = _profiles(spark, d)  # every file meets every profile: the profiles go to each task, in parts of a bounded size
    fits = None
    for at in range(0, max(1, profiles.count()), PROFILES):
        some = profiles.orderBy("tag").offset(at).limit(PROFILES)
        one = parts.join(F.broadcast(some))
        fits = one if fits is None else fits.unionByName(one)
    return fits.select("p_partkey", "tag", F.round(fit, 6).alias("fit"))


_CODECS = """SELECT *, 'Film ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' copy' ELSE '' END || ext AS name, video = 'H264' AND (audio IS NULL OR lower(audio) = 'aac') AS target FROM (SELECT o_orderkey, o_orderkey % 5 <> 0 AS readable,
 CASE WHEN o_orderstatus = 'F' THEN '.mp4' ELSE '.mkv' END AS ext, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'H264' ELSE 'vp9' END AS video, [NULL, 'aac', '', 'AC3'][o_orderkey % 4 + 1] AS audio FROM orders)"""


@query(f"""SELECT o_orderkey, needs_rename, needs_codec, ext <> '.mp4' OR needs_codec AS needs_work, needs_rename OR needs_codec AS needs_conversion, ext <> '.mp4' AND target AS remux
FROM (SELECT *, ext <> '.mp4' OR name LIKE '% copy%' AS needs_rename, readable AND (ext <> '.mp4' OR NOT target) AS needs_codec FROM ({_CODECS}))""")
def conversion_candidates(spark, d):
    key = F.col("o_orderkey")
    ext, video = F.when(F.col("o_orderstatus") == "F", ".mp4").otherwise(".mkv"), F.when(F.regexp_like("o_orderpriority", F.lit("^[12]")), "H264").otherwise("vp9")
    audio = F.when(key % 4 == 1, "aac").when(key % 4 == 2, "").when(key % 4 == 3, "AC3")
    rows = read(spark, d, "orders").select("o_orderkey", (key % 5 != 0).alias("readable"), ext.alias("ext"), video.alias("video"), audio.alias("audio"))
    rows = rows.withColumn("name", F.concat(F.lit("Film "), key, F.when(key % 3 == 0, " copy").otherwise(""), "ext"))
    args = [F.col(c) for c in ("readable", "ext", "video", "audio")]
    return rows.select(
        "o_orderkey", needs_rename(F.col("name")).alias("needs_rename"), needs_codec(*args).alias("needs_codec"), needs_container_or_codec(*args).alias("needs_work"), needs_conversion(F.col("name"), *args).alias("needs_conversion"), remuxes(*args[1:]).alias("remux")
    )


#: Start quality, start scale and whether there is a budget.
_LADDERS = [(18, 1.0, 1), (19, 1.0, 1), (30, 0.7, 1), (40, 1.0, 1), (51, 0.4, 1), (18, 1.0, 0)]


@query(f"""SELECT CAST(c AS INTEGER) AS start_crf, CAST(s AS DOUBLE) AS start_scale, CAST(b AS INTEGER) AS budget, CAST(k AS INTEGER) AS attempt, CAST(CASE WHEN k <= falls THEN least(greatest(c, 32), c + 2 * k) ELSE greatest(c, 32) END AS INTEGER) AS crf,
 round(CAST(s AS DOUBLE) * pow(0.9, greatest(k - falls, 0)), 6) AS scale FROM (SELECT *, greatest(0, CAST(ceil((32 - c) / 2) AS INTEGER)) AS falls FROM (VALUES {", ".join(map(str, _LADDERS))}) t(c, s, b)), range(10) r(k)
WHERE (b = 1 OR k = 0) AND (k <= falls OR s * pow(0.9, k - falls - 1) > 0.5)""")
def crf_ladder(spark, d):
    out = None
    for crf, scale, budget in _LADDERS:
        one = retry_ladder(spark, crf, scale, budget).select(F.lit(crf).alias("start_crf"), F.lit(scale).alias("start_scale"), F.lit(budget).alias("budget"), "attempt", "crf", "scale")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY 1")
def index_upsert(spark, d):
    return last_known(read(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def index_prune(spark, d):
    found = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return prune(read(spark, d, "orders"), found, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey >= 20")
def index_cache_misses(spark, d):
    customers = read(spark, d, "customer")
    files = customers.select(F.col("c_custkey").alias("path"), content_fingerprint(F.col("c_nationkey"), F.lit(7)).alias("content_fingerprint"))
    index = customers.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"), content_fingerprint(F.col("c_nationkey") % 20, F.lit(7)).alias("content_fingerprint"))
    return cache_misses(files, index).select(F.col("path").alias("c_custkey"))


@query("SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.2f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576.0) ELSE printf('%.2f GB', s / 1073741824.0) END AS size FROM (SELECT doc_id, n_chars * n_chars AS s FROM documents)")
def format_sizes(spark, d):
    return read(spark, d, "documents").select("doc_id", format_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("""SELECT doc_id, CASE WHEN n_chars IS NULL OR n_chars <= 0 THEN 'unknown duration' WHEN n_chars >= 3600 THEN (n_chars // 3600) || 'h ' || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN n_chars >= 60 THEN (n_chars // 60) || 'm ' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') || 's' ELSE n_chars || 's' END AS duration FROM documents""")
def format_durations(spark, d):
    return read(spark, d, "documents").select("doc_id", format_duration(F.col("n_chars")).alias("duration"))


@query("SELECT doc_id, CASE WHEN b >= 1000000 THEN printf('%.1f Mbps', b / 1000000.0) ELSE printf('%.0f Kbps', b / 1000.0) END AS rate FROM (SELECT doc_id, n_chars * 977 + 1 AS b FROM documents)")
def format_bitrates(spark, d):
    return read(spark, d, "documents").select("doc_id", format_bitrate(F.col("n_chars") * 977 + 1).alias("rate"))


@query(f"""SELECT 'exact' AS phase, count(*) AS actions FROM ({_RANKED}) WHERE n > 1 AND rank > 1 UNION ALL SELECT 'merge', count(*) FROM ({_MERGES})
UNION ALL SELECT 'convert', count(*) FROM ({_CODECS}) WHERE ext <> '.mp4' OR readable AND NOT target""")
def pipeline_summary(spark, d):
    count = lambda df, phase: df.agg(F.count("*").alias("actions")).select(F.lit(phase).alias("phase"), "actions")
    return count(exact_keep_remove(spark, d).where("rank > 1"), "exact").unionByName(count(_merge_groups(spark, d), "merge")).unionByName(count(conversion_candidates(spark, d).where("needs_work"), "convert"))
