"""More queries of the catalogue: names, probes, the index, signatures, tag suggestions and plans over stand-in rows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinegraph.functions.names import standardize_stem
from cinegraph.operators.conversion import conversion_attempts, fits_budget
from cinegraph.operators.duplicates import quality_score
from cinegraph.operators.media_index import cache_hits, stale, upsert
from cinegraph.operators.naming import temporary_name, unique_names, work_name
from cinegraph.operators.parts import part_files
from cinegraph.operators.similarity import near_hashes
from cinegraph.operators.tags import suggest_tags
from cinegraph.plans import actions
from cinegraph.plans.catalogue import _MERGES, _NAMED, _RANKED, _RUNS, _named, _standard_sql, query, read
from cinegraph.sources.frames import frame_offsets, hash_to_hex, hex_to_hash
from cinegraph.sources.library import VIDEO_EXTENSIONS, is_hidden, is_video
from cinegraph.sources.probe import aspect_ratio, with_metadata

_LIST = "[" + ", ".join(f"'{x}'" for x in VIDEO_EXTENSIONS) + "]"


@query(f"""SELECT p_partkey, list_contains({_LIST}, lower(regexp_extract(name, '.(\\.[^.]+)$', 1))) AS video, name LIKE '.%' AS hidden FROM
(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END || p_name || ['.MP4', '.mkv', '.txt', '', '.mpeg', '.ts2'][p_partkey % 6 + 1] AS name FROM part)""")
def scan_predicates(spark, d):
    key = F.col("p_partkey")
    ending = F.get(F.array(*[F.lit(x) for x in (".MP4", ".mkv", ".txt", "", ".mpeg", ".ts2")]), (key % 6).cast("int"))
    names = read(spark, d, "part").select("p_partkey", F.concat(F.when(key % 5 == 0, ".").otherwise(""), "p_name", ending).alias("name"))
    return names.select("p_partkey", is_video(F.col("name")).alias("video"), is_hidden(F.concat(F.lit("/lib/"), "name")).alias("hidden"))


@query("""SELECT o_orderkey, CAST(CASE WHEN k = 0 THEN NULL ELSE o_custkey END AS DOUBLE) AS width, CAST(CASE WHEN k = 0 THEN NULL ELSE 1080 END AS DOUBLE) AS height, CAST(CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 5000 ELSE o_orderkey * 10 END AS DOUBLE) AS bit_rate,
 CASE WHEN k IN (0, 2) THEN NULL ELSE CAST(o_orderkey AS DOUBLE) / 2 END AS duration_sec, CASE WHEN k = 0 THEN NULL ELSE 'h264' END AS video_codec, CASE WHEN k IN (0, 3) THEN NULL ELSE 'aac' END AS audio_codec, k <> 0 AS readable,
 CASE WHEN k = 0 OR o_custkey = 0 THEN NULL ELSE round(o_custkey / 1080, 6) END AS aspect FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""")
def probe_metadata(spark, d):
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 5
    rate = F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit(', "bit_rate": "'), (key * 10).cast("string"), F.lit('"')))
    video = F.concat(F.lit('{"codec_type": "video", "codec_name": "h264", "height": 1080, "width": '), F.col("o_custkey").cast("string"), rate, F.lit("}"))
    audio = F.when(k == 3, "").otherwise(', {"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "audio", "codec_name": "mp3"}')
    length = F.when(k == 2, '"N/A"').otherwise(F.concat(F.lit('"'), (key / 2).cast("string"), F.lit('"')))
    report = F.concat(F.lit('{"streams": ['), video, audio, F.lit('], "format": {"bit_rate": "5000", "duration": '), length, F.lit("}}"))
    files = read(spark, d, "orders").select("o_orderkey", F.when(k == 0, F.when(key % 2 == 0, "no report")).otherwise(report).alias("probe"))
    found = with_metadata(files)
    return found.withColumn("aspect", F.round(aspect_ratio(F.col("width"), F.col("height")), 6)).withColumns({c: F.col(c).cast("double") for c in ("width", "height", "bit_rate")})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false ELSE o_totalprice * 1000 / 1048576 <= 150 END AS fits FROM orders""")
def size_budget(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fits_budget(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") * 1000), 150).alias("fits"))


@query("""SELECT p_partkey, coalesce(w, 0) * 720 AS pixels, CAST(p_size * 1000 AS BIGINT) AS bit_rate, CAST(floor(p_retailprice) AS BIGINT) AS seconds, CASE WHEN w <> 0 THEN round(w / 720, 6) END AS aspect
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(p_size * 40 AS BIGINT) END AS w FROM part)""")
def quality_scores(spark, d):
    k = F.col("p_partkey") % 4
    rows = read(spark, d, "part").withColumn("w", F.when(k == 1, 0).when(k > 1, F.col("p_size") * 40))
    score = quality_score(F.col("w"), F.lit(720), F.col("p_size") * 1000, F.col("p_retailprice"))
    return rows.select("p_partkey", score.alias("q"), F.round(aspect_ratio(F.col("w"), F.lit(720)), 6).alias("aspect")).select("p_partkey", "q.*", "aspect")


@query("""WITH planned AS (SELECT p_partkey, p_brand AS parent, 'Film ' || (p_size % 5) AS stem, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS place FROM part),
 used AS (SELECT p_brand AS parent, 'Film ' || (p_size % 5) AS stem, list(DISTINCT CASE WHEN p_partkey % 8 = 0 THEN 2 + p_partkey % 3 ELSE 1 END) AS used FROM part WHERE p_partkey % 4 = 0 GROUP BY 1, 2)
SELECT p_partkey, stem || CASE WHEN n = 1 THEN '' ELSE '__' || n END || '.mp4' AS unique_name FROM (SELECT p_partkey, p.stem, list_filter(range(1, place + coalesce(len(used), 0) + 1), lambda i: NOT list_contains(coalesce(used, []), i))[place] AS n
FROM planned p LEFT JOIN used u ON p.parent = u.parent AND p.stem = u.stem)""")
def unique_output_names(spark, d):
    part, film = read(spark, d, "part"), F.concat(F.lit("Film "), (F.col("p_size") % 5).cast("string"))
    planned = part.select("p_partkey", F.col("p_brand").alias("parent"), F.concat(film, F.lit(".mp4")).alias("name"))
    mark = F.when(F.col("p_partkey") % 8 == 0, F.concat(F.lit("__"), (2 + F.col("p_partkey") % 3).cast("string"))).otherwise("")
    taken = part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("parent"), F.concat(film, mark, F.lit(".mp4")).alias("name"))
    return unique_names(planned, taken, ["p_partkey"]).select("p_partkey", "unique_name")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'free' ELSE '.cinegraph_convert' || CASE WHEN p_partkey % 2 = 0 THEN '_2' ELSE '' END || '.mp4' END WHEN p_partkey % 2 = 0 THEN 'free' ELSE 'target' END AS work FROM part""")
def work_paths(spark, d):
    k = F.col("p_partkey")
    temporary = temporary_name(F.when(k % 2 == 0, 2).otherwise(0))
    return read(spark, d, "part").select("p_partkey", work_name(k % 3 == 0, k % 2 == 0, F.lit("target"), F.lit("free"), temporary, k % 5 == 0).alias("work"))


_FORMS = ("_part_", "_pt_", "_cd", "-CD", "_disc", " ", "-")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, '/lib/' || l_returnflag AS parent, 'T' || l_partkey || [{", ".join(f"'{x}'" for x in _FORMS)}][k + 1] AS prefix, '' AS suffix, CAST(l_suppkey AS BIGINT) AS part
FROM (SELECT *, (l_linenumber + l_partkey) % 9 AS k FROM lineitem) WHERE k < 7""")
def part_file_names(spark, d):
    k = (F.col("l_linenumber") + F.col("l_partkey")) % 9
    form = F.get(F.array(*[F.lit(x) for x in (*_FORMS, "_part_1to", "x")]), k.cast("int"))
    path = F.concat(F.lit("/lib/"), "l_returnflag", F.lit("/T"), "l_partkey", form, "l_suppkey", F.when(k == 8, "x").otherwise(""), F.lit(".mkv"))
    return part_files(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", path.alias("path"))).withColumn("part", F.col("part").cast("long")).drop("path")


@query("""SELECT doc_id, CAST(len(sig) AS BIGINT) AS frames, sig[1] AS first_hash, sig[8] AS middle_hash, sig[-1] AS last_hash FROM (SELECT doc_id, CASE WHEN n_chars > 0 THEN list_transform(range(15),
 lambda i: ('0x' || substr(md5(substr(text, 1 + CAST(floor(n_chars::DOUBLE * 0.1::DOUBLE + (n_chars::DOUBLE * 0.9::DOUBLE - n_chars::DOUBLE * 0.1::DOUBLE) / 14 * i) AS BIGINT), 16)), 1, 15))::BIGINT) ELSE [] END AS sig FROM documents)""")
def frame_windows(spark, d):
    at = F.transform(frame_offsets(F.col("n_chars").cast("double")), lambda x: F.floor(x).cast("int"))
    hashes = F.transform("at", lambda x: F.conv(F.substr(F.md5(F.substr(F.col("text"), x + 1, F.lit(16))), F.lit(1), F.lit(15)), 16, -10).cast("long"))
    signed = read(spark, d, "documents").withColumn("at", at).select("doc_id", hashes.alias("sig"))
    return signed.select("doc_id", F.size("sig").cast("long").alias("frames"), F.get("sig", F.lit(0)).alias("first_hash"), F.get("sig", F.lit(7)).alias("middle_hash"), F.try_element_at("sig", F.lit(-1)).alias("last_hash"))


@query("""SELECT doc_id, h AS hex, true AS same FROM (SELECT doc_id, substr(md5(text), 1, 16) AS h FROM documents)""")
def hash_serialization(spark, d):
    rows = read(spark, d, "documents").select("doc_id", hex_to_hash(F.substr(F.md5("text"), F.lit(1), F.lit(16))).alias("h"))
    return rows.select("doc_id", hash_to_hex(F.col("h")).alias("hex"), (hex_to_hash(hash_to_hex(F.col("h"))) == F.col("h")).alias("same"))


def _sign_hash(start: int, n: int):
    """The signs of n numbers of the embedding as the bits of one."""
    bit = lambda i: F.when(F.element_at("embedding", i + start + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("bigint"), lambda acc, i: acc + bit(i))


_BITS = 63


@query(f"""WITH h AS (SELECT vec_id, CAST(list_sum(list_transform(range({_BITS}), lambda i: CASE WHEN embedding[CAST(i + 1 AS INTEGER)] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS h FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.h, y.h)) <= 14""")
def embedding_hash_pairs(spark, d):
    return near_hashes(read(spark, d, "embeddings").select("vec_id", _sign_hash(0, _BITS).alias("h")), "vec_id", "h", 14, _BITS)


@query("""WITH e AS (SELECT vec_id, label, 100 + vec_id % 10 AS dur, 1.5 AS asp, list_transform(range(4), lambda q: CAST(list_sum(list_transform(range(16), lambda i: CASE WHEN embedding[CAST(16 * q + i + 1 AS INTEGER)] > 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)) AS sig FROM embeddings),
 c AS (SELECT * FROM e WHERE vec_id % 2 = 0), t AS (SELECT * FROM e WHERE vec_id % 2 = 1),
 p AS (SELECT label, median(dur) AS md, median(asp) AS ma, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3),
 b AS (SELECT c.vec_id, t.label, list_transform(c.sig, lambda x: list_min(list_transform(t.sig, lambda y: bit_count(xor(x, y))))) AS best FROM c, t),
 s AS (SELECT vec_id, label, median(list_avg(best)) AS distance, median(len(list_filter(best, lambda x: x <= 8)) / len(best)) AS ratio FROM b GROUP BY 1, 2),
 f AS (SELECT s.vec_id, s.label, distance, ratio, n, abs(dur - md) / md + abs(asp - ma) AS fit FROM s JOIN p USING (label) JOIN c USING (vec_id)),
 r AS (SELECT *, distance + 10 * fit AS combined, row_number() OVER w AS k, lead(distance + 10 * fit) OVER w - (distance + 10 * fit) AS margin FROM f WINDOW w AS (PARTITION BY vec_id ORDER BY distance + 10 * fit, fit, ratio DESC, n DESC, CAST(label AS VARCHAR))),
 l AS (SELECT *, CASE WHEN distance <= 8 AND fit <= 0.25 AND ratio >= 0.6 AND n >= 5 AND margin >= 2 THEN 'high' WHEN distance <= 12 AND fit <= 0.45 AND ratio >= 0.45 THEN 'medium' WHEN distance <= 12 AND fit <= 0.6 AND ratio >= 0.35 THEN 'low' END AS confidence FROM r WHERE k = 1)
SELECT vec_id, CAST(label AS VARCHAR) AS tag, round(distance, 6) AS distance, round(fit, 6) AS fit, round(ratio, 6) AS good_ratio, n AS sample_count, confidence, round(margin, 6) AS margin FROM l WHERE confidence IS NOT NULL""")
def tag_suggestions(spark, d):
    files = read(spark, d, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 2 == 1, F.col("label").cast("string")).alias("tag"), F.array(*[_sign_hash(16 * q, 16) for q in range(4)]).alias("signature"), (100 + F.col("vec_id") % 10).cast("double").alias("duration"), F.lit(1.5).alias("aspect")
    )
    found = suggest_tags(files, item="vec_id")
    return found.select("vec_id", "tag", *[F.round(c, 6).alias(c) for c in ("distance", "fit", "good_ratio")], "sample_count", "confidence", F.round("margin", 6).alias("margin"))


@query("""SELECT coalesce(c_custkey, s_suppkey * 4) AS path, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal <> c_acctbal THEN NULL ELSE c_mktsegment END AS exact_hash, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS BIGINT) END, CAST(c_nationkey AS BIGINT)) AS width,
 coalesce(s_acctbal, c_acctbal) AS content_fingerprint, CASE WHEN s_suppkey IS NOT NULL THEN 'now' ELSE 'then' END AS updated_at FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 4""")
def index_merge(spark, d):
    index = read(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("exact_hash"), F.col("c_nationkey").cast("long").alias("width"), F.col("c_acctbal").alias("content_fingerprint"), F.lit("then").alias("updated_at"))
    updates = read(spark, d, "supplier").select((F.col("s_suppkey") * 4).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("long")).alias("width"), F.col("s_acctbal").alias("content_fingerprint"))
    return upsert(index, updates, fingerprint="content_fingerprint", stamp=F.lit("now"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AND c_nationkey < 20 AS scan_hit, c_custkey % 3 <> 0 AS content_hit, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS signature_hit FROM customer""")
def index_cache_hits(spark, d):
    customers = read(spark, d, "customer")
    nation = F.col("c_nationkey")
    files = customers.select(F.col("c_custkey").alias("path"), nation.cast("string").alias("quick_fingerprint"), nation.cast("string").alias("content_fingerprint"))
    held = customers.where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("path"), (nation % 20).cast("string").alias("quick_fingerprint"), nation.cast("string").alias("content_fingerprint"),
        F.when(F.col("c_custkey") % 4 != 0, F.array(F.lit("00ff"))).otherwise(F.array().cast("array<string>")).alias("perceptual_hashes"), F.lit(15).alias("perceptual_num_frames"),
    )
    return cache_hits(files, held, frames=15).select(F.col("path").alias("c_custkey"), "scan_hit", "content_hit", "signature_hit")


@query("SELECT count(*) AS dropped FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def index_pruned_count(spark, d):
    found = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return stale(read(spark, d, "orders"), found, "o_custkey").agg(F.count("*").alias("dropped"))


@query("""SELECT CAST(k AS INTEGER) AS attempt, remux, CASE WHEN remux AND k = 0 THEN 'ffmpeg -hide_banner -nostats -loglevel error -y -i a.mkv -map 0:v:0? -map 0:a? -map 0:s? -c copy -c:s mov_text b.mp4'
 ELSE 'ffmpeg -hide_banner -nostats -loglevel error -y -i a.mkv -map 0:v:0? -map 0:a? -map 0:s? -c:v libx264 -crf ' || least(32, 30 + 2 * k) || ' -preset slow -c:a aac -b:a 192k -c:s mov_text' || CASE WHEN k > 1 THEN ' -vf scale=trunc(iw*' || round(pow(0.9, k - 1), 6) || '/2)*2:-2' ELSE '' END || ' b.mp4' END AS command
FROM range(10) r(k), (VALUES (true), (false)) t(remux) WHERE k <= 1 OR pow(0.9, k - 2) > 0.5""")
def conversion_commands(spark, d):
    work = spark.createDataFrame([("a.mkv", "b.mp4", True), ("a.mkv", "b.mp4", False)], "src string, dst string, remux boolean")
    return conversion_attempts(work, 30, 1.0, 100.0, "slow").select("attempt", "remux", F.array_join("command", " ").alias("command"))


_KEPT = f"SELECT r.path, r.digest, r.size_bytes, k.path AS keep FROM ({_RANKED}) r JOIN ({_RANKED}) k ON r.digest = k.digest AND k.rank = 1 WHERE r.n > 1 AND r.rank > 1"


def _files(spark, d):
    return _named(spark, d).select("path", "size_bytes", F.col("digest").alias("exact_hash"))


@query(f"SELECT 'exact' AS phase, 'trash' AS op, digest AS group_id, path AS src, keep AS dst, size_bytes, NOT (digest LIKE 'a%') AS approved FROM ({_KEPT})")
def plan_exact_duplicates(spark, d):
    plan = actions.plan_exact(_files(spark, d))
    no = plan.where(F.startswith("group_id", F.lit("a"))).select("phase", "group_id", F.lit(False).alias("approve"), F.lit(None).cast("string").alias("keep")).distinct()
    return actions.decide(plan, no).select("phase", "op", "group_id", "src", "dst", "size_bytes", "approved")


@query(f"SELECT path FROM ({_NAMED}) WHERE path NOT IN (SELECT path FROM ({_KEPT}))")
def plan_remaining_files(spark, d):
    files = _files(spark, d)
    return actions.remaining(files, actions.plan_exact(files)).select("path")


@query(f"SELECT '/lib/O' || l_orderkey || '_part_' || start_part || 'to' || end_part || '.mp4' AS dst, n_parts, CASE WHEN bad = 0 THEN 'merge' ELSE 'skip' END AS op, bad = 0 AS approved FROM ({_MERGES.replace('SELECT l_orderkey, CAST(n AS', 'SELECT l_orderkey, bad, CAST(n AS').replace('count(*) AS n,', 'count(*) AS n, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS bad,').replace(_RUNS, _RUNS.replace('FROM lineitem', 'FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey)', 1))})")
def plan_merge_parts(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_quantity", F.struct("l_quantity", "l_partkey", "l_suppkey")).alias("q"))
    files = lines.select(F.concat(F.lit("/lib/O"), "l_orderkey", F.lit("_part_"), "l_linenumber", F.lit(".mkv")).alias("path"), F.col("q").alias("duration_sec"), (F.col("q") <= 45).alias("readable"), F.lit(1).cast("long").alias("size_bytes"))
    return actions.plan_merge(files).select("dst", F.size("sources").cast("long").alias("n_parts"), "op", "approved")


@query(f"""SELECT op, count(*) AS actions FROM (SELECT CASE WHEN (ext <> '.mp4' OR readable AND NOT target) AND NOT readable THEN 'skip' WHEN NOT (ext <> '.mp4' OR readable AND NOT target) THEN 'rename' WHEN ext <> '.mp4' AND target THEN 'remux' ELSE 'convert' END AS op
FROM (SELECT p_partkey, ['.mp4', '.mkv'][p_partkey % 2 + 1] AS ext, p_partkey % 5 <> 0 AS readable, p_size > 25 AS target, {_standard_sql("'x' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' copy' ELSE '' END")} <> 'x' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' copy' ELSE '' END AS odd FROM part)
WHERE ext <> '.mp4' OR odd OR readable AND NOT target) GROUP BY 1""")
def plan_standardize_files(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("/lib/x"), k, F.when(k % 3 == 0, " copy").otherwise(""), F.when(k % 2 == 1, ".mkv").otherwise(".mp4"))
    files = read(spark, d, "part").select(name.alias("path"), F.lit(5).cast("long").alias("size_bytes"), (k % 5 != 0).alias("readable"), F.when(F.col("p_size") > 25, "h264").otherwise("vp9").alias("video_codec"), F.lit("aac").alias("audio_codec"))
    return actions.plan_standardize(files).groupBy("op").agg(F.count("*").alias("actions"))


@query(f"SELECT p_partkey, {_standard_sql('name')} AS standard FROM (SELECT p_partkey, ['Movie (1)', 'M（1）', 'a copy copy b', '「X」y', ' .. ', 'Dune (2021) (2)', 'A[b]c(d)e', 'duplicate'][p_partkey % 8 + 1] AS name FROM part)")
def standardize_odd_names(spark, d):
    names = [F.lit(x) for x in ("Movie (1)", "M（1）", "a copy copy b", "「X」y", " .. ", "Dune (2021) (2)", "A[b]c(d)e", "duplicate")]
    return read(spark, d, "part").select("p_partkey", F.get(F.array(*names), (F.col("p_partkey") % 8).cast("int")).alias("name")).select("p_partkey", standardize_stem(F.col("name")).alias("standard"))
