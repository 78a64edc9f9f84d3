"""The queries opN_<name> over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.llm import oracles
from cinegraph.llm.common import table
from cinegraph.llm.decontaminate import find_leaks
from cinegraph.llm.html_main import extract, fit
from cinegraph.llm.ngram_join import jaccard_components
from cinegraph.llm.pii import KINDS as PII_KINDS
from cinegraph.llm.pii import find_pii
from cinegraph.llm.quality_rules import apply_rules
from cinegraph.llm.repeated_phrases import remove_repeats
from cinegraph.llm.secrets import KINDS as SECRET_KINDS
from cinegraph.llm.secrets import find_secrets
from cinegraph.llm.source_mix import mix
from cinegraph.llm.spans import digest_text
from cinegraph.llm.token_frames import tokenize_to_frames
from cinegraph.llm.url_filter import filter_urls

#: The rules of the URL contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The list that op9 uses where none is given: sorts of unwanted hosts under the names that are reserved for documentation and tests. The
#: tables hold no list; a list of one's own is an argument of filter_urls.
UNWANTED = ("ads", "adserver", "casino", "gambling", "malware", "phishing", "pills", "spam", "tracker", "warez")
LISTED_HOSTS = [f"{name}.{top}" for name in UNWANTED for top in ("example", "example.com", "example.net", "example.org", "invalid", "test")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 3).alias("cosine"), F.round("share", 4).alias("share"), "start", "end")


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_frames(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).drop("shard")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")


def _span_digest(found: DataFrame, kinds, base: str, spans: str, by_kind: bool) -> DataFrame:
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(digest_text(F.col(base), by_kind), 256).alias("base_sha256"), digest_text(F.col(spans), by_kind).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")), PII_KINDS, "_pii_base", "_pii_spans", True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), SECRET_KINDS[:3], "_sec_base", "_sec_spans", False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"_qr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    blocked = spark.createDataFrame([(h, "/") for h in LISTED_HOSTS], "host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, blocked).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_frames": op2_token_frames,
    "op3_source_mix": op3_source_mix,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_repeated_phrases": op6_repeated_phrases,
    "op7_html_main": op7_html_main,
    "op8_secrets": op8_secrets,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_join": op10_ngram_join,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": oracles.QUALITY,
    "op6_repeated_phrases": oracles.PHRASES,
    "op9_url_filter": oracles.url_sql(URL_RULES, LISTED_HOSTS),
    "op10_ngram_join": oracles.SIMILAR,
}
