"""A corpus pipeline of five stages; each stage's rows are written and read again by the next.

1. quality rules: documents that break a rule go;
2. n-gram Jaccard join: of each group of near copies the document with the least id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. mixing sources: documents are repeated or left out to meet the target of their source;
5. token ids: the mix is written as frames and read back.

Null ids: a document without an id is a group of its own in stage 2: it stays, and links no others. Rows that share an id
are compared each by its own text; those of a group's least id all stay. An empty
table stays empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinegraph.llm.common import scratch_path, table
from cinegraph.llm.decontaminate import drop_leaks
from cinegraph.llm.ngram_join import keep_first
from cinegraph.llm.quality_rules import keep_good
from cinegraph.llm.queries import tokenizer_path
from cinegraph.llm.source_mix import mix, repeat_documents
from cinegraph.llm.token_frames import tokenize_to_frames
from cinegraph.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_documents(docs, mix(docs.select("doc_id", "text", "source")))


def token_frames(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return tokenize_to_frames(docs.select("doc_id", "text"), tokenizer_path()).drop("shard")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token frames", token_frames),
]

#: The stages solve a dual, compare whole sets and encode with a tokenizer, which SQL cannot. A test compares run() with plain Python:
#: which documents come out, their ids and order exactly, and each source's words with its target.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
