"""From documents to an ordered training mix: five stages, each a written table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import decontaminate, jaccard_join, mixing, quality, secret_scan
from hazardlens.llm.common import documents, written
from hazardlens.llm.queries import TARGETS

#: Kneser-Ney perplexities and earliest-deadline-first order have no SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not above their language's threshold."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, width=5, num=80, den=100)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item; a text decides for all its rows."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaked = written(decontaminate.leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(leaked, F.xxhash64("text") == F.col("_leaked"), "left_anti")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their reported secrets, identifiers and endpoints masked; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a mix of the sources by their target weights."""
    return mixing.mix(docs, TARGETS, keep=tuple(docs.columns))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmarks),
    ("secrets", secrets_masked),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
