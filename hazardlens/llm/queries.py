"""The subpackage's registered queries over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import ann, conversations, decontaminate, jaccard_join, maxent, mixing, quality, secret_scan, substring_dedup, suffix_dedup, surrogates
from hazardlens.llm import token_align, url_filter
from hazardlens.llm.common import documents
from hazardlens.llm.oracles import oracle_sql  # noqa: F401  the entry module takes both from here


def op8_suffix_dedup(spark, sf):
    out = suffix_dedup.dedup(documents(spark, sf))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark, sf):
    out = substring_dedup.dedup(documents(spark, sf))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Blocks that each source gives of every 105: the hot source is held near the share of the others.
TARGETS = {"src0": 8, mixing.OTHER: 2, **{f"src{i}": 5 for i in range(1, 20)}}


#: A deployment gives its own secret; with this one the queries' results can be compared.
SURROGATE_KEY = b"registered query"


def op1_pii_surrogates(spark, sf):
    return surrogates.replace(documents(spark, sf).select("doc_id", "text"), SURROGATE_KEY)


def op3_maxent_lm(spark, sf):
    return maxent.fit_and_score(documents(spark, sf))


def op2_decontamination(spark, sf):
    return decontaminate.leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op4_quality_classifier(spark, sf):
    return quality.classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op5_ann_hnsw(spark, sf):
    return ann.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op7_pfair_mixing(spark, sf):
    return mixing.mix(documents(spark, sf), TARGETS, keep=("doc_id", "source"))


def op6_secret_scan(spark, sf):
    out = secret_scan.scan(documents(spark, sf))
    joined = lambda c: F.array_join(c, ",")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), "n_weak"
    )


def op10_jaccard_join(spark, sf):
    return jaccard_join.link(documents(spark, sf), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


# The rules that pages are judged by.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

TOKENIZERS = "/opt/tokenizers"


def op11_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"), rules).select("page_id", *url_filter.RESULTS)


def op12_conversation_repair(spark, sf):
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf}/conversations.parquet")))


def op13_token_align(spark, sf):
    out = token_align.align(documents(spark, sf), token_align.tokenizer_files(TOKENIZERS))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_pii_surrogates, op2_decontamination, op3_maxent_lm, op4_quality_classifier, op5_ann_hnsw, op6_secret_scan, op7_pfair_mixing, op8_suffix_dedup, op9_substring_dedup, op10_jaccard_join, op11_url_filter, op12_conversation_repair, op13_token_align)}
