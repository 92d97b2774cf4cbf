"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketworks.llm.common import documents, embeddings, ready, sha256_or_empty
from wicketworks.llm.conversations import damaged, repair, with_unrepaired
from wicketworks.llm.embeddings import near_vectors
from wicketworks.llm.language import held_out, identify_language
from wicketworks.llm.lexical import rank_documents
from wicketworks.llm.lines import dedup_lines
from wicketworks.llm.mixing import mix_sources
from wicketworks.llm.neardup import near_duplicates
from wicketworks.llm.packing import pack, public_tokenizer
from wicketworks.llm.passages import dedup_passages
from wicketworks.llm.pii import replace_pii
from wicketworks.llm.search import sign_code, top_k
from wicketworks.llm.substrings import dedup_substrings
from wicketworks.llm.urls import filter_urls, rule_table

RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizer())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_units", "spans", F.col("kept").alias("text"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", sha256_or_empty(F.col("kept")).alias("kept_sha256")
    )


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A run on real data sets a key of its own; the one here makes reruns of the check agree.
    key = spark.conf.get("spark.wicketworks.surrogate.key", "key of the check")
    found = replace_pii(documents(spark, sf_dir).select("doc_id", "text"), key)
    return found.select("row.doc_id", F.size("types").cast("long").alias("n_entities"), "types", F.col("replaced").alias("text"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4).drop("text_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    away = held_out(F.col("doc_id"))
    found = identify_language(docs.select("doc_id", "text"), docs.where(~away).select("text", "lang"))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where(F.col("id") % 100 == 0)).withColumnRenamed("id", "vec_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ready(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return with_unrepaired(repair(damaged(rows)), rows)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_substring_dedup,
        op3_suffix_array_dedup,
        op4_line_dedup,
        op5_pii_surrogates,
        op6_embedding_near_dedup,
        op7_mix_sources,
        op8_minhash_near_dedup,
        op9_language_id,
        op10_exact_top_k,
        op11_conversation_repair,
        op12_url_filters,
        op13_ranked_search,
    )
}
