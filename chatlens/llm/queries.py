"""The registered queries of this subpackage, each over its whole table, and their DuckDB counterparts."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    conversation_repair,
    decontamination,
    jaccard_join,
    license_templates,
    merkle_manifest,
    quality_classifier,
    quality_rules,
    retrieval_packing,
    secret_ownership,
    substring_dedup,
    token_transducer,
    two_fit_packing,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.scan_secrets(_table(spark, sf_dir, "documents")).drop(
        "found", "text_key"
    )


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keys(values):
        return spark.createDataFrame([(v,) for v in values], "key string")

    rules = {verdict: keys(values) for verdict, values in url_filter.RULES.items()}
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, rules, url_filter.family_keys(pages)).drop("listed")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_repeats(_table(spark, sf_dir, "documents")).drop("repeats")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents")).drop("text_key")


def op8_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labelled = quality_classifier.labelled_texts(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, labelled)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.line_breaks_removed(_table(spark, sf_dir, "documents")).drop("proof")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def op13_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit_packing.pack(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


QUERIES: dict[str, Query] = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_license_templates": op2_license_templates,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_transducer": op8_token_transducer,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_two_fit_packing": op13_two_fit_packing,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
}
