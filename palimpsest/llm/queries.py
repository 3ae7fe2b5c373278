"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe_duckdb, decontaminate, hard_negatives, language_id, merkle, near_dup, quality_model, quality_rules, sharding, suffix_lm, token_binary, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_model.digest(quality_model.score(docs, model), 0.5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.sample_edits(_table(spark, sf_dir, "documents"))
    return token_counts.edited_counts(edited, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score_texts(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_model.digest(toxicity.score(docs, net), 0.7)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_duckdb.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_token_binary": op5_token_binary,
    "op6_suffix_lm": op6_suffix_lm,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op2_minhash_near_dedup": near_dup.oracle_sql(),
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op13_hard_negatives": hard_negatives.oracle_sql(),
}
