"""Registered queries of the training-data operators: name -> (Spark query, SQL counterpart or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.llm import (
    chat, exact_dedup, fill_middle, importance, language, mixing, near_dedup, quality_model, quality_rules,
    sentence_pieces, simhash, sql, token_counts, toxicity,
)
from fluxlake.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, whose texts imitate the marks of templates."""
    hostile = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(hostile))
    return chat.read_back(chat.chat_windows(rows.unionByName(more)))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, sql.EXACT),
    "op2_quality_rules": (op2_quality_rules, sql.RULES),
    "op3_chat_windows": (op3_chat_windows, sql.CHAT),
    "op4_mix_sources": (op4_mix_sources, sql.MIX),
    "op5_language_id": (op5_language_id, None),
    "op6_minhash_near_dedup": (op6_minhash_near_dedup, sql.NEAR),
    "op7_toxicity_chain": (op7_toxicity_chain, None),
    "op8_sentence_pieces": (op8_sentence_pieces, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_quality_classifier": (op10_quality_classifier, None),
    "op11_simhash_near_dedup": (op11_simhash_near_dedup, None),
    "op12_importance_resampling": (op12_importance_resampling, sql.IMPORTANCE),
    "op13_fill_in_middle": (op13_fill_in_middle, sql.FILL),
}
