"""A training corpus from raw documents: quality, exact copies, near copies, mix, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each as Parquet and
reads it back for the next. All but the last return the columns of ``documents``.

No SQL counterpart: the classifier, the hashes of the near-copy search and the tokenizer are not
expressible in it; the tests hold the result against a plain Python version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fluxlake.llm import exact_dedup, mixing, near_dedup, quality_model, sentence_pieces
from fluxlake.llm.common import table
from fluxlake.session import drop_scratch, materialize, prepare, scratch_mark


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels come from ``labels``."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of exact copies."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every row."""
    return sentence_pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("source mix", mixed),
    ("sentencepiece", tokenised),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input and intermediate tables go when its result is written."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark()
    for name, stage in STAGES:
        docs = materialize(stage(prepare(spark), docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_scratch(spark, mark, keep=docs)
    return docs
