"""A corpus pipeline of five stages, each over what the one before kept.

Stages take (spark, docs, sf_dir); run() writes each result as Parquet to the shared
folder and reads it again.  All but the last keep the columns of documents, whatever their names.

Defined cases: an empty table gives an empty one in each stage; a null or blank text has no
letter, so language ID removes it; a null doc_id stays null; texts of any length are read whole;
of near-duplicates the row of the smallest doc_id stays, of equal rows one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellate.llm import language, pieces, secrets, simhash, tiling
from tessellate.llm.common import load, stored
from tessellate.llm.registry import tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of whose letters no language has half."""
    return language.accepted(docs, language.train(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: that
    of the smallest doc_id, or one without doc_id if none has any.  Rows are judged, not ids."""
    return simhash.without_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    return tiling.clean(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, without the secrets in their texts."""
    return secrets.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document's text, and whether they give it back."""
    return pieces.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("SentencePiece encoding", encoding_stage),
]

ORACLE_SQL = None  # language models, fingerprints and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
