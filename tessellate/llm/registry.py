"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, licenses, maxent, media, pieces, ranking, secrets, simhash, suffixes, tiling, tokens, urls
from .common import load


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 1 << 18)  # nothing else holds the workers' memory here


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(load(spark, sf_dir, "documents"), keep=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language.language_id(docs, language.train(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(load(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(load(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(load(spark, sf_dir, "documents"), stored_form=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(load(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.lm_scores(load(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_suffix_dedup, op3_language_id, op4_simhash, op5_url_filter, op6_license_scan, op7_media_columns, op8_decontamination, op9_secret_scan, op10_token_counts, op11_lm_scoring, op12_ranked_search)}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": urls.oracle(), "op12_ranked_search": ranking.oracle()}
