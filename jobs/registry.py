"""The jobs as queries over whole tables: run twice into one new folder, and what stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import evaluation_report, index_refresh
from tessellate import oracles
from tessellate.operators import index
from tessellate.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the index after two runs over documents; the second finds nothing new."""
    top, sf = _folder(spark, "job1"), sf_dir.rstrip("/")
    for _ in range(2):
        index_refresh.run(spark, f"{sf}/documents.parquet", f"{top}/index", f"{top}/checkpoint")
    return index.postings(spark, f"{top}/index").select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


def job2_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of the report after two runs."""
    top, sf = _folder(spark, "job2"), sf_dir.rstrip("/")
    for _ in range(2):
        evaluation_report.run(spark, *(f"{sf}/{name}.parquet" for name in ("documents", "benchmark", "labels")), top)
    rows = spark.read.parquet(f"{top}/cases")
    return rows.select("retriever", "case_id", "type", "retrieval_hit", "e2e_answer", "oracle_answer_ok", "diagnosis")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_refresh, job2_evaluation_report)}

_CASES = oracles.DONE + " SELECT '{0}' AS retriever, case_id, type, retrieval_hit, answer AS e2e_answer, oracle_answer_ok, diagnosis FROM done"
ORACLE_SQL: dict[str, str] = {
    "job1_index_refresh": oracles.SQL["postings"],
    "job2_evaluation_report": " UNION ALL ".join(f"SELECT * FROM (WITH {_CASES.replace('{0}', name).replace(oracles.BM25, oracles.retrieval('bm25', words))})" for name, words in (("bm25", oracles.content), ("expanded_bm25", oracles.expanded))),
}
