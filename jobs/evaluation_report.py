"""Evaluates retrieval and answers of a question set over a corpus, and writes the report as tables.

    python -m jobs.evaluation_report --documents PATH --items PATH --labels PATH --out PATH [--config FILE]

Each retriever is run over all documents for all items; contexts, extractive answers, attribution,
scores and diagnoses follow, once with what was retrieved and once with the documents that hold
the item.  Below `out`, for each retriever R:

    cases/retriever=R/diagnosis=D    a row for each item, by the cause found
    summary/retriever=R              metric, type (null: all), value
    run/retriever=R                  the settings, and what was read and written

Each retriever's tables replace those of an earlier run as a whole, so a run that is broken off or
made twice leaves the same; retrievers that are not asked for stay as they are.  `run` is written
last: where its settings are older than `cases`, the run was broken off.

Settings (jobs/evaluation_report.json): retrievers; judge: lexical, conservative or structured; k:
documents in a context; item_id and text: the items' columns.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, configured, main, observed
from tessellate.operators import answer as A
from tessellate.operators import metrics as M
from tessellate.operators.judge import JUDGES
from tessellate.operators.retrieve import RETRIEVERS
from tessellate.plans.evaluate import score
from tessellate.queries import containing, made_cases
from tessellate.session import spread, stored

DEFAULTS = {"retrievers": ["bm25", "expanded_bm25"], "judge": "conservative", "k": 3, "item_id": "item_id", "text": "text"}


def case_table(done: DataFrame, k: int) -> DataFrame:
    stage = lambda s: [F.col(f"{s}.answer.text").alias(f"{s}_answer"), *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("abstained", "answer_ok", "citation_ok", "faithfulness"))]
    return done.select("case_id", "type", "question", F.slice("ranked", 1, k).alias("retrieved"), "gold_ids", "retrieval_hit", *stage("e2e"), *stage("oracle"), "diagnosis")


def summary(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """(metric, type, value): pass rates and causes of cases, recall and reciprocal rank of those
    with gold; overall, and by type."""
    by = lambda df, *cols: df.rollup("type").agg(*cols)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    passed = by(cases, F.count("*").cast("double").alias("n"), F.avg((F.col("diagnosis") == "PASS").cast("double")).alias("pass_rate"), rate("oracle_answer_ok").alias("oracle_answer_ok"), *(F.count_if(F.col("diagnosis") == d).cast("double").alias(f"n_{d.lower()}") for d in A.TAXONOMY))
    found = by(M.retrieval_rows(ranked), *(F.avg(f"recall_{k}").alias(f"recall_{k}") for k in M.CUTOFFS), F.avg("rr").alias("mrr"))
    long = lambda df: df.unpivot("type", [c for c in df.columns if c != "type"], "metric", "value").select("metric", "type", "value")
    return long(passed).union(long(found))


def run(spark: SparkSession, documents: str, items: str, labels: str, out: str, config: dict | None = None) -> dict:
    """Evaluates and writes; returns what was read and written for each retriever."""
    c = configured(DEFAULTS, config)
    if not c["retrievers"] or set(c["retrievers"]) - set(RETRIEVERS) or c["judge"] not in JUDGES or c["k"] < 1:
        raise ValueError(f"retrievers are of {', '.join(RETRIEVERS)}, judges of {', '.join(JUDGES)}; k is positive")
    top = out.rstrip("/")
    corpus = spread(spark.read.parquet(documents).select("doc_id", "text"))
    text, item = F.col(c["text"]), F.col(c["item_id"])
    asked = spark.read.parquet(items).select(item.alias("case_id"), item.alias("ord"), text.alias("question"), text.alias("item"))
    LOG.info("reading %s, %s, %s", documents, items, labels)
    gold = stored(containing(asked.select("case_id", "item"), corpus), "gold")  # the same for all retrievers
    read, done = spark.read.parquet(documents).count(), {}
    for name in dict.fromkeys(c["retrievers"]):
        ranked = stored(made_cases(asked, corpus, spark.read.parquet(labels), name, gold), "cases")  # read by all that follows
        answers = A.extracted(A.staged(ranked, c["k"]), corpus)
        _, graded = score(answers, JUDGES[c["judge"]], c["k"])
        rows, seen = observed(case_table(graded, c["k"]), f"cases of {name}")
        rows.write.mode("overwrite").partitionBy("diagnosis").parquet(f"{top}/cases/retriever={name}")
        cases = spark.read.schema(rows.schema).parquet(f"{top}/cases/retriever={name}")
        metrics, lines = observed(summary(cases, ranked), f"summary of {name}")
        metrics.write.mode("overwrite").parquet(f"{top}/summary/retriever={name}")
        done[name] = {"documents": read, "items": ranked.count(), "cases": seen.get["rows"], "metrics": lines.get["rows"]}
        record = spark.range(1).select(F.lit(json.dumps(c | {"retrievers": [name]}, sort_keys=True)).alias("settings"), *(F.lit(v).cast("long").alias(n) for n, v in done[name].items()))
        record.write.mode("overwrite").json(f"{top}/run/retriever={name}")
        LOG.info("%s: %d documents and %d items read, %d cases and %d metrics written to %s", name, *done[name].values(), top)
    return done


if __name__ == "__main__":
    sys.exit(main(run, ["documents", "items", "labels", "out"], __doc__))
