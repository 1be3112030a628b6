"""Answers scored as they arrive.

Scoring is row-local, so a stream of rows (case_id, stage, the case's lists, answer, context)
is scored with the batch operators unchanged; diagnoses need both stages of a case and are
made in each micro-batch's sink from a table of scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators.judge import JUDGES, Judge


def scored_stream(rows: DataFrame, judge: Judge = JUDGES["conservative"]) -> DataFrame:
    """Stateless: works on a stream as on a table."""
    return A.scored(A.attributed(rows, judge), judge.version)


def windowed_outcomes(rows: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Answer-OK rates by window and stage of a scored stream with event times; late rows are
    taken up to `late` behind the newest."""
    ok = F.avg(F.col("answer_ok").cast("double"))
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "stage").agg(F.count("*").alias("n"), ok.alias("answer_ok")).select("w.start", "w.end", "stage", "n", "answer_ok")


def write_scored(rows: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """Starts the query: each micro-batch replaces its own partition, so a batch that is run
    again after a failure is not written twice."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(batch, number)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
