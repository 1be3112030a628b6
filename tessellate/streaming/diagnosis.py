"""Diagnoses of cases whose stages arrive as a stream, in any order, late or more than once.

The two stages of a case meet in Spark's own stream-stream join.  Rows are taken up to `late`
behind the newest; of rows that repeat a stage of a case one counts; a stage waits for the
other one for `within`.  A case whose retrieved stage waits in vain is given once that time is
over, as unmatched and without a diagnosis.  What is kept for a case goes as the watermark
passes it, so the state follows the cases of a time span and not the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A


def sides(rows: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """The retrieved stages with their cases' columns, and the oracle ones, of scored rows."""
    part = F.struct("answer", "context_ids", *A.SCORES)
    keep = [c for c in rows.columns if c not in ("stage", "answer", "context_ids", "context", time, *A.SCORES)]
    e2e = rows.where("stage = 'e2e'").select(*keep, part.alias("e2e"), F.col(time).alias("e2e_time"))
    oracle = rows.where("stage = 'oracle'").select(F.col("case_id").alias("oracle_case"), part.alias("oracle"), F.col(time).alias("oracle_time"))
    return e2e, oracle


def diagnosed_stream(rows: DataFrame, k: int, time: str = "ts", late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Scored rows (case_id, stage, time, ...) as cases with retrieval_hit, diagnosis and unmatched;
    a table of rows gives the same cases as a stream of them."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["case_id", "stage"]) if rows.isStreaming else rows.dropDuplicates(["case_id", "stage"])
    e2e, oracle = sides(once, time)
    span = F.expr(f"INTERVAL {within}")
    near = (F.col("oracle_time") >= F.col("e2e_time") - span) & (F.col("oracle_time") <= F.col("e2e_time") + span)
    both = e2e.join(oracle, (F.col("case_id") == F.col("oracle_case")) & near, "left_outer")
    cases = A.diagnosed(both, k).withColumn("unmatched", F.col("oracle_case").isNull())
    return cases.withColumn("diagnosis", F.when(~F.col("unmatched"), F.col("diagnosis"))).drop("oracle_case")


def write_diagnosed(cases: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Starts the query; Spark's file sink writes each case once, also after a restart."""
    out = cases.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
