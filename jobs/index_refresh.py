"""Keeps a stored retrieval index in step with a folder of documents that grows.

    python -m jobs.index_refresh --documents PATH --index PATH --checkpoint PATH [--config FILE]

Each run takes the document files that no run before it took (a file stream that ends when it
has seen all; its checkpoint remembers them), adds them to the index as segments, and stops.  A
row with an id that the index has replaces that document; a row whose text is null withdraws
it.  Where one batch of files has an id more than once, its row of the greatest `order_by` stays,
or of the greatest text.  A run that is broken off is taken up by the next one: a segment is
numbered by its batch and written whole, so none is added twice.  The index is partitioned by
segment and by hash of the term (tessellate/operators/index.py says how); search it between runs.

Settings (jobs/index_refresh.json): files_per_batch; id, text and order_by, the columns' names;
tokens: content or expanded; buckets: partitions of a segment, the same for all of an index.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import LOG, configured, main
from tessellate.functions import text as T
from tessellate.operators import index

DEFAULTS = {"files_per_batch": 1000, "id": "doc_id", "text": "text", "order_by": "", "tokens": "content", "buckets": index.BUCKETS}
TOKENS = {"content": T.content_tokens, "expanded": T.expanded_tokens}


def followed(path: str) -> str:
    """The path as a pattern of itself: a file stream takes a single file by a pattern only."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def latest(rows: DataFrame) -> DataFrame:
    """One row of each id; rows of ids that come once are not moved, nor are those without id."""
    again = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return rows.drop("turn")
    order = Window.partitionBy("doc_id").orderBy(F.col("turn").desc_nulls_last(), F.col("text").desc_nulls_last())
    some = rows.join(again, "doc_id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return rows.join(again, "doc_id", "left_anti").unionByName(some).drop("turn")


def run(spark: SparkSession, documents: str, index_path: str, checkpoint: str, config: dict | None = None) -> dict:
    """Brings the index up to date; returns what was read and written."""
    c = configured(DEFAULTS, config)
    if c["tokens"] not in TOKENS:
        raise ValueError(f"tokens must be one of {', '.join(TOKENS)}")
    if c["files_per_batch"] < 1 or c["buckets"] < 1:
        raise ValueError("files_per_batch and buckets must be positive")
    schema = spark.read.parquet(documents).schema
    for name in (c["id"], c["text"], *([c["order_by"]] if c["order_by"] else [])):
        if name not in schema.names:
            raise ValueError(f"documents have no column {name!r}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(followed(documents))
    turn = F.col(c["order_by"]) if c["order_by"] else F.lit(None).cast("long")
    rows = source.select(F.col(c["id"]).alias("doc_id"), F.col(c["text"]).cast("string").alias("text"), turn.alias("turn"))
    done: list[dict] = []

    def segment(batch: DataFrame, number: int) -> None:
        rows_read = batch.count()
        one = latest(batch)
        index.write_segment(index_path, number, one.where("text IS NOT NULL"), one.where("text IS NULL").select("doc_id"), TOKENS[c["tokens"]], c["buckets"])
        at = lambda name: spark.read.parquet(f"{index_path.rstrip('/')}/{name}/segment={number}").count()  # noqa: E731 -- counts from the files' footers
        done.append({"segment": number, "rows": rows_read, "documents": at("documents"), "postings": at("postings"), "hidden": at("dead")})
        LOG.info("segment %(segment)d: %(rows)d rows read, %(documents)d documents and %(postings)d postings written, %(hidden)d earlier documents hidden", done[-1])

    LOG.info("reading new files of %s, checkpoint %s", documents, checkpoint)
    query = rows.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(d["rows"] for d in done)
    LOG.info("%d rows read, %d segments written to %s", read, len(done), index_path)
    return {"rows_read": read, "segments": done}


if __name__ == "__main__":
    sys.exit(main(run, ["documents", "index", "checkpoint"], __doc__))
