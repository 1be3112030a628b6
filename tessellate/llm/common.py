"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_dir, shipped, spread

ROWS = 1000  # documents that a function of by_document() gets at once


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with ours."""
    shipped(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; in a
    local session, where that may be unset, one of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(local_dir(spark))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and what is
    read back survives the loss of the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 1 << 18


def sized(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, of numbers only, sent whole to all tasks that join it where it has at most `most` rows
    (counted; some 12 MB); a larger one is joined by a shuffle, with the same result."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() made."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, summed in the JVM."""
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def by_document(docs: DataFrame, fn: Callable[[list, list], dict], schema: str, rows: int = ROWS) -> DataFrame:
    """Narrow map: fn gets (doc_id, text) columns of an Arrow batch as two lists and
    returns a dict of column lists; no shuffle, one batch in memory at a time
    (spark.sql.execution.arrow.maxBytesPerBatch bounds it)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                out = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return id_text(docs).mapInArrow(run, spark_schema)


LONGEST = 128  # characters of a key that is remembered


class Remembered(dict):
    """A memo of bounded size: when it holds `most` entries they become the old ones, and of
    those only what is asked for again is kept.  Keys of over LONGEST characters are not
    remembered, so texts without spaces take no room."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def older(self, key):
        """The value of a key that get() didn't find, or None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > LONGEST:
            return
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
