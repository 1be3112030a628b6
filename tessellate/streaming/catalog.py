"""A catalog that takes up reports and audits as their files arrive.

A file stream reads each file once, whenever it comes; its checkpoint remembers which.  A batch
writes the reports and audits that it holds to folders of its own number, so one that is run
again after a failure replaces itself.  Reading merges the batches: reports by fingerprint, as
copies of a file are one report, named by its smallest path; of the audits of a report the one
of the last path counts.  An audit may come before its report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans import catalog as C

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def take_up(spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Reads the files below root that no call before has read; returns the number of batches."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch)
    batches: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        named = C._inside(batch.withColumn("sha256", F.sha2("content", 256)), root).withColumn("name", F.element_at(F.split("path", "/"), -1))
        C.decoded_reports(named.where("name LIKE 'report%'")).write.mode("overwrite").parquet(f"{out}/reports/batch={number}")
        C.decoded_audits(named.where("name = 'audit.json'")).write.mode("overwrite").parquet(f"{out}/audits/batch={number}")
        batches.append(number)

    source.load(root).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(batches)


def merged(spark: SparkSession, out: str) -> DataFrame:
    """(path, sha256, length, report, audit) of all that was taken up."""
    def read(name: str, plain: str, nested: str, ddl: str) -> DataFrame:
        schema = StructType.fromDDL(plain).add(nested, StructType.fromDDL(ddl))
        return spark.read.schema(schema).parquet(f"{out}/{name}")

    reports = read("reports", "path string, sha256 string, length bigint", "report", C.REPORT)
    one = reports.groupBy("sha256").agg(F.min_by(F.struct("path", "length", "report"), "path").alias("r")).select("sha256", "r.*")
    return C.with_audits(one, C.last_audits(read("audits", "path string", "audit", C.AUDIT)))
