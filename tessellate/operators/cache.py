"""Content-addressed caches of answers and verdicts as tables: key, values, run.

The key is the SHA-256 of everything a value depends on and nothing else: schema and
generator version, settings, case, question, stage and the ordered context.  Resuming is an
anti-join; only the misses reach the service, once for each distinct key.  Values are stored
as they come, `every` keys at a time, so a failure loses no more than those.  Nothing is ever
overwritten: a run that doesn't resume asks anew and its records, being newer, count.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, text string, citations array<string>, abstained boolean, run long"
VERDICTS = "key string, supported boolean, run long"
EVERY = 100  # keys that are asked for and stored at once


def keyed(rows: DataFrame, version: str, settings: dict) -> DataFrame:
    """rows (case_id, stage, question, context) with key.  settings must hold no secrets."""
    fixed = json.dumps({"schema": 1, "version": version, "settings": settings}, sort_keys=True)
    identity = F.to_json(F.struct(F.lit(fixed).alias("fixed"), F.col("case_id").cast("string").alias("case_id"), "question", "stage", "context"))
    return rows.withColumn("key", F.sha2(identity, 256))


def misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def checked(cache: DataFrame) -> DataFrame:
    """The cache, or an error if a record lacks a part."""
    parts = [c for c in cache.columns if c not in ("key", "run")]
    bad = F.col("key").isNull() | (F.length("key") != 64)
    for c in parts:
        bad |= F.col(c).isNull() | (F.exists(c, F.isnull) if cache.schema[c].dataType.typeName() == "array" else F.lit(False))
    if not cache.where(bad).isEmpty():
        raise RuntimeError("the cache holds an invalid record; remove it or ask afresh elsewhere")
    return cache


def newest(cache: DataFrame) -> DataFrame:
    """Of each key the record of its latest run."""
    values = [c for c in cache.columns if c not in ("key", "run")]
    latest = cache.groupBy("key").agg(F.max_by(F.struct(*values), F.coalesce("run", F.lit(0))).alias("r"))
    return latest.select("key", *(F.col("r")[c].alias(c) for c in values))


def _read(spark, path: str, schema: str) -> DataFrame:
    """The cache, an empty one if nothing is at path yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def remembered(rows: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str, schema: str, resume: bool = True, every: int = EVERY, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(key, values) of the keys of rows.  ask: gets rows that lack a value, one for each key,
    and returns them with the values of schema.  progress(done, all) is told of each part."""
    spark = rows.sparkSession
    known = checked(_read(spark, path, schema))
    left = misses(rows, known if resume else known.where("false")).persist()
    try:
        n = left.count()
        parts, run, done = -(-n // every), time.time_ns(), 0
        values = [c.split()[0] for c in schema.split(", ")[:-1]]
        for k in range(parts):
            # dealt by the key, which is a hash of all it depends on
            part = left.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
            got = ask(part).select(*values, F.lit(run).alias("run"))
            got.write.mode("append").parquet(path)
            done += part.count()
            if progress:
                progress(done, n)
    finally:
        left.unpersist()
    return newest(checked(_read(spark, path, schema)))


def answered(rows: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, version: str, settings: dict, resume: bool = True, every: int = EVERY, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """rows with `answer`, made for the misses only, written to the cache at path before any
    use, so no retry or re-plan calls the service again for a written key."""
    rows = keyed(rows, version, settings)
    ask = lambda r: generate(r).select("key", "answer.text", "answer.citations", "answer.abstained")
    known = remembered(rows, ask, path, SCHEMA, resume, every, progress)
    return rows.join(known, "key").withColumn("answer", F.struct("text", "citations", "abstained")).drop("key", "text", "citations", "abstained")


def judged(pairs: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str, settings: dict, resume: bool = True, every: int = EVERY, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """pairs (claim, evidence) with supported, asked for the misses only."""
    fixed = json.dumps({"schema": 1, "settings": settings}, sort_keys=True)
    rows = pairs.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(fixed).alias("fixed"), "claim", "evidence")), 256))
    return rows.join(remembered(rows, ask, path, VERDICTS, resume, every, progress), "key").drop("key")
