"""Strict JSONL sources for documents, cases and probes, and checks over the pair.

A record must have all required keys, no unknown ones, the right types, and pass its checks;
ids are unique.  The first error of a file is raised with its line.  The texts of
errors are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import stored

KINDS = ("known", "unanswerable", "adversarial")
_LISTS = ("gold_ids", "answers", "forbidden_phrases", "forbidden_ids", "tags")
DOC = S.StructType([S.StructField(c, S.StringType()) for c in ("id", "title", "text")])
CASE = S.StructType([*(S.StructField(c, S.StringType()) for c in ("id", "type", "question")), *(S.StructField(c, S.ArrayType(S.StringType())) for c in _LISTS), S.StructField("must_abstain", S.BooleanType())])
PROBE = "id string, claim string, evidence array<string>, expected boolean, category string"
REFUSAL = "id string, text string, expected_safe boolean"
_REQUIRED = {"doc": ("id", "title", "text"), "case": ("id", "type", "question")}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, record) of the lines that are not blank; every Unicode line end counts.

    A file is read in splits, cut at line feeds, and each split's records are written in order as
    rows of a table, where a row's place is known to the reader.  So a line's number is the rows
    of the splits before and the place in its own split: only counts of splits are moved, no
    record is.  Of several files the lines follow each other in order of name."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    ends = F.regexp_replace("value", r"\r\z", "")  # a carriage return before the feed ends no other line
    each = stored(raw.select("file_path", "file_block_start", F.explode(F.split(ends, T.LINE_ENDS)).alias("record")), "lines")
    each = each.select("*", F.col("_metadata.file_name").alias("piece"), F.col("_metadata.row_index").alias("at"))
    held = each.groupBy("file_path", "file_block_start", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("file_path", "file_block_start", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row is a split
    begins = held.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    places = each.join(F.broadcast(begins), ["file_path", "file_block_start", "piece"])
    return places.where(T.strip(F.col("record")) != "").select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "record")


def doc_error(r: Column) -> Column:
    out = F.lit(None).cast("string")
    for c in reversed(DOC.names):
        out = F.when(T.is_blank(r[c]), f"Doc.{c} must be a nonempty string").otherwise(out)
    return out


def case_error(r: Column) -> Column:
    out = F.lit(None).cast("string")
    for c in reversed(_LISTS):
        bad = r[c].isNotNull() & F.exists(F.coalesce(r[c], F.array().cast("array<string>")), T.is_blank)
        out = F.when(bad, f"Case.{c} must be a sequence of nonempty strings").otherwise(out)
    for c in ("question", "id"):
        out = F.when(T.is_blank(r[c]), f"Case.{c} must be a nonempty string").otherwise(out)
    return F.when(~F.coalesce(r["type"].isin(*KINDS), F.lit(False)), F.concat(F.lit("Unknown case type: "), F.coalesce(r["type"], F.lit("None")))).otherwise(out)


def decoded(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(line, r, error): each record and what is wrong with it, NULL if nothing."""
    fields = (DOC if kind == "doc" else CASE).fields
    schema = S.StructType([*fields, S.StructField("_bad", S.StringType())])
    names = [f.name for f in fields]
    read = F.from_json("record", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines(spark, path).withColumn("r", read).withColumn("keys", F.json_object_keys("record"))
    unknown = F.array_except("keys", T.strings(names))
    missing = F.array_except(T.strings(_REQUIRED[kind]), F.col("keys"))
    error = (
        F.when(F.col("keys").isNull(), "not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unexpected key: "), F.array_join(F.array_sort(unknown), ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing key: "), F.array_join(missing, ", ")))
        .when(F.col("r._bad").isNotNull(), "a field has the wrong type")
        .otherwise((doc_error if kind == "doc" else case_error)(F.col("r")))
    )
    rows = rows.withColumn("error", error)
    again = F.row_number().over(Window.partitionBy("r.id").orderBy("line")) > 1
    return rows.withColumn("error", F.coalesce("error", F.when(again, F.concat(F.lit("Duplicate id: "), F.col("r.id"))))).select("line", "r", "error")


def _checked(rows: DataFrame, path: str) -> DataFrame:
    found = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("first")).first()
    if found["first"]:
        raise ValueError(f"{path}:{found['first']['line']}: {found['first']['error']}")
    if not found["n"]:
        raise ValueError(f"{path}: dataset is empty")
    return rows


def load_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text, ord)"""
    rows = _checked(decoded(spark, path, "doc"), path)
    return rows.select(F.col("r.id").alias("doc_id"), "r.title", "r.text", F.col("line").alias("ord"))


def must_abstain(kind: Column, flag: Column) -> Column:
    """An unanswerable case is always to be abstained on."""
    return F.coalesce(flag, F.lit(False)) | (kind == "unanswerable")


def load_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(case_id, ord, type, question, lists, must_abstain); limit: the first cases, after all
    have been checked."""
    rows = _checked(decoded(spark, path, "case"), path)
    lists = [F.coalesce(f"r.{c}", F.array().cast("array<string>")).alias(c) for c in _LISTS]
    out = rows.select(F.col("r.id").alias("case_id"), F.col("line").alias("ord"), "r.type", "r.question", *lists, must_abstain(F.col("r.type"), F.col("r.must_abstain")).alias("must_abstain"))
    return out if limit is None else out.orderBy("ord").limit(limit)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_documents(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, missing): ids that cases name and docs lacks."""
    named = cases.select("case_id", F.explode(F.array_union("gold_ids", "forbidden_ids")).alias("doc_id"))
    return named.join(docs.select("doc_id"), "doc_id", "left_anti").groupBy("case_id").agg(F.array_sort(F.collect_set("doc_id")).alias("missing"))


def overlapping(cases: DataFrame) -> DataFrame:
    return cases.where(F.arrays_overlap("gold_ids", "forbidden_ids")).select("case_id")


def validate(cases: DataFrame, docs: DataFrame) -> None:
    """Raises on the first fault between cases and docs."""
    if docs.isEmpty() or cases.isEmpty():
        raise ValueError("Corpus and cases must both be nonempty")
    for name, rows, key in (("document", docs, "doc_id"), ("case", cases, "case_id")):
        if not duplicate_ids(rows, key).isEmpty():
            raise ValueError(f"Duplicate {name} ids")
    lost = missing_documents(cases, docs).join(cases.select("case_id", "ord"), "case_id").orderBy("ord").first()
    if lost:
        raise ValueError(f"Case {lost['case_id']}: unknown document ids: {', '.join(map(str, lost['missing']))}")
    both = overlapping(cases).first()
    if both:
        raise ValueError(f"Case {both['case_id']}: gold and forbidden ids overlap")


def load_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE).json(path)


def load_refusals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REFUSAL).json(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return files(spark, path).select("sha256").first()[0]


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content, length, sha256) of files, found in all folders below if a pattern of
    names is given."""
    read = spark.read.format("binaryFile")
    if pattern:
        read = read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return read.load(path).select("path", "content", "length", F.sha2("content", 256).alias("sha256"))
