"""A catalog of saved reports: scans, audits, evidence, and the explorer's views."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..session import shipped
from ..sources.jsonl import files

IMPORT_LIMIT = 20 * 1024 * 1024
AUDIT_KIND = "assistant_manual_source_audit"  # fixed value
AUDIT = "review_type string, original_report_sha256 string, cases array<struct<id:string,reviewed_diagnosis:string,rationale:string>>"
_SCORES = "struct<abstained:boolean,correct:boolean,forbidden_phrase:boolean,answer_ok:boolean,faithfulness:double,citations_valid:boolean,cites_gold:boolean,citation_precision:double,cites_forbidden:boolean,citation_ok:boolean>"
_MEAN = "struct<mean:double,ci95:array<double>>"
REPORT = (
    "config struct<retriever:string,generator:string,model:string,k:int,support_judge:string,scoring_version:string,evaluation_mode:string,judge_model:string,min_coverage:double,support_threshold:double,max_tokens:int,reasoning_effort:string,inputs:struct<cases:struct<path:string,sha256:string>,corpus:struct<path:string,sha256:string>>>, "
    f"retrieval struct<n:int,`recall@1`:{_MEAN},`recall@3`:{_MEAN},`recall@5`:{_MEAN},mrr:{_MEAN}>, generation_oracle struct<answer_ok:double,abstention_accuracy:double>, "
    "attribution_e2e struct<n_answered:int,citation_ok_rate:double>, attribution_oracle struct<n_answered:int,citation_ok_rate:double>, end_to_end struct<n:int,pass_rate:double,pass_ci95:array<double>>, "
    f"cases array<struct<id:string,type:string,tags:array<string>,question:string,gold_ids:array<string>,must_abstain:boolean,retrieved:array<string>,retrieval_hit:boolean,e2e_answer:string,e2e:{_SCORES},e2e_citations:array<string>,oracle_context:array<string>,oracle_citations:array<string>,oracle_answer:string,oracle:{_SCORES},diagnosis:string>>"
)


def _inside(found: DataFrame, root: str) -> DataFrame:
    """Files whose resolved place is below root: a link that leads out is left out."""
    shipped(found.sparkSession)
    return found.where(F.udf(lambda p: _below(p, root), "boolean")("path"))  # a row is a file


def reports(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, length, report) of report*.json below root, hidden folders and files
    that hold no report left out, in order of path."""
    return decoded_reports(_inside(files(spark, root, "report*.json"), root)).orderBy("path")


def decoded_reports(found: DataFrame) -> DataFrame:
    """The reports among files (path, sha256, length, content)."""
    read = found.select("path", "sha256", "length", F.from_json(F.col("content").cast("string"), REPORT).alias("report"))
    return read.where("NOT path RLIKE '/\\\\.' AND report.cases IS NOT NULL AND report.config IS NOT NULL")


def warnings(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files named like reports that are no JSON."""
    found = _inside(files(spark, root, "report*.json"), root).where("NOT path RLIKE '/\\\\.'")
    return found.where(F.json_object_keys(F.col("content").cast("string")).isNull()).select("path")


def importable(found: DataFrame) -> DataFrame:
    """Reports that an explorer takes in: not too large, with all their parts."""
    parts = " AND ".join(f"report.{p} IS NOT NULL" for p in ("config", "cases", "retrieval", "generation_oracle", "attribution_e2e", "attribution_oracle", "end_to_end"))
    return found.where(f"length <= {IMPORT_LIMIT} AND size(report.cases) > 0 AND {parts}").where("forall(report.cases, c -> c.id IS NOT NULL AND c.question IS NOT NULL AND c.e2e_answer IS NOT NULL AND c.oracle_answer IS NOT NULL AND c.retrieved IS NOT NULL AND c.gold_ids IS NOT NULL)")


def audits(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, audit): by report; the last path wins."""
    return last_audits(decoded_audits(_inside(files(spark, root, "audit.json"), root)))


def decoded_audits(found: DataFrame) -> DataFrame:
    """(path, audit) of the audits among files (path, content)."""
    read = found.select("path", F.from_json(F.col("content").cast("string"), AUDIT).alias("audit"))
    return read.where((F.col("audit.review_type") == AUDIT_KIND) & F.col("audit.original_report_sha256").isNotNull())


def last_audits(kept: DataFrame) -> DataFrame:
    return kept.groupBy(F.col("audit.original_report_sha256").alias("sha256")).agg(F.max_by("audit", "path").alias("audit"))


def with_audits(found: DataFrame, audited: DataFrame) -> DataFrame:
    return found.join(audited, "sha256", "left")


def _below(path: str, root: str) -> bool:
    """Whether a path lies in a folder once links and dots are resolved; in a store without
    links (any scheme but file) by name, without dots."""
    if "://" in path and not path.startswith("file://"):
        return ".." not in path.split("/") and path.startswith(root.rstrip("/") + "/")
    place, top = (Path(x.removeprefix("file:").replace("///", "/")).resolve() for x in (path, root))
    return place != top and place.is_relative_to(top)


def evidence(spark: SparkSession, corpus: dict | None, root: str) -> tuple[DataFrame | None, str]:
    """Documents of a report's corpus, and a status; only from below root, and only if the
    bytes are those that were evaluated."""
    path, sha = (corpus or {}).get("path"), (corpus or {}).get("sha256")
    if not path or not sha:
        return None, "Corpus fingerprint unavailable in this report."
    if not _below(path, root):
        return None, "Corpus is outside this project; evidence was not loaded."
    try:
        found = files(spark, path).select("sha256", F.col("content").cast("string").alias("text")).first()
    except Exception:
        return None, "Corpus could not be loaded."
    if found is None or found["sha256"] != sha:
        return None, "Corpus changed since this run; evidence was not loaded."
    rows = spark.read.schema("id string, title string, text string").json(path)
    return rows, "Evidence verified against the saved corpus fingerprint."


def cases(found: DataFrame, stage: str = "e2e", audited: bool = False) -> DataFrame:
    """(path, case columns, outcome) of reports; audited: reviewed labels where there are."""
    each = found.select("path", *(["audit"] if audited else []), F.explode("report.cases").alias("c"))
    review = F.get(F.filter("audit.cases", lambda r: r["id"] == F.col("c.id")), F.lit(0))["reviewed_diagnosis"] if audited else F.lit(None).cast("string")
    rows = each.select("path", "c.*", review.alias("reviewed"))
    return rows.withColumn("outcome", A.outcome(stage, F.col("reviewed")))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "outcome").agg(F.count("*").alias("n")).orderBy("path", F.desc("n"), "outcome")


def pass_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.avg((F.col("outcome") == "PASS").cast("double")).alias("pass_rate"), F.count_if(F.col("outcome") == "PASS").alias("passes"), F.count("*").alias("n"))


def runs(found: DataFrame, query: str = "") -> DataFrame:
    """(dataset, runs): titles of runs by dataset, in order of path; query filters."""
    c = F.col("report.config")
    rows = found.select("path", F.concat_ws(" / ", c["retriever"], c["generator"]).alias("title"), F.coalesce(c["model"], F.lit("")).alias("model"), T.dataset_label(c["inputs"]["cases"]["path"]).alias("dataset"))
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "model", "path", "dataset")), F.lower(F.lit(query))))
    return rows.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("path", "title"))).alias("runs"))


def metrics(found: DataFrame) -> DataFrame:
    """(path, recall_at_3, mrr, oracle_answer_ok, citation_ok, pass_rate)"""
    r = F.col("report")
    return found.select("path", r["retrieval"]["recall@3"]["mean"].alias("recall_at_3"), r["retrieval"]["mrr"]["mean"].alias("mrr"), r["generation_oracle"]["answer_ok"].alias("oracle_answer_ok"), r["attribution_e2e"]["citation_ok_rate"].alias("citation_ok"), r["end_to_end"]["pass_rate"].alias("pass_rate"))


def comparable(found: DataFrame) -> DataFrame:
    """Runs as experiments.comparability() takes them."""
    c = F.col("report.config")
    keys = ("generator", "model", "k", "support_judge", "scoring_version", "judge_model", "min_coverage", "support_threshold", "max_tokens", "reasoning_effort")
    pairs = [x for k in keys for x in (F.lit(k), c[k].cast("string"))]
    prints = [x for k in ("cases", "corpus") for x in (F.lit(f"{k}_sha256"), c["inputs"][k]["sha256"])]
    return found.select(F.col("path").alias("run_id"), F.create_map(*pairs, *prints).alias("config"), F.transform("report.cases", lambda x: x["id"]).alias("case_ids"), F.coalesce(c["evaluation_mode"] == "rescore_saved_answers", F.lit(False)).alias("replay"))


def bundle(spark: SparkSession, root: str) -> str:
    """The catalog as the JSON that an explorer loads."""
    found = with_audits(reports(spark, root), audits(spark, root))
    rows = [json.loads(x[0]) for x in found.select(F.to_json(F.struct("path", "sha256", "report", "audit"))).collect()]
    return json.dumps({"reports": rows, "warnings": [f"Could not load report: {r['path']}" for r in warnings(spark, root).collect()]})
