"""The staged evaluation as one graph of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import metrics as M
from ..operators.judge import JUDGES, Judge
from ..operators.retrieve import RETRIEVERS, ranked_lists
from ..session import stored
from ..sources.jsonl import validate


@dataclass
class Evaluation:
    config: dict
    rows: DataFrame  # (case_id, stage): answers and scores
    cases: DataFrame  # one row for each case, with both stages and the diagnosis
    retrieval: DataFrame
    retrieval_by_type: DataFrame
    retrieval_rows: DataFrame
    ranked: DataFrame  # a table that every later step reads

    def summaries(self) -> dict[str, DataFrame]:
        return {
            "retrieval": self.retrieval,
            "retrieval_by_type": self.retrieval_by_type,
            "generation_oracle": A.generation_summary(self.rows),
            "attribution": A.attribution_summary(self.rows),
            "diagnosis_counts": A.diagnosis_counts(self.cases),
            "by_type": self.cases.groupBy("type", "diagnosis").agg(F.count("*").alias("n")),
        }


def score(rows: DataFrame, judge: Judge, k: int) -> tuple[DataFrame, DataFrame]:
    """Scored rows, and diagnosed cases, of rows with answers and contexts."""
    rows = A.scored(A.attributed(rows, judge), judge.version)
    return rows, A.diagnosed(A.by_case(rows), k)


def evaluate(
    docs: DataFrame,
    cases: DataFrame,
    retriever: str = "bm25",
    generate: Callable[[DataFrame], DataFrame] = A.extractive,
    k: int = 3,
    ks: tuple[int, ...] = M.CUTOFFS,
    judge: Judge = JUDGES["conservative"],
    checked: bool = True,
    config: dict | None = None,
    ranked: bool = False,
) -> Evaluation:
    """docs: doc_id, text; cases: case_id, ord, type, question, lists, must_abstain.  generate
    adds the answer struct to rows (case_id, stage, question, context); extractive answers need no
    contexts gathered, and their rows have what is cited only.  ranked: cases have `ranked` already, of
    this retriever and deep enough, and are a table."""
    if k < 1:
        raise ValueError("k must be positive")
    if not ks or min(ks) < 1:
        raise ValueError("cutoffs must be positive and at least one")
    if checked:
        validate(cases, docs)
    if not ranked:
        cases = stored(ranked_lists(cases, RETRIEVERS[retriever](docs, cases, max(*ks, k))), "ranked")
    found = M.retrieval_rows(cases, ks)
    rows = A.staged(cases, k)
    rows = A.extracted(rows, docs) if generate is A.extractive else generate(A.with_context(rows, docs))
    rows, diagnosed = score(rows, judge, k)
    settings = {"retriever": retriever, "generator": "extractive", "k": k, "ks": list(ks), "support_judge": judge.name, "scoring_version": judge.version, "support_threshold": judge.threshold, "judge_model": getattr(judge, "model", None), **(config or {})}
    return Evaluation(settings, rows, diagnosed, M.retrieval_summary(found, ks), M.retrieval_summary(found, ks, "type"), found, cases)
