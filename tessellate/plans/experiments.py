"""Replay of saved answers, matched comparisons, threshold sweeps, judge validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer as A
from ..operators import metrics as M
from ..operators.judge import JUDGES, Judge
from ..operators.retrieve import RETRIEVERS, ranked_lists
from .evaluate import score

# Settings that two runs must share to be compared.
COMPARED = {"generator": "generator", "model": "model", "k": "K", "support_judge": "judge", "scoring_version": "scoring version", "judge_model": "judge model", "min_coverage": "abstention threshold", "support_threshold": "support threshold", "max_tokens": "token budget", "reasoning_effort": "reasoning setting"}
METRICS = ("recall_at_3", "mrr", "oracle_answer_ok", "citation_ok", "pass_rate")


def saved_rows(report_cases: DataFrame) -> DataFrame:
    """Cases of a saved report (see report.case_rows) as rows for each stage."""
    answer = lambda s: F.struct(F.col(f"{s}_answer").alias("text"), F.col(f"{s}_citations").alias("citations"), F.col(f"{s}.abstained").alias("abstained"))
    stages = F.array(F.struct(F.lit("e2e").alias("stage"), F.col("retrieved").alias("context_ids"), answer("e2e").alias("answer")), F.struct(F.lit("oracle").alias("stage"), F.col("oracle_context").alias("context_ids"), answer("oracle").alias("answer")))
    return report_cases.select(F.col("id").alias("case_id"), F.col("question").alias("saved_question"), F.col("gold_ids").alias("saved_gold"), F.col("type").alias("saved_type"), F.col("must_abstain").alias("saved_abstain"), F.col("retrieved").alias("ranked"), F.explode(stages).alias("s")).select("*", "s.*").drop("s")


def replay_faults(saved: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, fault): where a saved case is no longer what was evaluated."""
    same = saved.where("stage = 'e2e'").join(cases, "case_id", "left")
    labels = F.col("gold_ids").eqNullSafe(F.col("saved_gold")) & F.col("type").eqNullSafe(F.col("saved_type")) & F.col("must_abstain").eqNullSafe(F.col("saved_abstain"))
    fault = F.when(F.col("question").isNull(), "unknown case").when(F.col("question") != F.col("saved_question"), "question changed").when(~labels, "labels or type changed")
    return same.select("case_id", fault.alias("fault")).where("fault IS NOT NULL")


def rescored(report_cases: DataFrame, cases: DataFrame, docs: DataFrame, judge: Judge, k: int) -> tuple[DataFrame, DataFrame]:
    """Scored rows and diagnosed cases of saved answers; retrieval stays as it was."""
    saved = saved_rows(report_cases)
    fault = replay_faults(saved, cases).orderBy("case_id").first()
    if fault:
        raise ValueError(f"{fault['fault']} for {fault['case_id']}; the replay is not comparable")
    rows = saved.drop("saved_question", "saved_gold", "saved_type", "saved_abstain").join(cases, "case_id")
    return score(A.with_cited(rows, docs), judge, k)


def rescored_config(config: dict, judge: Judge) -> dict:
    out = {k: v for k, v in config.items() if k not in ("support_threshold", "judge_model")}
    return out | {"scoring_version": judge.version, "support_judge": judge.name, "support_threshold": judge.threshold, "evaluation_mode": "rescore_saved_answers"}


def swept(docs: DataFrame, cases: DataFrame, thresholds: tuple[float, ...] = (0.4, 0.5, 0.6, 0.7, 0.8), k: int = 3, retriever: str = "bm25", judge: Judge = JUDGES["conservative"], ranked: bool = False) -> DataFrame:
    """(threshold, n, passes, pass_rate, abstention_accuracy, over_abstention, unsupported,
    adversarial).  Retrieval, contexts and coverage are made once for all thresholds.  ranked:
    whether cases have their rankings already."""
    found = cases if ranked else ranked_lists(cases, RETRIEVERS[retriever](docs, cases, max(*M.CUTOFFS, k)))
    rows = A.best_sentences(A.staged(found, k), docs)
    rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    rows = A.with_cited(A.answered_by(rows, F.col("threshold")), docs)
    rows = rows.withColumn("case_", F.col("case_id")).withColumn("case_id", F.struct("threshold", "case_"))
    rows, done = score(rows, judge, k)
    count = lambda d: F.count_if(F.col("diagnosis") == d)
    abstention = F.avg(F.when(F.col("must_abstain"), F.col("oracle.abstained").cast("double")))
    out = done.groupBy("threshold").agg(F.count("*").alias("n"), count("PASS").alias("passes"), abstention.alias("abstention_accuracy"), count("OVER_ABSTENTION").alias("over_abstention"), count("UNSUPPORTED_GENERATION").alias("unsupported"), count("ADVERSARIAL_COMPLIANCE").alias("adversarial"))
    return out.withColumn("pass_rate", F.col("passes") / F.col("n"))


def judged_probes(probes: DataFrame, judges: list[Judge]) -> DataFrame:
    """(judge, id, expected, predicted) of support probes; either a row each, or rows with an array
    `probes` of those that are judged together, best where they share evidence."""
    packed = probes if "probes" in probes.columns else probes.select(F.array(F.struct("id", "claim", "evidence", "expected")).alias("probes"))
    out = None
    for j in judges:
        said = j(F.transform("probes", lambda p: F.struct(p["claim"].alias("claim"), p["evidence"].alias("evidence"))))
        one = packed.select(F.explode(F.zip_with("probes", said, lambda p, ok: F.struct(p["id"].alias("id"), p["expected"].alias("expected"), ok.alias("predicted")))).alias("x"))
        one = one.select(F.lit(j.name).alias("judge"), "x.id", "x.expected", "x.predicted")
        out = one if out is None else out.unionByName(one)
    return out


def judged_refusals(probes: DataFrame, judges: list[Judge]) -> DataFrame:
    """(judge, id, expected, predicted): safe is a text of refusals only."""
    out = None
    for j in judges:
        one = probes.select(F.lit(j.name).alias("judge"), "id", F.col("expected_safe").alias("expected"), (T.strip(T.substantive(F.col("text"), j.version)) == "").alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return out


def validated_judges(probes: DataFrame, refusals: DataFrame, judges: list[Judge]) -> DataFrame:
    """Confusion counts and rates of each judge, and its refusal accuracy."""
    support = M.confusion(judged_probes(probes, judges), "judge")
    refusal = M.confusion(judged_refusals(refusals, judges), "judge").select("judge", F.col("accuracy").alias("refusal_accuracy"))
    return support.join(refusal, "judge")


def matched(configs: list[dict]) -> None:
    """Raises unless the runs share settings and inputs."""
    keys = ("generator", "model", "k", "support_judge", "scoring_version", "min_coverage", "inputs")
    for key in keys:
        if any(c.get(key) != configs[0].get(key) for c in configs):
            raise ValueError(f"runs differ in {key}")


def manifest(reports: list[tuple[str, str, dict]], dataset: str) -> dict:
    """Of (path, sha256, report) of matched runs."""
    matched([r["config"] for _, _, r in reports])
    c = reports[0][2]["config"]
    entries = [
        {"path": path, "sha256": sha, "recall_at_3": r["retrieval"]["recall@3"]["mean"], "mrr": r["retrieval"]["mrr"]["mean"], "pass_rate": r["end_to_end"]["pass_rate"], "passes": r["end_to_end"]["diagnosis_counts"]["PASS"], "n": r["end_to_end"]["n"]}
        for path, sha, r in reports
    ]
    return {"evaluation_mode": "controlled_comparison", "generator": c["generator"], "model": c.get("model"), "dataset": dataset, "k": c["k"], "judge": c["support_judge"], "scoring_version": c["scoring_version"], "inputs": c.get("inputs"), "reports": entries}


def _issues(a: str, b: str) -> Column:
    """What keeps runs a and b (aliases) from being compared."""
    at = lambda side, key: F.try_element_at(f"{side}.config", F.lit(key))
    differs = [F.when(~at(a, k).eqNullSafe(at(b, k)), F.lit(name)) for k, name in COMPARED.items()]
    prints = [F.when(at(a, k).isNull() | at(b, k).isNull() | (at(a, k) != at(b, k)), F.lit(name)) for k, name in (("cases_sha256", "case set"), ("corpus_sha256", "corpus"))]
    order = F.when(~F.col(f"{a}.case_ids").eqNullSafe(F.col(f"{b}.case_ids")), F.lit("evaluated cases/order"))
    replay = F.when(F.col(f"{a}.replay") | F.col(f"{b}.replay"), F.lit("saved-answer replay"))
    return F.array_compact(F.array(*differs, *prints, order, replay))


def grouped_runs(runs: DataFrame) -> DataFrame:
    """runs with group_id, a hash of all that comparability looks at: runs of a group can't be told
    apart by it."""
    keys = [*COMPARED, "cases_sha256", "corpus_sha256"]
    parts = F.struct(*(F.try_element_at("config", F.lit(k)).alias(f"k{i}") for i, k in enumerate(keys)), "case_ids", F.coalesce("replay", F.lit(False)).alias("replay"))
    return runs.withColumn("group_id", F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256))


def comparability_groups(runs: DataFrame) -> DataFrame:
    """(left_id, right_id, n_left, n_right, issues) of all pairs of groups of like runs, each named
    by its smallest run_id, and of each group of several runs with itself: at most the square of
    the number of groups, however many runs there are.  grouped_runs() has the members."""
    one = grouped_runs(runs).groupBy("group_id").agg(F.min_by(F.struct("run_id", "config", "case_ids", "replay"), "run_id").alias("r"), F.count("*").alias("n"))
    one = one.select("group_id", "r.*", "n")
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.run_id") < F.col("b.run_id")) | ((F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.n") > 1)))
    return pairs.select(F.col("a.run_id").alias("left_id"), F.col("b.run_id").alias("right_id"), F.col("a.n").alias("n_left"), F.col("b.n").alias("n_right"), _issues("a", "b").alias("issues"))


def comparability(runs: DataFrame) -> DataFrame:
    """(left_id, right_id, issues) of all pairs of runs (run_id, config map<string,string>,
    case_ids array, replay boolean): what keeps two runs from being compared.  As many rows as
    pairs; comparability_groups() says the same in few."""
    a, b = runs.alias("a"), runs.alias("b")
    return a.join(b, F.col("a.run_id") < F.col("b.run_id")).select(F.col("a.run_id").alias("left_id"), F.col("b.run_id").alias("right_id"), _issues("a", "b").alias("issues"))


def deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metric, selected, compared, delta): points of percent, MRR as it is; NULL if either is.
    left, right: one row with METRICS."""
    pairs = left.select(*(F.col(m).alias(f"l_{m}") for m in METRICS)).crossJoin(F.broadcast(right.select(*(F.col(m).alias(f"r_{m}") for m in METRICS))))  # one row each
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").alias("selected"), F.col(f"r_{m}").alias("compared"), ((F.col(f"l_{m}") - F.col(f"r_{m}")) * (1 if m == "mrr" else 100)).alias("delta")) for m in METRICS))
    return pairs.select(F.inline(rows))


def trace(cases: DataFrame, stage: str = "e2e") -> DataFrame:
    """(case_id, pos, doc_id, gold, cited): the context in order, flagged."""
    ids, cites = F.col(f"{stage}.context_ids"), F.col(f"{stage}.answer.citations")
    rows = cases.select("case_id", "gold_ids", cites.alias("cites"), F.posexplode(ids).alias("pos", "doc_id"))
    flag = lambda xs: F.array_contains(F.col(xs).cast("array<string>"), F.col("doc_id").cast("string"))
    return rows.select("case_id", "pos", "doc_id", flag("gold_ids").alias("gold"), flag("cites").alias("cited"))


def sources(cites: Column, ids: Column) -> Column:
    """Cited sources first, then the rest of the context."""
    return F.array_distinct(F.concat(cites, ids))
