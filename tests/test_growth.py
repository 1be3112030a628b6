"""What a row or a task holds must not grow with the corpus."""

import pytest
from pyspark.sql import functions as F

from tessellate.functions import text as T
from tessellate.operators import answer as A
from tessellate.operators import retrieve
from tessellate.plans.evaluate import evaluate

DOCS = [(1, "Rome is old. Rome is big and old."), (2, "Rome is big and old. Paris too."), (3, None), (4, " "), (5, "Oslo is cold."), (5, "Oslo is cold and dark.")]


@pytest.fixture(scope="module")
def staged(spark):
    rows = [("a", "e2e", "Is Rome big, old?", [2, 1, 9]), ("a", "oracle", "Is Rome big, old?", [3, 1, 2]), ("b", "e2e", "Oslo dark cold", [5, 4]), ("b", "oracle", "Oslo dark cold", []), ("c", "e2e", "x", [4])]
    return spark.createDataFrame(rows, "case_id string, stage string, question string, context_ids array<bigint>")


def test_answers_without_gathered_contexts(spark, staged):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    far = A.extractive(A.with_context(staged, docs))
    near = A.extracted(staged, docs)
    pick = lambda df: {(r.case_id, r.stage): (r.answer, r.context_ids) for r in df.collect()}
    assert pick(near) == pick(far)
    assert pick(near)["a", "e2e"][0].citations == ["2"] and pick(near)["a", "oracle"][0].citations == ["1"]  # the first of equals
    assert near.where(F.exists("context", lambda d: ~F.array_contains("answer.citations", d["id"].cast("string")))).isEmpty()


def test_evaluation_gathers_no_context(spark):
    n = 40
    docs = spark.createDataFrame([(i, f"Rome number {i} is old.") for i in range(n)], "doc_id bigint, text string")
    none = F.array().cast("array<string>")
    cases = spark.range(1).select(F.lit("a").alias("case_id"), F.lit(1).alias("ord"), F.lit("known").alias("type"), F.lit("Is Rome old?").alias("question"), F.array(*(F.lit(i).cast("bigint") for i in range(n))).alias("gold_ids"), F.array(F.lit("old")).alias("answers"), none.alias("forbidden_phrases"), F.array().cast("array<bigint>").alias("forbidden_ids"), F.lit(False).alias("must_abstain"), none.alias("tags"))
    rows = {r.stage: r for r in evaluate(docs, cases).rows.collect()}
    assert len(rows["oracle"].context_ids) == n and len(rows["oracle"].context) == 1 and rows["oracle"].citation_ok


def test_scores_are_summed_in_bounded_tasks(spark):
    assert retrieve.parts(spark, 10, 10) == spark.sparkContext.defaultParallelism
    assert retrieve.parts(spark, 3_000_000, 200) * retrieve.CELLS >= 600_000_000


def test_numbering_lines_moves_no_record(spark, tmp_path):
    from tessellate.sources import jsonl

    for name, first in (("a", 0), ("b", 300)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{i} \n\n" if i % 7 == 0 else f"{i}\n" for i in range(first, first + 300)))
    want, n = [], 0
    for name in ("a", "b"):
        for value in (tmp_path / f"{name}.jsonl").read_text().split("\n")[:-1]:
            for part in value.split(" "):
                n += 1
                want += [(n, part)] if part else []
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.maxRecordsPerFile")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
        spark.conf.set("spark.sql.files.maxRecordsPerFile", 37)  # a split in several files
        df = jsonl.lines(spark, str(tmp_path / "*.jsonl"))
        assert sorted(tuple(r) for r in df.select("line", "record").collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert moved and not any("record" in line or " at#" in line for line in moved)  # counts alone
    assert plan.count("record") and "Window" in plan and "parts#" not in plan


def test_evidence_is_read_once_for_all_claims_of_a_row(spark):
    from tessellate.operators.judge import JUDGES
    from tessellate.plans import experiments
    from tessellate.session import dealt

    texts = ["Acme Co was founded in 1999. The company has 3 sites. No refunds.", "Plans cost $40 per month. Up to 5 GB."]
    claims = ["Acme Co has 3 sites.", "Plans cost $40.", "No refunds.", "At least 5 GB", ""]
    rows = [(f"{i}{j}", c, e, True) for j, e in enumerate([texts, texts[:1], []]) for i, c in enumerate(claims)]
    schema = "id string, claim string, evidence array<string>, expected boolean"
    apart = spark.createDataFrame(rows, schema)
    together = apart.groupBy("expected").agg(F.collect_list(F.struct("id", "claim", "evidence", "expected")).alias("probes"))
    judges = list(JUDGES.values())
    got = [sorted(map(tuple, experiments.judged_probes(x, judges).collect())) for x in (apart, together)]
    assert got[0] == got[1] and {r[3] for r in got[0]} == {True, False}
    assert dealt(spark.range(10), 10, 2).rdd.getNumPartitions() == 5


def _ranked(df):
    return sorted((str(r["case_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def test_scores_of_a_task_are_those_of_joins(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["stored", "encryption", "information"]
    some = lambda n: " ".join(rnd.choices(words, k=rnd.randrange(n)))
    rows = [(f"d{i:03}", some(12) if i % 9 else "w1 w2 w3") for i in range(300)] + [("d900", None), ("d901", "w4 w5"), ("d901", "w4 w5"), ("d901", "w5 w6 w7"), (None, "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    asked = spark.createDataFrame([(i, some(8)) for i in range(12)] + [(20, "w1 w2 w3"), (21, "absent"), (None, "w9 w4")], "case_id int, question string")
    for tokens in (T.content_tokens, T.expanded_tokens):
        for k in (1, 4, 400):
            monkeypatch.setattr(retrieve, "HITS", 50)  # in several turns
            near = _ranked(retrieve.bm25(docs, asked, k, tokens))
            with monkeypatch.context() as m:
                m.setattr(retrieve, "FEW", 0)
                m.setattr(retrieve, "LISTED", 0)
                assert near == _ranked(retrieve.bm25(docs, asked, k, tokens)) and near


def test_documents_are_cut_and_counted_once_where_they_are_read(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    terms = spark.createDataFrame([("old",), ("oslo",)], "term string")
    for asked in (None, terms):
        df = retrieve._counted(docs, T.expanded_tokens, asked)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    assert sorted((r.doc_id, r.term, r.tf) for r in df.collect() if r.term) == [(1, "old", 2), (2, "old", 1), (5, "oslo", 1), (5, "oslo", 1)]


def test_keys_of_documents_are_listed_once(spark):
    from tessellate.queries import containing

    passages = spark.createDataFrame([(1, "is big and old. Paris"), (2, "Os"), (3, "")], "case_id int, item string")
    docs = spark.createDataFrame(DOCS[:5], "doc_id bigint, text string")
    plans, stored = [], __import__("tessellate.queries", fromlist=["x"]).stored
    with pytest.MonkeyPatch.context() as m:
        m.setattr("tessellate.queries.stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
        assert sorted(map(tuple, containing(passages, docs).distinct().collect())) == [(1, 2), (2, 5)]
    assert len(plans) == 1 and plans[0].count("concat(") == 1


def test_ranked_cases_are_not_ranked_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Rome is old."), (2, "Oslo is cold.")], "doc_id bigint, text string")
    none = F.array().cast("array<string>")
    cases = spark.range(1).select(F.lit("a").alias("case_id"), F.lit(1).alias("ord"), F.lit("known").alias("type"), F.lit("Is Rome old?").alias("question"), F.array(F.lit(1).cast("bigint")).alias("gold_ids"), F.array(F.lit("old")).alias("answers"), none.alias("forbidden_phrases"), F.array().cast("array<bigint>").alias("forbidden_ids"), F.lit(False).alias("must_abstain"), none.alias("tags"))
    once = evaluate(docs, cases)
    monkeypatch.setattr("tessellate.plans.evaluate.RETRIEVERS", {})
    again = evaluate(docs, once.ranked, ranked=True)
    pick = lambda e: sorted((r.stage, r.answer.text, r.context_ids, r.citation_ok) for r in e.rows.collect())
    assert pick(once) == pick(again) and len(pick(once)) == 2
