"""Streams of scored rows give the cases of a table of them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessellate.operators import answer as A
from tessellate.operators import retrieve
from tessellate.streaming.diagnosis import diagnosed_stream, write_diagnosed
from tessellate.streaming.scoring import scored_stream

START = datetime(2024, 1, 1)


def scored(spark):
    """Scored rows of both stages of a dozen cases."""
    docs = spark.createDataFrame([("a", "The sky is blue over Rome."), ("b", "Grass is green in Oslo."), ("c", "Snow is white.")], "doc_id string, text string")
    asked = [(f"q{i}", i, "known", q, [g], [w], [], [], False, []) for i, (q, g, w) in enumerate([("Is the sky blue over Rome?", "a", "blue"), ("Is grass green in Oslo?", "b", "red"), ("What is white?", "a", "white"), ("Nothing at all?", "c", "none")] * 3)]
    cases = spark.createDataFrame(asked, "case_id string, ord int, type string, question string, gold_ids array<string>, answers array<string>, forbidden_phrases array<string>, forbidden_ids array<string>, must_abstain boolean, tags array<string>")
    rows = A.extractive(A.with_context(A.staged(retrieve.ranked_lists(cases, retrieve.bm25(docs, cases, 3)), 3), docs))
    return scored_stream(rows).drop("context")


def view(rows):
    return sorted((r["case_id"], r["retrieval_hit"], r["diagnosis"], r["unmatched"]) for r in rows.select("case_id", "retrieval_hit", "diagnosis", "unmatched").collect())


def stream(spark, path, schema, out, ckpt):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    write_diagnosed(diagnosed_stream(source, 3, late="10 minutes", within="1 hour"), out, ckpt, True).awaitTermination()


def test_late_and_repeated_rows_in_any_order(spark, tmp_path):
    rows = [r.asDict(True) for r in scored(spark).collect()]
    schema = scored(spark).schema.add("ts", "timestamp")
    rnd = random.Random(4)
    timed = [(r | {"ts": START + timedelta(minutes=rnd.randrange(0, 9))}) for r in rows]
    timed += rnd.sample(timed, 10)  # repeated
    rnd.shuffle(timed)
    path, out, ckpt = (f"{tmp_path}/{x}" for x in ("in", "out", "ckpt"))
    for k in range(0, len(timed), 12):
        spark.createDataFrame(timed[k : k + 12], schema).coalesce(1).write.mode("append").parquet(path)
    want = view(diagnosed_stream(spark.read.schema(schema).parquet(path), 3))
    stream(spark, path, schema, out, ckpt)
    assert view(spark.read.parquet(out)) == want and len(want) == 12 and not any(w[3] for w in want)
    stream(spark, path, schema, out, ckpt)  # nothing new
    assert view(spark.read.parquet(out)) == want


def test_a_stage_that_never_comes_times_out(spark, tmp_path):
    rows = scored(spark).withColumn("ts", F.lit(START))
    schema = rows.schema
    path, out, ckpt = (f"{tmp_path}/{x}" for x in ("in", "out", "ckpt"))
    first = rows.where("case_id IN ('q0', 'q1') AND NOT (case_id = 'q1' AND stage = 'oracle')")
    first.coalesce(1).write.mode("append").parquet(path)
    stream(spark, path, schema, out, ckpt)
    assert [v[0] for v in view(spark.read.schema(diagnosed_stream(rows, 3).schema).parquet(out))] == ["q0"]
    # hours later q1 is given up; its other stage comes too late
    for case, time in (("case_id = 'q2'", START + timedelta(hours=5)), ("case_id = 'q1' AND stage = 'oracle'", START)):
        rows.where(case).withColumn("ts", F.lit(time)).coalesce(1).write.mode("append").parquet(path)
        stream(spark, path, schema, out, ckpt)
    got = view(spark.read.parquet(out))
    assert [(v[0], v[3]) for v in got] == [("q0", False), ("q1", True), ("q2", False)] and got[1][2] is None


def test_a_catalog_of_files_as_they_arrive(spark, tmp_path):
    import hashlib
    import json

    from tessellate.plans import catalog
    from tessellate.streaming.catalog import merged, take_up

    root, out, ckpt = (tmp_path / x for x in ("root", "out", "ckpt"))
    root.mkdir()

    def put(name, content):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content if isinstance(content, str) else json.dumps(content))
        return hashlib.sha256((root / name).read_bytes()).hexdigest()

    def made(k):
        return {"config": {"retriever": "bm25", "k": k}, "cases": [{"id": "q1", "question": "?"}]}

    def audit(sha, why):
        return {"review_type": catalog.AUDIT_KIND, "original_report_sha256": sha, "cases": [{"id": "q1", "reviewed_diagnosis": why}]}

    def rows(df):
        return sorted((r["path"], r["sha256"], r["report"]["config"]["k"], r["audit"] and r["audit"]["cases"][0]["reviewed_diagnosis"]) for r in df.collect())

    def whole():
        return rows(catalog.with_audits(catalog.reports(spark, str(root)), catalog.audits(spark, str(root))))

    args = (spark, str(root), str(out), str(ckpt))
    one = put("a/report_1.json", made(1))
    put("a/report_bad.json", "{")
    put("a/other.json", {"x": 1})
    put("b/audit.json", audit(one, "PASS"))
    assert take_up(*args) == 1 and rows(merged(spark, str(out))) == whole() and len(whole()) == 1
    assert take_up(*args) == 0
    two = hashlib.sha256(json.dumps(made(2)).encode()).hexdigest()
    put("c/audit.json", audit(one, "RETRIEVAL_MISS"))  # the last path counts
    put("d/audit.json", audit(two, "PASS"))  # before its report
    assert take_up(*args) == 1 and rows(merged(spark, str(out)))[0][3] == "RETRIEVAL_MISS"
    assert put("e/report_2.json", made(2)) == two
    assert take_up(*args) == 1 and rows(merged(spark, str(out))) == whole() and len(whole()) == 2
    put("f/report_1.json", made(1))  # a copy is the same report
    assert take_up(*args) == 1 and len(rows(merged(spark, str(out)))) == 2
