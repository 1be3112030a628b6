"""The jobs: two runs over growing input, a run that is broken off, settings, command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import evaluation_report, index_refresh
from tessellate.operators import index, retrieve

ROOT = Path(__file__).resolve().parents[1]
COLUMNS = "doc_id long, text string, version long"


def write(spark, path, rows, schema=COLUMNS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def live(spark, path):
    return sorted(map(tuple, index.postings(spark, path).select("doc_id", "term", "tf", "dl").collect()))


def rebuilt(spark, rows):
    return sorted(map(tuple, retrieve.postings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "term", "tf", "dl").collect()))


@pytest.fixture
def place(tmp_path):
    return [f"{tmp_path}/{name}" for name in ("documents", "index", "checkpoint")]


def test_index_follows_growing_documents(spark, place):
    write(spark, place[0], [(1, "red apples", 1), (2, "green pears", 1), (3, "blue plums", 1)])
    first = index_refresh.run(spark, *place)
    assert first["rows_read"] == 3 and [s["documents"] for s in first["segments"]] == [3]
    # replaced, withdrawn, twice in one batch (the greatest version counts), new
    write(spark, place[0], [(1, "red cherries", 2), (2, None, 2), (4, "old words", 1), (4, "new words", 2), (4, "older words", None), (5, "figs", 1)])
    second = index_refresh.run(spark, *place, config={"order_by": "version"})
    assert second["rows_read"] == 6 and second["segments"][0]["hidden"] == 2
    assert live(spark, place[1]) == rebuilt(spark, [(1, "red cherries"), (3, "blue plums"), (4, "new words"), (5, "figs")])
    third = index_refresh.run(spark, *place)
    assert third == {"rows_read": 0, "segments": []}
    asked = spark.createDataFrame([(1, "red words")], "case_id long, question string")
    assert {r["doc_id"] for r in index.pruned_bm25(spark, place[1], asked, 5).collect()} == {1, 4}


def test_batches_of_files_make_segments(spark, place):
    rows = [(i, f"word{i % 7} word{i % 3} text") for i in range(12)]
    for i in range(0, 12, 3):
        write(spark, place[0], [(d, t, 1) for d, t in rows[i : i + 3]])
    done = index_refresh.run(spark, *place, config={"files_per_batch": 1, "buckets": 4})
    assert [s["segment"] for s in done["segments"]] == [0, 1, 2, 3]
    assert live(spark, place[1]) == rebuilt(spark, rows)


def test_a_run_that_is_broken_off_is_taken_up(spark, place, monkeypatch):
    rows = [(i, f"word{i} same text") for i in range(6)]
    for r in rows:
        write(spark, place[0], [(*r, 1)])
    plain, count = index.write_segment, []

    def failing(path, number, *more):
        plain(path, number, *more)
        count.append(number)
        if len(count) == 3:
            raise RuntimeError("the machine is lost after segment 2 is written, before it is noted")

    monkeypatch.setattr(index, "write_segment", failing)
    with pytest.raises(Exception, match="machine is lost"):
        index_refresh.run(spark, *place, config={"files_per_batch": 1})
    done = index_refresh.run(spark, *place, config={"files_per_batch": 1})
    assert count == [0, 1, 2, 2, 3, 4, 5] and [s["segment"] for s in done["segments"]] == [2, 3, 4, 5]
    assert live(spark, place[1]) == rebuilt(spark, rows)


def test_a_single_file_is_followed(spark, place, tmp_path):
    write(spark, f"{tmp_path}/made", [(1, "red apples", 1)])
    os.rename(next(Path(f"{tmp_path}/made").glob("*.parquet")), f"{tmp_path}/one.parquet")
    for n in (1, 0):
        assert index_refresh.run(spark, f"{tmp_path}/one.parquet", *place[1:])["rows_read"] == n
    assert live(spark, place[1]) == rebuilt(spark, [(1, "red apples")])


@pytest.mark.parametrize("config", [{"tokens": "letters"}, {"buckets": 0}, {"files_per_batch": "5"}, {"bucket": 3}, {"text": "body"}, {"order_by": "age"}])
def test_bad_settings(spark, place, config):
    write(spark, place[0], [(1, "a", 1)])
    with pytest.raises(ValueError):
        index_refresh.run(spark, *place, config=config)


def data(spark, top):
    write(spark, f"{top}/documents", [(1, "The sky over Rome is blue today."), (2, "Grass in Oslo is green."), (3, "Grass in Oslo is never green or blue."), (4, None)], "doc_id long, text string")
    write(spark, f"{top}/items", [(10, "sky over Rome is blue"), (11, "Grass in Oslo is"), (12, "nothing of this"), (13, None)], "item_id long, text string")
    write(spark, f"{top}/labels", [(3, 0, 1)], "doc_id long, quality long, toxic long")
    return [f"{top}/{name}" for name in ("documents", "items", "labels")]


def report(spark, out):
    rows = spark.read.parquet(f"{out}/cases").select("retriever", "case_id", "type", "retrieval_hit", "e2e_answer", "diagnosis").collect()
    metrics = spark.read.parquet(f"{out}/summary").collect()
    return sorted(map(repr, rows)), sorted(map(repr, metrics))


def test_report_is_the_same_when_run_again(spark, tmp_path):
    paths, out = data(spark, tmp_path), f"{tmp_path}/out"
    done = evaluation_report.run(spark, *paths, out)
    assert done["bm25"]["documents"] == 4 and done["bm25"]["items"] == done["bm25"]["cases"] == 4
    before = report(spark, out)
    evaluation_report.run(spark, *paths, out)
    assert report(spark, out) == before
    kinds = {(r["case_id"], r["type"], r["retrieval_hit"]) for r in spark.read.parquet(f"{out}/cases").where("retriever = 'bm25'").collect()}
    assert kinds == {(10, "adversarial", True), (11, "known", True), (12, "unanswerable", None), (13, "unanswerable", None)}
    value = spark.read.parquet(f"{out}/summary").where("retriever = 'bm25' AND type IS NULL")
    assert {r["metric"]: r["value"] for r in value.where("metric IN ('n', 'recall_5', 'mrr')").collect()} == {"n": 4.0, "recall_5": 1.0, "mrr": 1.0}
    assert json.loads(spark.read.json(f"{out}/run").where("retriever = 'bm25'").first()["settings"])["judge"] == "conservative"


def test_report_of_changed_input_leaves_no_stale_rows_and_other_retrievers(spark, tmp_path):
    paths, out = data(spark, tmp_path), f"{tmp_path}/out"
    evaluation_report.run(spark, *paths, out)
    old = spark.read.parquet(f"{out}/cases").where("retriever = 'expanded_bm25'").count()
    spark.createDataFrame([(12, "nothing of this")], "item_id long, text string").write.mode("overwrite").parquet(paths[1])
    evaluation_report.run(spark, *paths, out, config={"retrievers": ["bm25"], "judge": "lexical"})
    rows = spark.read.parquet(f"{out}/cases")
    assert [r["case_id"] for r in rows.where("retriever = 'bm25'").collect()] == [12]
    assert rows.where("retriever = 'expanded_bm25'").count() == old == 4


@pytest.mark.parametrize("config", [{"retrievers": []}, {"retrievers": ["none"]}, {"judge": "none"}, {"k": 0}])
def test_bad_report_settings(spark, tmp_path, config):
    with pytest.raises(ValueError):
        evaluation_report.run(spark, *data(spark, tmp_path), f"{tmp_path}/out", config=config)


def test_settings_files_hold_the_defaults():
    for job in (index_refresh, evaluation_report):
        assert json.loads((ROOT / f"jobs/{job.__name__.rpartition('.')[2]}.json").read_text()) == job.DEFAULTS


def test_command_line(spark, place):
    write(spark, place[0], [(1, "red apples", 1)])
    args = ["--documents", place[0], "--index", place[1], "--checkpoint", place[2], "--config", "jobs/index_refresh.json"]
    out = subprocess.run([sys.executable, "-m", "jobs.index_refresh", *args], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert json.loads(out.stdout.strip().splitlines()[-1])["rows_read"] == 1 and "1 documents and 2 postings written" in out.stderr
    assert live(spark, place[1]) == rebuilt(spark, [(1, "red apples")])


def test_jobs_stand_alone():
    for f in (ROOT / "jobs").glob("*.py"):
        assert "llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()
