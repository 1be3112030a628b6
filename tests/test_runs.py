"""Pacing over tasks and services, mergeable resampling, groups of runs, the command line's reports."""

import json
import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessellate import cli
from tessellate.operators import cache, metrics, providers
from tessellate.operators.providers import Pace, Turns
from tessellate.plans import experiments


def starts(lane, lanes, after, interval, n, rnd, first=0.0):
    """When a task's requests start by its own clock."""
    now = [after + first]
    pace = Pace(interval, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s), after, lane, lanes)
    out = []
    for _ in range(n):
        pace.turn(rnd.choice([0.0, 0.0, rnd.random() * 20]))  # some are retries that wait
        out.append(now[0])
        now[0] += rnd.random() * 12  # the request takes its time
    return out


@pytest.mark.parametrize("lanes", [1, 2, 5])
def test_no_two_starts_are_closer_than_the_interval(lanes):
    rnd = random.Random(lanes)
    for interval in (0.5, 3.0, 15.0):
        all_ = sorted(t for lane in range(lanes) for t in starts(lane, lanes, 1000.0, interval, 40, rnd, rnd.random() * 9))
        assert min(b - a for a, b in zip([1000.0, *all_], all_)) >= interval - 1e-6


def test_lanes_need_a_common_time():
    with pytest.raises(ValueError):
        Pace(1.0, lambda: 0.0, lambda s: None, lanes=2)


def test_parts_and_services_follow_each_other():
    now, interval, all_ = [50.0], 4.0, []
    turns = Turns(lambda: now[0])
    for service in ("groq", "groq", "groq"):  # two parts of the generator, then a judge of the same service
        pace = Pace(interval, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s), turns.next(service, 1))
        for _ in range(3):
            pace.turn()
            all_.append(now[0])
            now[0] += 0.1
    assert all_[0] == 50.0 and min(b - a for a, b in zip(all_, all_[1:])) >= interval - 1e-6
    assert turns.next("other", 1) == float("-inf") and turns.next("other", 1) == now[0]


def test_hosted_rows_are_paced_over_parts_and_tasks(spark, tmp_path):
    service = replace(providers.SERVICES["groq"], key_name="PATH")  # something that workers have
    rows = spark.createDataFrame([(i, "oracle", f"q{i}", [("a", "text")]) for i in range(9)], "case_id long, stage string, question string, context array<struct<id:string,text:string>>")

    def stamped(url, headers, body):  # notes when it was called, in the answer itself
        import time

        return {"choices": [{"finish_reason": "stop", "message": {"content": repr(time.time())}}]}

    make = lambda: providers.Client(service, "some/model", interval=0.3, transport=stamped)
    turns = Turns()
    got = cache.answered(rows, lambda r: providers.hosted(r, make, 2, turns), str(tmp_path / "answers"), "1", {}, every=4)
    times = sorted(float(r["answer"]["text"]) for r in got.collect())
    assert len(times) == 9 and min(b - a for a, b in zip(times, times[1:])) >= 0.25


def test_merged_resampling(spark):
    rnd = random.Random(3)
    rows = [(i, "ab"[i % 2], rnd.random() if i % 10 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    cut = F.col("k") < 217
    parts = metrics.bootstrap_sums(df.where(cut), "v", "k", n=50).union(metrics.bootstrap_sums(df.where(~cut), "v", "k", n=50))
    whole = {tuple(r) for r in metrics.bootstrap_sums(df, "v", "k", n=50).collect()}
    assert {tuple(r) for r in parts.groupBy("r").agg(F.sum("total"), F.sum("draws")).collect()} == whole
    draws = sorted(r[2] for r in whole)
    assert 450 < draws[0] <= draws[-1] < 630  # 540 on average
    got = {r["g"]: (r["lo"], r["hi"]) for r in metrics.bootstrap_merged(df, "v", "k", "g").collect()}
    exact = {r["g"]: (r["lo"], r["hi"]) for r in metrics.bootstrap_exact(df, "v", "k", "g").collect()}
    for g, (lo, hi) in exact.items():
        assert got[g] == pytest.approx((lo, hi), abs=0.012) and got[g][0] < got[g][1]
    assert metrics.bootstrap_merged(df.where("false"), "v", "k").first()["lo"] is None if metrics.bootstrap_merged(df.where("false"), "v", "k").count() else True


def test_draws_are_poisson(spark):
    counts = dict(map(tuple, spark.range(40_000).select(metrics.drawn(F.col("id") * 7919, F.lit(5)).alias("n")).groupBy("n").count().collect()))
    for n, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert counts[n] / 40_000 == pytest.approx(share, abs=0.012)


def test_groups_of_runs_say_what_pairs_say(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        config = {"model": rnd.choice("ab"), "k": rnd.choice("35"), "cases_sha256": "c", "corpus_sha256": rnd.choice([None, "d"])}
        rows.append((f"r{i:02}", {k: v for k, v in config.items() if v}, ["1", "2"] if i % 3 else ["2", "1"], rnd.choice([True, False, False])))
    runs = spark.createDataFrame(rows, "run_id string, config map<string,string>, case_ids array<string>, replay boolean").cache()
    pairs = {(r["left_id"], r["right_id"]): r["issues"] for r in experiments.comparability(runs).collect()}
    group = {r["run_id"]: r["group_id"] for r in experiments.grouped_runs(runs).collect()}
    found = experiments.comparability_groups(runs).collect()
    between = {frozenset((group[r["left_id"]], group[r["right_id"]])): r["issues"] for r in found}
    assert len(found) == len(between) < len(pairs)
    for a, b in combinations(sorted(group), 2):
        assert pairs[a, b] == between[frozenset((group[a], group[b]))]


@pytest.fixture
def files(tmp_path):
    docs = [{"id": "d1", "title": "t", "text": "The sky is blue over Rome."}, {"id": "d2", "title": "t", "text": "Grass is green in Oslo."}]
    cases = [{"id": f"c{i}", "type": "known", "question": "What colour is the sky over Rome?", "gold_ids": ["d1"], "answers": ["blue"]} for i in range(3)]
    for name, rows in (("corpus", docs), ("cases", cases)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return [f"--corpus={tmp_path}/corpus.jsonl", f"--cases={tmp_path}/cases.jsonl"]


def test_a_limited_run_says_so(spark, files, tmp_path, capsys):
    assert cli.main(["evaluate", *files, "--retriever=bm25", "--limit=2", f"--out={tmp_path}/out"]) == 0
    config = json.loads((tmp_path / "out/report_bm25_extractive.json").read_text())["config"]
    assert (config["case_limit"], config["total_input_cases"]) == (2, 3)
    assert cli.main(["evaluate", *files, "--retriever=bm25", f"--out={tmp_path}/all"]) == 0
    config = json.loads((tmp_path / "all/report_bm25_extractive.json").read_text())["config"]
    assert (config["case_limit"], config["total_input_cases"]) == (None, 3)


def test_a_run_that_breaks_off_tells_what_is_kept(spark, files, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    assert cli.main(["evaluate", *files, "--retriever=bm25", "--generator=groq", "--model=some/model", f"--out={tmp_path}/out"]) == 1
    said = capsys.readouterr().out
    assert "6 prompts at most: both stages of 3 of 3 cases" in said
    assert "no new report of bm25" in said and f"kept in {tmp_path}/out" in said


def test_a_hosted_judge_keeps_fifteen_seconds():
    a = cli.parser().parse_args(["evaluate", "--judge=groq", "--judge-model=some/model", "--request-interval=2"])
    seen = []
    pairs = object()
    judge = cli._hosted_judge(a, "place", None)

    def judged(rows, ask, *_, **__):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(providers, "hosted_support", lambda r, make: seen.append(make().interval))
            ask(rows)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(cache, "judged", judged)
        judge.ask(pairs)
    assert seen == [15.0]


def test_rescoring_takes_a_hosted_judge_with_its_model_only(spark, files, tmp_path):
    assert cli.main(["evaluate", *files, "--retriever=bm25", f"--out={tmp_path}/out"]) == 0
    report = f"{tmp_path}/out/report_bm25_extractive.json"
    with pytest.raises(SystemExit):
        cli.main(["rescore", report, *files, f"--out={tmp_path}/again", "--judge=groq"])
    assert cli.main(["rescore", report, *files, f"--out={tmp_path}/again", "--judge=lexical"]) == 0
