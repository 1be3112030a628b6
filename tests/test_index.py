"""The stored index against rankings of the texts themselves."""

import random

import pytest

from tessellate.functions import text as T
from tessellate.operators import index, retrieve

WORDS = [f"w{i}" for i in range(60)]


def texts(rnd, n, first=0):
    return [(first + i, " ".join(rnd.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rnd.randrange(0, 40))) if rnd.random() > 0.05 else None) for i in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An index of three segments, with documents replaced and removed, and what is left of them."""
    path, rnd = str(tmp_path_factory.mktemp("index")), random.Random(5)
    first, second = texts(rnd, 120), texts(rnd, 60, 100)  # 100 to 119 are replaced
    third = texts(rnd, 10, 200)
    index.write_segment(path, 0, docs_of(spark, first), buckets=8)
    index.write_segment(path, 1, docs_of(spark, second), docs_of(spark, [(i, None) for i in range(0, 30)]).select("doc_id"), buckets=8)
    # 5 comes back, 150 is replaced, 120 and an unknown id are removed
    third += [(5, "w1 w2 back"), (150, "w3 w3 w3")]
    index.write_segment(path, 2, docs_of(spark, third), docs_of(spark, [(120, None), (999, None)]).select("doc_id"), buckets=8)
    left = {i: t for i, t in first if i >= 30} | dict(second)
    left.pop(120)
    return path, docs_of(spark, list((left | dict(third)).items()))


@pytest.fixture(scope="module")
def queries(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 12)))) for i in range(30)] + [(50, "absent"), (51, ""), (52, "w1 w1 w59 back")]
    return spark.createDataFrame(rows, "case_id long, question string")


def rows_of(df):
    return sorted((r["case_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def test_adding_and_removing_equal_a_rebuild(spark, built, queries):
    path, left = built
    assert rows_of(index.bm25(spark, path, queries, 5, buckets=8)) == rows_of(retrieve.bm25(left, queries, 5))
    found = retrieve.postings(left)
    assert sorted(map(tuple, index.postings(spark, path).select("doc_id", "term", "tf", "dl").collect())) == sorted(map(tuple, found.select("doc_id", "term", "tf", "dl").collect()))
    assert sorted(map(tuple, index.document_frequencies(spark, path).collect())) == sorted(map(tuple, retrieve.document_frequencies(found).collect()))
    assert tuple(index.collection(spark, path).first()) == pytest.approx(tuple(retrieve.collection(left).first()))


@pytest.mark.parametrize("k", [1, 5, 500])
def test_pruned_search_is_equal_and_sums_less(spark, built, queries, k):
    path, left = built
    assert rows_of(index.pruned_bm25(spark, path, queries, k, buckets=8)) == rows_of(retrieve.bm25(left, queries, k))
    counts = index.pruning(spark, path, queries, k, buckets=8).collect()
    assert all(r["summed"] <= r["postings"] for r in counts)
    if k == 1:
        assert sum(r["summed"] for r in counts) < 0.7 * sum(r["postings"] for r in counts)


def test_a_segment_written_again_replaces_itself(spark, built, queries, tmp_path):
    path, _ = built
    before = rows_of(index.bm25(spark, path, queries, 5, buckets=8))
    rnd = random.Random(5)
    _, second = texts(rnd, 120), texts(rnd, 60, 100)
    index.write_segment(path, 1, docs_of(spark, second), docs_of(spark, [(i, None) for i in range(0, 30)]).select("doc_id"), buckets=8)
    assert rows_of(index.bm25(spark, path, queries, 5, buckets=8)) == before


def test_compaction_keeps_results(spark, built, queries, tmp_path):
    path, left = built
    index.compact(spark, path, f"{tmp_path}/whole", buckets=8)
    assert rows_of(index.pruned_bm25(spark, f"{tmp_path}/whole", queries, 5, buckets=8)) == rows_of(retrieve.bm25(left, queries, 5))


def test_expanded_terms_and_text_ids(spark, tmp_path):
    docs = spark.createDataFrame([("a", "pricing plans"), ("b", "cost of plan"), ("c", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "price plan")], "case_id long, question string")
    index.write_segment(f"{tmp_path}", 0, docs, tokens=T.expanded_tokens)
    got = index.bm25(spark, f"{tmp_path}", asked, 3, T.expanded_tokens, "string")
    assert rows_of(got) == rows_of(retrieve.bm25(docs, asked, 3, T.expanded_tokens))


def test_an_empty_index(spark, queries, tmp_path):
    index.write_segment(f"{tmp_path}", 0, docs_of(spark, []))
    assert index.bm25(spark, f"{tmp_path}", queries, 3).count() == 0
    assert index.pruned_bm25(spark, f"{tmp_path}", queries, 3).count() == 0


def test_postings_are_moved_once_and_not_by_query(spark, built, queries, monkeypatch):
    """Hits of (case, document) are not shuffled; joins of hits, for terms too many to send, agree."""
    path, _ = built
    plans, best = [], retrieve.best

    def seen(found, *rest):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return best(found, *rest)

    monkeypatch.setattr(index, "best", seen)
    searches = (index.bm25, index.pruned_bm25)
    near = [rows_of(s(spark, path, queries, 5, buckets=8)) for s in searches]
    assert len(plans) == 2 and all("case_id" not in p and "BroadcastHashJoin" in p for p in plans)
    monkeypatch.setattr(index, "few", lambda rows: False)
    assert near == [rows_of(s(spark, path, queries, 5, buckets=8)) for s in searches] and len(plans) == 2


def test_tokens_are_counted_where_they_stand(spark, tmp_path, monkeypatch):
    """Only the deal to buckets moves postings; ids hidden by a segment are joined without words."""
    plans = []
    plain = index.stored
    monkeypatch.setattr(index, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    rows = [(1, "w1 w2 w1"), (1, "w1 w3 w3"), (2, None)]
    for n in (0, 1):
        index.write_segment(str(tmp_path), n, docs_of(spark, rows), buckets=4)
    assert [name for name, _ in plans] == ["hidden"] and "words" not in plans[0][1]
    got = index.postings(spark, str(tmp_path)).select("segment", "doc_id", "term", "tf").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "w1", 3), (1, 1, "w2", 1), (1, 1, "w3", 2)]
