"""Claims against a corpus, equal to the judge over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessellate.operators import evidence
from tessellate.operators.judge import JUDGES

WORDS = "Rome Oslo backup keeps files days plan costs Team blue never month restore 30 90 gb not year".split()


def rows(rnd, n, least, most):
    return [" ".join(rnd.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=rnd.randrange(least, most))) + rnd.choice([".", "!", ""]) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_support_equals_the_judge_over_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 10))
    texts = [" ".join(rows(rnd, rnd.randrange(0, 5), 2, 9)) for _ in range(60)]
    texts += [texts[3], texts[3], None, "", "The plan is for 30 days."]  # copies count for each document
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    claims = spark.createDataFrame([*enumerate(rows(rnd, 50, 1, 7)), (90, "The."), (91, None), (92, ""), (93, "no such words at all"), (94, "The plan is for 30 days."), (95, "The plan is for 30 days.")], "claim_id long, claim string")
    got = evidence.supporting(docs, claims, threshold)
    pairs = claims.where("claim IS NOT NULL").crossJoin(evidence.sentences_of(docs))
    judge = JUDGES["conservative"].__class__("c", "2.0", JUDGES["conservative"].supported, threshold)
    ok = F.get(judge(F.array(F.struct("claim", F.array("sentence").alias("evidence")))), F.lit(0))
    want = pairs.where(ok).select("claim_id", "doc_id", "pos")
    found = sorted(map(tuple, got.select("claim_id", "doc_id", "pos").collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) > 20
    counts = {r["claim_id"]: (r["documents"], r["first_id"]) for r in evidence.support_counts(docs, claims, threshold).collect()}
    assert set(counts) == {*range(50), *range(90, 96)} and counts[90] == counts[91] == counts[93] == (0, None)
    assert counts[94] == counts[95] and counts[94][0] >= 1


def test_empty_tables_and_bad_thresholds(spark):
    docs = spark.createDataFrame([(1, "One thing here.")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "One thing here.")], "claim_id long, claim string")
    assert evidence.supporting(docs.where("false"), claims).count() == 0
    assert evidence.supporting(docs, claims.where("false")).count() == 0
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            evidence.supporting(docs, claims, bad)
