"""Language-model scores against brute force and on held-out text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.llm import maxent

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same text here"), (4, "same text here"), (5, "same text"), (None, "no id"), (None, None), (6, "x" * 70_000), (7, "word " * 3000), (8, "\x00\x1f É é\x85 unheard-of")]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0d]+", low)] + [b"\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus(n=160, seed=4):
    rnd = random.Random(seed)
    kinds = [[f"{p}{i}" for i in range(40)] for p in ("al", "Bo", "çu")]
    return ODD + [(100 + i, " ".join(rnd.choices(kinds[i % 3], [1 / (j + 1) for j in range(40)], k=rnd.randrange(0, 60)))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("token", "n", "row", "score", "rare", "task", "held_out")}).repartition(3)


@pytest.fixture(scope="module")
def scored(spark):
    old, maxent.WORDS = maxent.WORDS, 30  # most tokens are outside of the frequent ones
    try:
        docs = frame(spark, corpus())
        model, counts = maxent.train(docs)
        return model, maxent.scored(docs, model, counts).collect()
    finally:
        maxent.WORDS = old


def plain(text, model, counts):
    """The text's log10 probability, token by token."""
    total, own, code = 0.0, [], []
    flat = words(text)
    end = model.words[b"\n"]
    for t, w in enumerate(flat):
        i = model.words.get(w, -1)
        one, two, three = ([int(model.of[end])] * 3 + own)[-1], ([int(model.of[end])] * 3 + own)[-2], ([int(model.of[end])] * 3 + own)[-3]
        last = zlib.crc32(flat[t - 1] if t else b"\n")
        last = (((last ^ (last >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 19
        z = model.bias + model.ones[one] + model.twos[two] + model.weights[one * maxent.N_OUT + two] + model.weights[maxent.SKIP + three] + model.weights[maxent.WORD + last]
        c = int(model.of[i])
        p = math.exp(z[c]) / np.exp(z.astype(float)).sum()
        p *= 10 ** model.share[i] if i >= 0 else (counts[w] + 1) / (model.rest + model.distinct_rest + 1)
        total += math.log10(p)
        own.append(c)
        code.append(w)
    return total


def test_scores_equal_brute_force(scored):
    model, got = scored
    rows = corpus()
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        flat = words(t)
        want.append((i, held(i), len(flat), sum(counts[w] > 0 for w in flat), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in flat), plain(t, model, counts)))
    order = lambda r: (repr(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one(scored):
    model, _ = scored
    p = maxent.softmax(model.table(), np.array([[0, 5], [maxent.SKIP, maxent.SKIP + 3], [maxent.WORD, maxent.WORD + 77]]))
    assert p.sum(1) == pytest.approx(1, abs=1e-5)
    for c in set(model.of[:-1].tolist()):
        assert (10 ** model.share[:-1][model.of[:-1] == c]).sum() == pytest.approx(1)


def test_held_out_text_is_likelier_than_by_its_tokens_alone(spark):
    docs = frame(spark, corpus(600)[len(ODD) :])
    one = maxent.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert one[2] > 50 and one[0] > one[1] + 0.1 * one[2]


def test_without_training_tokens(spark):
    assert maxent.lm_scores(frame(spark, ODD).where("false")).count() == 0
    rows = [(i, "all held out") for i in range(200) if held(i)][:3]
    got = maxent.lm_scores(frame(spark, rows)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(4, 0, 0, 0.0, 0.0)] * 3
