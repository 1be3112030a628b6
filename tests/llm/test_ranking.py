"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessellate.llm import ranking

WORDS = ["the", "The", "of", "é", "É", "中文", "x1", "a_b", "don't", "rare"]
ODD = [(1, None), (2, ""), (3, " ._ \n"), (4, "the same text"), (4, "the same text"), (5, "the same text"), (None, "the same text"), (None, None), (6, "x" * 70_000), (7, "the " * 9000), (8, "\x00the\x1f É rare")]
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for doc, c in counts:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def frame(spark, rows, key):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f"{key} long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("term", "score", "block", "n", "ids", "rank", "chunk")}).repartition(3)


@pytest.mark.parametrize(("block", "per_chunk", "most"), [(ranking.BLOCK, 128, 1 << 22), (7, 2, 0)])
def test_ranking_equals_brute_force(spark, block, per_chunk, most):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    docs = ODD + [(rnd.randrange(100), text(rnd.randrange(0, 12))) for _ in range(90)]
    items = [(1, "the rare of"), (2, None), (3, ""), (4, "absent"), (5, "É É 中文 x1 b"), (5, "don"), (None, "THE x1"), (6, "x" * 70_000)]
    got = ranking.ranked(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), 9, block, per_chunk, most).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, 9)


def test_empty_tables(spark):
    docs, items = frame(spark, ODD, "doc_id"), frame(spark, [(1, "the")], "item_id")
    assert ranking.ranked(docs.where("false"), items).count() == 0
    assert ranking.ranked(docs, items.where("false")).count() == 0


def test_bad_arguments(spark):
    docs = frame(spark, ODD, "doc_id")
    for more in ({"k": 0}, {"block": 1 << 17}):
        with pytest.raises(ValueError):
            ranking.ranked(docs, docs, **more)


def test_bitwise_sums_and_highest():
    rnd = np.random.default_rng(1)
    size, sums, plain = 192, np.zeros((24, 3, 3), np.uint64), np.zeros((3, 192), np.int64)
    for _ in range(30):
        places = np.sort(rnd.choice(size, rnd.integers(1, 60), replace=False))
        values = rnd.integers(1, 1 << 16, len(places))
        table = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : int(values.max()).bit_length()].T
        of = np.array([0, 2] if rnd.random() < 0.5 else [1])
        ranking.add(sums, of, ranking.spread_out(places, np.packbits(table, axis=1, bitorder="little").tobytes(), size))
        for j in of:
            plain[j, places] += values
    for j in range(3):
        for k in (1, 5, 191):
            sure, tied = ranking.highest(np.ascontiguousarray(sums[:, j]), k)
            best = sorted(plain[j][plain[j] > 0].tolist(), reverse=True)[:k]
            got = sorted([*plain[j][sure].tolist(), *plain[j][tied].tolist()[: k - len(sure)]], reverse=True)
            assert got == best
