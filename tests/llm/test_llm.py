"""The training-data operators against brute force, the libraries, and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessellate.llm import language, licenses, media, pieces, secrets, simhash, suffixes, tiling, tokens, urls
from tessellate.llm.registry import QUERIES, tokenizer
from tessellate.session import shipped

WORDS = ["the", "of", "thon", "inge", "é", "中文", "ba", "zz", "MIT", "License"]
# null, empty, blank, ties, repeated rows, a long text, odd characters
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "same text here again and again"), (4, "same text here again and again"), (5, "same text here again and again"), (None, "no id at all"), (6, "x" * 70_000), (7, "\x00\x1f ▁ <|endoftext|> 🙂 é中"), (8, "word " * 9000)]


def table(spark, rows, more=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if more:  # extra columns whose names clash with those the operators make
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("fp", "pid", "score", "host", "pieces", "found", "n_bytes", "node", "k")}).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    return df.repartition(3)


def random_text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=repr)


# 1 -- SentencePiece


@pytest.fixture(scope="module")
def model():
    return tokenizer("piece_bpe_32k.model")


def test_pieces_equal_the_library(model):
    import sentencepiece

    lib, ours, rnd = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Transducer(model), random.Random(1)
    letters = "abcdeehinorst ▁  <>sé中文🙂\n\t\x00,.'12"
    for _ in range(600):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60)))
        assert ours.encode(text).tolist() == lib.encode(text)
        some = [rnd.randrange(0, 32000) if rnd.random() < 0.6 else rnd.randrange(0, 259) for _ in range(rnd.randrange(0, 9))]
        assert ours.decode(some) == lib.decode(some)


def test_unigram_shortest_path_is_least_cost(model):
    t = pieces.Transducer(model)
    t.merges, t.score = False, {p: -len(p) ** 0.5 - 1 for p in t.ids}
    cost = lambda ids_: sum(-t.score[t.names[i]] for i in ids_)

    def every(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in t.ids:
                yield from ([t.ids[text[:k]], *rest] for rest in every(text[k:]))

    for text in ("there", "▁another", "nation"):
        assert cost(t.shortest(text)) == pytest.approx(min(map(cost, every(text))))


def test_pieces_table(spark, model):
    rows = pieces.encode_documents(table(spark, ODD), model).collect()
    assert ids(rows) == sorted((i for i, _ in ODD), key=repr)
    assert all(r["round_trip"] for r in rows) and all(r["n_pieces"] == len(r["pieces"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(pieces.encode_documents(table(spark, ODD), model), model).collect()}
    assert back[8] == "word " * 9000 and back[1] == ""


# 2 -- repeated strings


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49 if i is not None else 0):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], 1 << 62), i)
    out = []
    for i, t in rows:
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(raw) - 49 if i is not None else 0):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 22, 700])
def test_repeats_equal_brute_force(spark, chunk):
    rnd = random.Random(5)
    passages = [random_text(rnd, rnd.randrange(5, 60)) for _ in range(8)]
    rows = [(rnd.randrange(0, 90), "".join(rnd.choice(passages) if rnd.random() < 0.4 else random_text(rnd, 20) for _ in range(rnd.randrange(0, 6)))) for _ in range(100)]
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "a" * 49), (None, "a" * 90), (503, None), (7, rows[3][1])]
    got = suffixes.without_repeats(table(spark, rows), True, chunk, chunk).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute_repeats(rows)
    for r in got:
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_merged_transforms_give_sorted_intervals():
    rnd = random.Random(2)
    shards = [np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(n)), np.uint8) for n in (120, 300, 77)]
    windows = [np.arange(len(s) - 49) for s in shards]
    order, new = suffixes.merged(shards, windows)
    texts = [s.tobytes()[p : p + 50] for s, w in zip(shards, windows) for p in w]
    read = [texts[k] for k in order]
    assert read == sorted(texts) and new.tolist() == [True, *(a != b for a, b in zip(read, read[1:]))]


def test_repeats_odd_rows(spark):
    got = suffixes.without_repeats(table(spark, ODD), False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(ODD)
    assert suffixes.without_repeats(table(spark, [])).count() == 0


# 3 -- languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)


def test_viterbi_equals_brute_force():
    rnd = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    scores, starts = rnd.normal(size=(9, 3)), np.cumsum(lengths) - lengths
    labels = language.viterbi(scores, starts, lengths, 0.7)
    from itertools import product

    for s, n in zip(starts, lengths):
        value = lambda path: sum(scores[s + i, x] for i, x in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert value(labels[s : s + n]) == pytest.approx(max(map(value, product(range(3), repeat=int(n)))))


def test_mixed_text_has_spans_and_odd_rows(spark):
    train = [(i, "the cat and this thing with that") for i in range(40)] + [(i + 100, "der hund und diese sache mit das") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en" if i < 100 else "de") for i, t in train], "doc_id long, text string, lang string")
    m = language.train(docs)
    rows = [(900, "the cat and this thing with that " * 5 + "der hund und diese sache mit das " * 9), *ODD]
    got = {r["doc_id"]: r for r in language.language_id(table(spark, rows), m).collect()}
    assert got[900]["lang_pred"] == "de" and got[900]["n_spans"] == 2 and 0.5 < got[900]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert language.language_id(table(spark, []), m).count() == 0
    none = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.language_id(table(spark, ODD), none).collect()} == {"und"}


def test_a_rare_word_keeps_to_the_languages_of_its_script():
    weights = np.full((language.BUCKETS, 2), np.log(0.5 / 1e6), np.float32)
    weights[:, 0] -= 1  # a larger sample, so that unseen n-grams score lower for it
    m = language.Model("m", ["en", "ru"], weights, {"Latn": np.array([True, False]), "Cyrl": np.array([False, True])})
    for words, lang in ((["щит", "жаба", "ыыы", "эхо", "юла"], "ru"), (["zyx", "qua", "vow"], "en")):
        assert m.vectors(words).argmax(1).tolist() == [["en", "ru"].index(lang)] * len(words)
    got = language._judged(["zyx щит жаба ыыы эхо", "qua vow zyx юла", "中文"], m, language.PENALTY)
    assert got["lang_pred"][:2] == ["ru", "en"] and got["n_spans"] == [2, 2, 1] and got["lang_pred"][2] in ("en", "ru")


def test_long_words_are_not_remembered():
    m = language.Model("m", ["a", "b"], np.zeros((language.BUCKETS, 2), np.float32), {})
    scores = language.Scores(m)
    scores.of([["x" * 5000, "word"], ["y" * 5000]])
    assert set(scores.known) == {"word"}
    memo = __import__("tessellate.llm.common", fromlist=["Remembered"]).Remembered(4)
    memo.put("z" * 5000, 1), memo.put("z", 1)
    assert dict(memo) == {"z": 1}


def test_a_few_foreign_words_admit_no_language_to_a_script():
    letters = {"Latn": np.array([1000, 20, 0]), "Cyrl": np.array([3, 980, 0]), "Grek": np.array([0, 4, 0])}
    got = language.candidates(letters)
    assert {k: v.tolist() for k, v in got.items()} == {"Latn": [True, False, False], "Cyrl": [False, True, False], "Grek": [False, True, False]}
    assert language.candidates({}) == {}


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGS", 3)
    rows = [(i, "some text", f"l{i % 9}") for i in range(60)]
    with pytest.raises(ValueError, match="over 3 languages"):
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute_language(text, m, penalty):
    """(lang_pred, score, spans) by trying the steps of Viterbi one word and label at a time."""
    import json

    words = language.words_of(text)
    if not words:
        return ("und", 0.0, "[]")
    scores = [m.vectors([w])[0].astype(float).tolist() for w in words]
    best, back = scores[0], []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda k: (best[k], -k))
        step = [(k if best[k] >= best[top] - penalty else top) for k in range(len(best))]
        back.append(step)
        best = [max(best[k], best[top] - penalty) + row[k] for k in range(len(best))]
    label = max(range(len(best)), key=lambda k: (best[k], -k))
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    labels.reverse()
    letters = Counter()
    for k, w in zip(labels, words):
        letters[k] += len(w)
    top = min(letters, key=lambda k: (-letters[k], k))
    spans = []
    for k in labels:
        if spans and spans[-1][0] == m.langs[k]:
            spans[-1][1] += 1
        else:
            spans.append([m.langs[k], 1])
    return (m.langs[top], letters[top] / sum(letters.values()), json.dumps(spans))


def test_labels_of_mixed_text_equal_brute_force(spark):
    rnd = random.Random(17)
    kinds = {"de": "und der die das nicht straße über mit von zu".split(), "en": "and the that this not street over with from to".split(), "ru": "и это что не улица над с из к дом".split()}
    text = lambda ks, n: " ".join(rnd.choice(kinds[rnd.choice(ks)]) for _ in range(n))
    rows = [(i, text([k], 30) + (" дом" if k == "en" and i % 20 == 0 else ""), k) for i, k in enumerate(list(kinds) * 40)]
    m = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.scripts["Cyrl"].tolist() == [False, False, True] and m.scripts["Latn"].tolist() == [True, True, False]
    mixed = [(i, "; ".join(text([rnd.choice(list(kinds))], rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 5)))) for i in range(150)] + [(900, None), (901, "12 !"), (902, "中文 の"), (903, "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["spans"]) for r in language.language_id(table(spark, mixed), m).collect()}
    for i, t in mixed:
        want = brute_language(t, m, language.PENALTY)
        assert got[i][::2] == want[::2] and got[i][1] == pytest.approx(want[1])


# 4 -- SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows, distance=3):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(rows[a][1] ^ rows[b][1]).count("1") <= distance:
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((rows[k][0], least.get(find(k))) for k in range(len(rows)))


def test_fingerprints_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, random_text(rnd, rnd.randrange(0, 12))) for i in range(60)] + ODD[:6]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    want = Counter((i, f"{brute_fingerprint(t):016x}") for i, t in rows)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == want
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == brute_components([(i, brute_fingerprint(t)) for i, t in rows])


@pytest.mark.parametrize("tile", [4096, 3])
def test_components_equal_brute_force(spark, tile):
    rnd, fps = random.Random(3), [0, 0]
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 12)):
            y = x
            for _ in range(rnd.randrange(0, 5)):
                y ^= 1 << rnd.randrange(64)
            fps.append(y)
            x = y if rnd.random() < 0.3 else x
    rows = [(i if i % 7 else None, f) for i, f in zip(rnd.sample(range(10_000), len(fps)), fps)]
    a, b = rnd.getrandbits(64), rnd.getrandbits(64)  # one id with two texts, each near to another's
    rows += [(20_005, a), (20_005, b), (20_004, b ^ 1), (20_006, a ^ 2), (20_006, b ^ 4)]
    shipped(spark)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    got = simhash.linked(df, tile=tile).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == brute_components(rows)


def test_recall_of_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.8 exactly: 40 shingles of 50 in common."""
    rnd = random.Random(21)
    rows, n = [], 250
    for k in range(n):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(49)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-5], *(f"v{rnd.randrange(10**6)}" for _ in range(5))]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, rows)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(n)) >= 0.9 * n
    assert all(got[i] // 2 == i // 2 for i in got)


def test_similar_documents(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    near = list(base)
    for k in range(0, 400, 80):
        near[k] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))), (4, None), (5, "")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_similar_documents_are_judged_by_their_sets(spark):
    rnd = random.Random(19)
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))}
    alike = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    texts = []
    for changed in (2, 6, 7, 8, 9, 10, 11, 12, 14):
        for _ in range(3):
            words = [f"w{rnd.randrange(9000)}" for _ in range(300)]
            texts.append(" ".join(words))
            for k in range(changed):
                words[10 + 20 * k] = "changed"
            texts.append(" ".join(words))
    texts += ["one two three four five " * 400, "one two three four five " * 400 + texts[0]]  # same majority of shingles, other set
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, list(enumerate(texts)))).collect()}
    values = {k: alike(texts[k], texts[k + 1]) for k in range(0, len(texts), 2)}
    assert sum(0.7 < v < 0.8 for v in values.values()) >= 6 and sum(v >= 0.8 for v in values.values()) >= 6
    assert [k for k, v in values.items() if v < 0.8 and got[k + 1] == k] == []
    assert [k for k, v in values.items() if v >= 0.85 and got[k + 1] != k] == []


def test_exact_forest_equals_brute_force():
    rnd = random.Random(20)
    for _ in range(30):
        base = rnd.sample(range(100), 20)
        sets = [sorted({x if rnd.random() < 0.93 else rnd.randrange(200) for x in base}) for _ in range(25)]
        edges = simhash.exact_forest(np.arange(25), np.array(list(map(len, sets))), np.concatenate(sets), 0.8)
        want = list(range(25))
        for a in range(25):
            for b in range(a):
                if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8:
                    want = [want[b] if w == want[a] else w for w in want]
        have = list(range(25))
        for a, b in edges:
            have = [have[b] if w == have[a] else w for w in have]
        assert {(a, b) for a in range(25) for b in range(25) if want[a] == want[b]} == {(a, b) for a in range(25) for b in range(25) if have[a] == have[b]}


def merged_by(pairs, n):
    label = list(range(n))
    for a, b in pairs:
        label = [label[b] if x == label[a] else x for x in label]
    return label


@pytest.mark.parametrize("tile", [1 << 20, 30])
def test_exact_links_equal_brute_force(spark, tile):
    rnd = random.Random(21)
    base, other = rnd.sample(range(300), 20), rnd.sample(range(300), 20)
    sets = [sorted({x if rnd.random() < 0.95 else rnd.randrange(300) for x in (base if k % 3 else other)}) for k in range(40)] + [[]]
    shipped(spark)
    groups = spark.createDataFrame([(k, 0 if k < 30 else 30) for k in range(41)], "node long, comp long")
    members = spark.createDataFrame([(k, bytearray(np.array(x, "<u8").tobytes())) for k, x in enumerate(sets)], "node long, members binary")
    got = [tuple(r) for r in simhash.exact_links(groups, members, 0.8, tile).collect()]
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = [(a, b) for a in range(40) for b in range(a) if (a < 30) == (b < 30) and alike(sets[a], sets[b])]
    assert set(got) <= set(want) | {(a, b) for a in range(40) for b in range(a) if merged_by(want, 41)[a] == merged_by(want, 41)[b]}
    have, wish = merged_by(got, 41), merged_by(want, 41)
    assert all((have[a] == have[b]) == (wish[a] == wish[b]) for a in range(41) for b in range(a))


def test_bit_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 14, 255, 256, 1020):
        rows = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 4), dtype=np.uint64)
        assert sorted(simhash.bit_counts(rows)) == sorted(np.unpackbits(rows.view(np.uint8), axis=1).sum(0))


@pytest.mark.parametrize("tile", [4096, 10])
def test_edges_are_few_and_do_not_depend_on_order(spark, tile):
    """A cluster of near copies that meets in many keys: about an edge for each node goes on."""
    from pyspark.sql import functions as F

    rnd = random.Random(22)
    base = [rnd.randrange(1 << 24) for _ in range(85)]
    keys = [(k, (c << 24) + (x if rnd.random() < 0.6 else rnd.randrange(1 << 24))) for k in range(300) for c, x in enumerate(base)]
    words = spark.createDataFrame([(k, rnd.getrandbits(20)) for k in range(300)], "node long, w0 long")
    shipped(spark)
    found = []
    for _ in range(2):
        rnd.shuffle(keys)
        edges = simhash.links(spark.createDataFrame(keys, "node long, key long").repartition(5), words.orderBy(F.rand()), 20, tile)
        found.append(sorted(map(tuple, edges.collect())))
    assert found[0] == found[1]
    assert simhash.thinned(spark.createDataFrame(found[0], "u long, v long")).count() < 700
    keyed = spark.createDataFrame(keys, "node long, key long")
    early = simhash.components(simhash.links(keyed.where("key < 6 * 16777216"), words, 20, tile))
    assert simhash.links(keyed.where("key >= 6 * 16777216"), words, 20, tile, early).count() <= 300 - early.count()
    assert {r["comp"] for r in simhash.components(spark.createDataFrame(found[0], "u long, v long")).collect()} == {0}


# 5 -- URLs


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q", None), (2, "https://b.net", ""), (3, "https://b.net/", ""), (4, "http://example.com/de/1#t", ""), (5, "http://x.org/fr/", ""), (6, None, None), (7, "no scheme", ""), (8, "http://notexample.com/de/", ""), (8, "http://notexample.com/de/", "")]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows)).collect()}
    assert [got[i]["rule"] for i in range(1, 9)] == ["example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None, None]
    assert [got[i]["verdict"] for i in (1, 3, 4, 5, 6, 7, 8)] == ["allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[1]["host"], got[1]["path"]) == ("a.example.net", "/en/x") and (got[6]["host"], got[6]["path"]) == ("", "")
    assert urls.judged(pages(spark, [])).count() == 0


def test_distrust_travels_against_links_and_trust_along(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://good.org/fr/1", link("friend.info")), (2, "http://bad.net/1", ""), (3, "http://farm.info/1", link("bad.net", "bad.net")), (4, "http://friend.info/1", ""), (5, "http://alone.info/", "")]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows)).collect()}
    assert got[3]["verdict"] == "block" and got[4]["verdict"] == got[5]["verdict"] == "allow"
    assert got[4]["trust"] == pytest.approx(0.15 * 0.85) and got[3]["distrust"] == pytest.approx(0.15 * 0.85) and got[5]["trust"] == 0


def test_distrust_reaches_hosts_however_far_and_faint(spark):
    link = lambda n, h: f'<a href="http://{h}/">x</a>' * n
    rows = [(0, "http://h0.net/", "")] + [(i, f"http://h{i}.info/", link(1, "h0.net" if i == 1 else f"h{i - 1}.info")) for i in range(1, 12)]
    rows += [(20, "http://b.net/", ""), (21, "http://hub.info/", link(1500, "b.net")), (22, "http://one.info/", link(1, "b.net"))]
    rows += [(23, "http://hub2.info/", link(1500, "one.info")), (24, "http://faint.info/", link(1, "one.info"))]
    rows += [(30, "http://p.org/fr/", link(1, "q.info")), (31, "http://q.info/", link(1, "p.org")), (32, "http://lone.info/", "")]
    got = {r["page_id"]: r for r in urls.judged(pages(spark, rows)).collect()}
    assert [i for i, r in got.items() if r["verdict"] == "allow"] == [30, 31, 32] and got[24]["distrust"] == 0  # rounded
    assert got[11]["distrust"] == pytest.approx(0.5 * 0.15 * 0.85**11, abs=1e-6)  # two hosts share the seeds' mass
    assert got[30]["trust"] == pytest.approx(0.15 / (1 - 0.85**2), rel=1e-5)  # the sum of all rounds


def test_linked_pages_equal_the_sql(spark, tmp_path):
    """Real links, hot hosts, cycles, parents, clashing columns, null ids, long html."""
    import duckdb
    from pyspark.sql import functions as F

    rnd = random.Random(23)
    hosts = ["h0.net", "a.org", "b.org", "x.example.net", "example.com", "sub.example.com"] + [f"h{i}.info" for i in range(30)]
    link = lambda: f'<a href="http://{rnd.choice(hosts) if rnd.random() < 0.6 else "h1.info"}/p">x</a> '
    rows = [(i if i % 9 else None, f"http://{rnd.choice(hosts)}/{rnd.choice(['fr', 'en', 'de', 'x'])}/", "".join(link() for _ in range(rnd.randrange(0, 5)))) for i in range(150)]
    rows += [(500, "http://h2.info/", link() * 3000), (501, None, link()), (502, "http://h3.info", None)]
    df = pages(spark, rows)
    df.withColumns({c: F.lit("clash") for c in ("rule", "mass", "src", "host", "kind", "n")}).write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.judged(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda r: tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    want = con.execute(f"SELECT page_id, host, path, rule, verdict, trust, distrust FROM ({urls.oracle()})").fetchall()
    have = [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")) for r in got.collect()]
    assert sorted(map(key, have)) == sorted(map(key, want)) and {r[4] for r in have if r[3] is None} == {"allow", "block"}


# 6 -- licenses


def test_license_base_equals_brute_force(spark):
    rnd = random.Random(6)
    phrases = ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "cc by nc", "under teh MIT license", "apache license version 1", "cc by nd"]
    rows = [(i, " ".join(rnd.choice([*phrases, *WORDS]) for _ in range(rnd.randrange(0, 12)))) for i in range(150)] + ODD
    got = Counter(tuple(r) for r in licenses.license_digests(table(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = Counter()
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        found = [(p, n.label) for n in licenses.NOTICES if n.base for p in range(len(words)) if words[p : p + len(n.phrase.split())] == n.phrase.split()]
        at = [p for p, _ in found]
        want[i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert got == want


def test_license_edits():
    n, found = licenses.scan("Released under teh MIT license. Not the apache license version 1, nor under the bit license.")
    assert [(x[0], x[3] > 0, x[4]) for x in found] == [("mit", True, False)] and n == 16
    assert licenses.scan("under the mit license under the mit license")[1] == [("mit", 0, 4, 0, True), ("mit", 4, 8, 0, True)]


def test_fuzzy_notices_equal_brute_force():
    """Every place where the bounded-error expression matches whole words and holds the key words
    is found, and nothing else is."""
    rnd = random.Random(25)

    def spoiled(phrase, edits):
        out = list(phrase)
        for _ in range(edits):
            at = rnd.randrange(len(out))
            if rnd.random() < 0.5 and out[at] != " ":
                out[at] = rnd.choice("abcdefgh")
            elif out[at] != " ":
                del out[at]
        return "".join(out)

    for _ in range(300):
        notice = rnd.choice(licenses.NOTICES)
        text = f"zzz qqq {spoiled(notice.phrase, rnd.randrange(0, 5))} www yyy"
        line = b" " + b" ".join(licenses.words_of(text)) + b" "
        got = [x for x in licenses.scan(text, (notice,))[1]]
        m = notice.pattern.search(line)
        ok = bool(m) and all(k.encode() in m[0].split() for k in notice.keys)
        assert (len(got) == 1) == ok, (text, got)
        if ok:
            assert got[0][3] == sum(m.fuzzy_counts) and got[0][0] == notice.label


# 7 -- media


def test_media_round_trip_and_features(spark):
    got = media.media_columns(table(spark, ODD)).collect()
    texts = Counter((i, t) for i, t in ODD)
    for r in got:
        text = next(t for (i, t), n in texts.items() if i == r["doc_id"])
        raw = (text or "").encode()
        payload = media.from_wav(bytes(r["media"]))
        assert payload == raw + bytes(-len(raw) % 64 if raw else 64) and r["n_bytes"] == len(raw)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
    same = [r["feature"] for r in got if r["doc_id"] in (4, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    assert media.media_columns(table(spark, [])).count() == 0


def test_a_tone_peaks_in_its_bin():
    t = np.arange(4096)
    peaks = media.peaks_of((128 + 100 * np.sin(2 * np.pi * 20 / 256 * t)).astype(np.uint8).tobytes())
    assert set(peaks[:, 1]) == {20} and len(media.pairs_of(peaks)[0]) > 0
    assert len(media.pairs_of(media.peaks_of(bytes([128]) * 640))[0]) == 0


def test_the_last_frame_covers_the_tail():
    assert [len(media.peaks_of(bytes([128]) * n)) for n in (64, 256, 320, 384, 448, 960, 1024)] == [1, 1, 2, 2, 3, 7, 7]
    wave = lambda k, n: (128 + 100 * np.sin(2 * np.pi * k / 256 * np.arange(n))).astype(np.uint8).tobytes()
    for n in (320, 448, 960):  # 64 over whole frames
        low, high = (media.peaks_of(wave(20, n - 64) + wave(k, 64)) for k in (16, 100))
        assert (low[:-1] == high[:-1]).all() and (low[-1] != high[-1]).any()


def test_features_equal_brute_force():
    rnd = random.Random(24)
    for n in (0, 60, 300, 1500):
        samples = media.payload_of("".join(rnd.choice("abc xyz") for _ in range(n)))[1]
        frames = 1 + max(0, -(-(len(samples) - 256) // 128))
        x = [b - 128.0 for b in samples] + [0.0] * (256 + (frames - 1) * 128 - len(samples))
        peaks = []
        for f in range(frames):
            part = x[f * 128 : f * 128 + 256]
            mean = sum(part) / 256
            w = [(v - mean) * (0.5 - 0.5 * np.cos(2 * np.pi * i / 255)) for i, v in enumerate(part)]
            power = [abs(sum(v * np.exp(-2j * np.pi * k * i / 256) for i, v in enumerate(w))) ** 2 for k in range(129)]
            level = max(sum(power[1:]) / 128, 1e-6)
            best = [max(range(lo, hi), key=lambda k: power[k]) for lo, hi in media.BANDS]
            peaks.append([k if power[k] > level else -1 for k in best])
        assert media.peaks_of(samples).tolist() == peaks
        want = sorted((t, (a << 10) | (b << 2) | d) for t, p in enumerate(peaks) for d in (1, 2, 3) if t + d < frames for a in p for b in peaks[t + d] if a >= 0 and b >= 0)
        assert list(zip(*(v.tolist() for v in media.pairs_of(media.peaks_of(samples))))) == want


# 8 -- greedy string tiling


def brute_tiles(doc, item, width):
    marks_d, marks_i, out = [0] * len(doc), [0] * len(item), []
    while True:
        best = (width - 1, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not marks_d[p + n] and not marks_i[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < width:
            return out
        n, p, q = best
        marks_d[p : p + n], marks_i[q : q + n] = [1] * n, [1] * n
        out.append(best)


def test_an_index_of_a_full_block_takes_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, resource
from tessellate.llm import tiling
rnd, items, size = random.Random(1), [], 0
while size < tiling.BLOCK_BYTES:
    items.append((len(items), " ".join(f"word{rnd.randrange(300_000)}" for _ in range(30))))
    size += len(items[-1][1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tiling.Suite(items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=200)
    assert int(out.stdout.split()[-1]) < 300, out.stderr


def test_tiles_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        doc, item = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (50, 20)]
        suite = tiling.Suite([(1, b" ".join(item).decode())], 3)
        got = tiling.tiles(item, tiling.matches(doc, item, suite.hits(doc).get(0, []), 3), 3)
        assert sorted(n for n, _, _ in got) == sorted(n for n, _, _ in brute_tiles(doc, item, 3)) and got == brute_tiles(doc, item, 3)


def test_contamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"before {item} after"), (2, "seven eight nine ten eleven twelve; ONE TWO three, four five six!"), (3, "one two three four five"), (4, None), (None, item), (1, f"before {item} after")]
    bench = spark.createDataFrame([(7, item), (8, "tiny item"), (9, None), (None, "")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in tiling.contaminated(table(spark, rows), bench).collect()), key=repr)
    assert got == [(1, 7, 1.0, 1), (1, 7, 1.0, 1), (2, 7, 1.0, 2), (None, 7, 1.0, 1)]
    assert sorted(map(str, tiling.contaminated(table(spark, rows), bench, block_bytes=10).collect())) == sorted(map(str, tiling.contaminated(table(spark, rows), bench).collect()))
    assert ids(tiling.clean(table(spark, rows), bench, block_bytes=10).collect()) == [3, 4]
    assert ids(tiling.clean(table(spark, rows), bench).collect()) == [3, 4]
    assert tiling.contaminated(table(spark, rows), bench.where("false")).count() == 0 and tiling.contaminated(table(spark, []), bench).count() == 0


def test_short_items_match_whole(spark):
    rnd = random.Random(18)
    words = ["alpha", "beta", "gamma", "delta"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate((1, 2, 2, 3, 3, 4, 4, 5, 6, 0))]
    rows = [(i, " ".join(rnd.choice([*words, "x", "y", "z"]) for _ in range(rnd.randrange(0, 14)))) for i in range(80)]
    got = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        for k, item in items:
            doc, test = t.encode().split(), item.encode().split()
            if test and sum(n for n, _, _ in brute_tiles(doc, test, min(5, len(test)))) >= 0.8 * len(test):
                want.add((i, k))
    assert got == want and {k for _, k in want} >= {0, 1, 2}


def test_repeated_words_list_each_match_once():
    suite = tiling.Suite([(1, "again " * 300), (2, "here we go " * 100)])
    found = suite.hits([b"again"] * 3000 + [b"here", b"we", b"go"] * 900)
    assert len(found[0]) < 3400 and len(found[1]) < 3200
    assert [x["coverage"] for x in tiling.judge("again " * 3000 + "here we go " * 900, suite)] == [1.0, 1.0]


def test_rolled_hashes_are_polynomials():
    codes = tiling.coded([b"a", b"b", b"c", b"a", b"b", b"c", b"d"])
    base = int(tiling._BASE)
    for width in (1, 3, 5):
        want = [sum(int(codes[i + j]) * base ** (width - 1 - j) for j in range(width)) % (1 << 64) for i in range(8 - width)]
        assert tiling.rolled(tiling.running(codes), width).tolist() == want


# 9 -- secrets


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secret_base_equals_brute_force(spark):
    rnd = random.Random(7)
    parts = ["password", "TOKEN", "apiKey", "api_key", "secret", "=", ": ", '"', "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é", " ", "中", "tokentoken=secret=x", "ſecret=abcdefgh"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14)))) for i in range(400)] + ODD
    got = secrets.secret_digests(table(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        base = brute_secrets(t)
        n = Counter(k for k, _, _ in base)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want


def test_checksums_and_redaction(spark):
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"
    assert [k for _, k, _ in secrets.scan(f"é {good} x")] == ["github"] and secrets.scan(f"é {good} x")[0][0] == 2
    assert secrets.scan(f"{good[:-1]}{'0' if good[-1] != '0' else '1'}") == []
    assert secrets.cleaned(f"a {good} b password=abcdefgh c") == "a [REDACTED] b [REDACTED] c"
    rows = {r["doc_id"]: r["text"] for r in secrets.redact(table(spark, [(1, f"x {good}"), (2, None), (3, "")])).collect()}
    assert rows == {1: "x [REDACTED]", 2: None, 3: ""}


def test_redaction_leaves_nothing_of_a_private_key(spark):
    rnd = random.Random(12)
    lines = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(5)] + ["Qk9vbQ=="]
    for label in ("", "RSA ", "OPENSSH ", "ENCRYPTED "):
        begin, end = f"-----BEGIN {label}PRIVATE KEY-----", f"-----END {label}PRIVATE KEY-----"
        heads = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
        for gap in ("\n", "\r\n", "\\n", " "):
            assert secrets.cleaned(f"é a {gap.join([begin, *lines, end])} b") == "é a [REDACTED] b"
        assert secrets.cleaned("\n".join(["a", begin, heads + lines[0], *lines[1:], end, "b"])) == "a\n[REDACTED]\nb"
        cut = "\n".join([begin, *lines])  # no closing line
        assert secrets.cleaned(f"a\n{cut}\nsome words here") == "a\n[REDACTED]\nsome words here"
        assert secrets.cleaned(f"a\n{begin}\n{heads}{lines[0]}\n{lines[1]}\nsome words here") == "a\n[REDACTED]\nsome words here"
        assert secrets.cleaned(cut) == "[REDACTED]" and secrets.cleaned(f"{cut}\nplain text\n{cut}\n{end}") == "[REDACTED]\nplain text\n[REDACTED]"
        assert secrets.cleaned(f"{begin} opens a key") == "[REDACTED] opens a key"
        text = f"中 {cut}\n{end}."
        assert ("pem", 2, len(text) - 1) in [(k, s, e) for s, k, e in secrets.scan(text)]
    assert secrets.cleaned(f"-----BEGIN CERTIFICATE-----\n{lines[0]}\n-----END CERTIFICATE-----").startswith("-----BEGIN CERTIFICATE")
    got = secrets.redact(table(spark, [(1, f"x {cut}\n{end} y")])).first()["text"]
    assert got == "x [REDACTED] y"


# 10 -- tokens


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib, ours, rnd = Tokenizer.from_file(path), tokens.Counter(path), random.Random(10)
    letters = "abcdetThe   's'll\n\t\x00\x1c\x85\xa0é中🙂12½_-<|endoftext|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 80))) for _ in range(800)] + ["a<|endoftext|>b<|endoftext|>", "aaaa" * 3000, " " * 300]
    assert [ours.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = {(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(table(spark, ODD), path).collect()}
    assert got == {(i, n, n > 512) for i, t in ODD for n in [len(lib.encode(t or "", add_special_tokens=False).ids)]}


def test_proven_strings_encode_alone():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib, some = Tokenizer.from_file(path), sorted(tokens.counter(path).proven)[::97]
    words = [w for w in some if len(tokens.counter(path).split.findall(w)) == 1]
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in words) and len(words) > 300


def test_empty_tables_give_empty_tables(spark, model):
    none = table(spark, [])
    for out in (pieces.encode_documents(none, model), licenses.license_digests(none), secrets.secret_digests(none), tokens.token_counts(none, tokenizer("byte_bpe_50k.json")), media.media_columns(none, False), secrets.redact(none)):
        assert out.count() == 0


# the queries and the pipeline


def test_queries_cover_their_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        n = df.count()
        if name == "op8_decontamination":
            assert n > 0 and "doc_id" in df.columns
        elif name == "op12_ranked_search":
            items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
            assert 0 < n <= 50 * items and df.select("item_id").distinct().count() == items
        elif name == "op5_url_filter":
            assert n == spark.read.parquet(f"{sf}/pages.parquet").count()
        else:
            assert n == docs, name


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rnd = random.Random(11)
    plain = [" ".join(rnd.choice("the cat and this thing with that house river stone green tall".split()) + str(rnd.randrange(900)) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    rows += [(100, plain[3], "en", "s", 1), (101, "12345 !!", "en", "s", 1), (102, None, None, None, None), (103, f"{plain[5]} {item}", "en", "s", 1), (104, f"{rnd.random()} password=abcdefgh {item[:10]} some other words here to be kept whole", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(30), 104]
    t = pieces.Transducer(tokenizer("piece_bpe_32k.model"))
    assert "password" not in t.decode(got[104]["pieces"]) and t.decode(got[7]["pieces"]) == plain[7]
    assert [len(corpus_pipeline.STAGES), *(s[0] for s in corpus_pipeline.STAGES)][0] == 5


def test_stages_keep_columns_that_clash_with_theirs(spark, tmp_path):
    from pyspark.sql import functions as F

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ("text_mark", "kept_id", "kept_mark", "id", "mark", "row", "comp", "node", "least", "a.b")
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [(1, "the cat and this thing with that house"), (2, "the cat and this thing with that house"), (None, "another thing that is said here")])
    docs = docs.withColumns({c: F.lit("clash") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert set(names) < set(docs.columns)
    assert ids(docs.collect()) == [1, None] and docs.select("`a.b`").first()[0] == "clash"
    assert docs.where("false").count() == 0


def test_dedup_judges_rows_without_id_and_rows_that_share_an_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(13)
    a, b, c, d = (" ".join(f"w{rnd.randrange(9000)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " more"), (1, b), (1, c), (1, c), (2, b), (None, c), (3, d), (4, d), (None, "")]
    assert corpus_pipeline.STAGES[1][1].__name__ == "dedup_stage"
    for few in (simhash.FEW, 0):  # what is sent to all tasks, and what is joined by a shuffle
        got = simhash.without_similar(table(spark, rows), few)
        left = Counter((r["doc_id"], r["text"]) for r in got.collect())
        first = next(k for k in left if k[0] is None and k[1] != "")
        assert first[1] in (a, a + " more") and left == Counter([first, (1, b), (1, c), (3, d), (None, "")])
