"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores
with a switching penalty labels spans of mixed-language text.

Training counts hashed character n-grams (1 to 4, with word bounds) of each language in
a table of fixed size; it reads a bounded sample of the labelled rows (at most
`per_lang` whole documents of each language and `max_docs` in all, taken by a hash of
the id), counted on the executors.  The model is `BUCKETS` x languages numbers and the
scripts seen with each language, whatever the input's size.

A word's score for a language is the mean log share of its n-grams, scaled by the square
root of its letters.  A script's candidates are the languages of whose letters in training it
holds at least SHARE, so a few words in a foreign script admit none; all others are out of the
question (minus infinity) for its words.  Where no language has that share, those that were seen
with the script are candidates.  The Viterbi steps run over many documents at once.

Over MAX_LANGS different labels are an error: the model is BUCKETS numbers for each.

Defined cases: a null text or one without a letter is `und` with score 0; a word of a
script unseen in training keeps all languages; ties go to the first language in sorted
order; null ids pass through; repeated rows are each labelled; other columns are ignored; an
empty table gives an empty table; whole texts are labelled, and a run of over LONGEST letters
is scored anew each time, so that texts without spaces take no room in a worker's memory.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LONGEST, by_document, shipped

BUCKETS = 1 << 16
PENALTY = 6.0  # log units that a change of language costs
PER_LANG, MAX_DOCS, PARTS = 1000, 12_000, 100
MAX_LANGS, SHARE = 200, 0.05
CACHE = 1 << 17
TOKENIZED, HELD = 500, 1 << 22  # documents, scores
UND = "und"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}']*")
# First code points of script ranges, and their names (Unicode blocks).
RANGES = ((0x0, "Latn"), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x900, "Deva"), (0x980, "Beng"), (0xA00, "Guru"), (0xA80, "Gujr"), (0xB00, "Orya"), (0xB80, "Taml"), (0xC00, "Telu"), (0xC80, "Knda"), (0xD00, "Mlym"), (0xD80, "Sinh"), (0xE00, "Thai"), (0xE80, "Laoo"), (0xF00, "Tibt"), (0x1000, "Mymr"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Ethi"), (0x1780, "Khmr"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2C00, "Glag"), (0x2C60, "Latn"), (0x2E80, "Hani"), (0x3040, "Kana"), (0x3100, "Bopo"), (0x3130, "Hang"), (0x3400, "Hani"), (0xA000, "Yiii"), (0xA720, "Latn"), (0xAC00, "Hang"), (0xF900, "Hani"), (0xFB00, "Latn"), (0xFB13, "Armn"), (0xFB1D, "Hebr"), (0xFB50, "Arab"), (0xFF00, "Latn"), (0x10000, "Zyyy"))
_STARTS = [a for a, _ in RANGES]


def script(word: str) -> str:
    return RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' 1- to 4-grams, a space before and after each word counted
    as its bounds, and for each the index of its word (not sorted)."""
    s = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = s == 32
    word = np.cumsum(space) - 1
    buckets, of = [], []
    h = np.zeros(len(s), np.uint32)
    ok = ~space
    for n in range(1, 5):
        if n > len(s):
            break
        m = len(s) - n + 1
        h = h[:m] * np.uint32(0x01000193) + (s[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n == 2:
            ok = np.ones(m, bool)
        elif n > 2:
            ok = ok[:m] & ~space[n - 2 : n - 2 + m]  # the one before last lies inside
        at = np.nonzero(ok[:m])[0]
        mixed = h[at] ^ (h[at] >> np.uint32(15))
        buckets.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        of.append(word[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    key: str  # names this model among those a worker has seen
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs) log shares
    scripts: dict[str, np.ndarray]  # which languages are candidates for a script

    def vectors(self, words: list[str]) -> np.ndarray:
        """Scores of words for each language, (words, langs)."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            g, of = grams(part)
            n = np.bincount(of, minlength=len(part))
            for j in range(len(self.langs)):
                out[k : k + 20_000, j] = np.bincount(of, self.weights[g, j], len(part)) / n
        size = np.sqrt(np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 25))
        kinds = list(map(script, words))
        for kind in set(kinds):
            if kind in self.scripts and not self.scripts[kind].all():
                rows = np.array([x == kind for x in kinds])
                out[np.ix_(rows, ~self.scripts[kind])] = -np.inf
        return out * size[:, None].astype(np.float32)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def sample(docs: DataFrame, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text, lang): the bounded labelled sample.  Ids are chosen first, then
    the texts of that bounded list are read."""
    shipped(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0) & ~held_out("doc_id"))
    # a language may hold most rows, so each is dealt by hash in PARTS and each part gives its share
    order = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    dealt = known.select("doc_id", "lang").withColumn("part", F.pmod(F.crc32(F.concat_ws(":", "doc_id", F.lit("part"))), F.lit(PARTS)))
    ids = dealt.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(1, per_lang // PARTS))
    ids = ids.orderBy("n", "lang").limit(max_docs).select("doc_id", F.col("lang").alias("of"))
    return known.join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("of")).select("doc_id", "text", "lang")


def train(docs: DataFrame, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS) -> Model:
    """Counts on the executors; what reaches the driver is at most BUCKETS rows and the
    scripts for each language."""

    def count(frames):
        for pdf in frames:
            out = []
            for lang, part in pdf.groupby("lang"):
                n = np.zeros(BUCKETS, np.int64)
                words: dict[str, int] = {}
                for text in part["text"]:
                    for w in words_of(text):
                        words[w] = words.get(w, 0) + 1
                distinct = list(words)
                times = np.fromiter(words.values(), np.int64, len(words))
                for k in range(0, len(distinct), 20_000):
                    g, of = grams(distinct[k : k + 20_000])
                    n += np.bincount(g, times[k : k + 20_000][of], BUCKETS).astype(np.int64)
                letters: dict[str, int] = {}
                for w, k in words.items():
                    letters[script(w)] = letters.get(script(w), 0) + k * len(w)
                at = np.nonzero(n)[0]
                out.append(pd.DataFrame({"lang": lang, "bucket": at, "n": n[at], "script": None}))
                out.append(pd.DataFrame({"lang": lang, "bucket": -1, "n": letters.values(), "script": letters.keys()}))
            if out:
                yield pd.concat(out)

    counts = sample(docs, per_lang, max_docs).select("text", "lang").mapInPandas(count, "lang string, bucket long, n long, script string")
    rows = counts.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n"))
    labels = [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(labels) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages in column lang")
    rows, langs = rows.toPandas(), sorted(labels)
    col = {x: i for i, x in enumerate(langs)}
    n = np.zeros((BUCKETS, len(langs)))
    marks = rows["bucket"] < 0
    body = rows[~marks]
    n[body["bucket"].to_numpy(int), body["lang"].map(col).to_numpy(int)] = body["n"]
    letters: dict[str, np.ndarray] = {}
    for _, r in rows[marks].iterrows():
        letters.setdefault(r["script"], np.zeros(len(langs)))[col[r["lang"]]] = r["n"]
    share = (n + 0.5) / (n.sum(0) + 0.5 * BUCKETS) if langs else n
    return Model(uuid.uuid4().hex, langs, np.log(share).astype(np.float32) if langs else n, candidates(letters))


def candidates(letters: dict[str, np.ndarray], least: float = SHARE) -> dict[str, np.ndarray]:
    """Of each script which languages its words may be of; letters: how many of each language's
    letters are of the script."""
    total = np.maximum(sum(letters.values(), 0), 1)
    enough = {s: x / total >= least for s, x in letters.items()}
    return {s: x if x.any() else letters[s] > 0 for s, x in enough.items()}


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of scores; row ranges [start, start+length) are documents.
    One step handles the t-th words of all documents that have one."""
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    s, n = starts[order], lengths[order]
    stay = np.empty(scores.shape, bool)  # the best path to (row, label) had this label before
    before = np.zeros(len(scores), np.int16)  # else this one
    best = scores[s].astype(np.float64)
    last = np.zeros(len(s), np.int16)
    active = len(s)
    for t in range(1, int(n[0]) + 1):
        now = int(np.searchsorted(-n, -t, side="left"))  # documents with more than t words
        if now < active:
            last[now:active] = best[now:active].argmax(1)
            active = now
            best = best[:active]
            if not active:
                break
        rows = s[:active] + t
        top = best.argmax(1)
        jump = best[np.arange(active), top] - penalty
        keep = best >= jump[:, None]
        stay[rows] = keep
        before[rows] = top
        best = np.where(keep, best, jump[:, None]) + scores[rows]
    at, state = s + n - 1, last
    labels[at] = state
    for t in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -t, side="left"))
        rows = at[:live] - t + 1
        cur = state[:live]
        state = np.where(stay[rows, cur], cur, before[rows])
        labels[rows - 1] = state
    return labels


class Scores:
    """Word scores that a worker remembers, up to CACHE words; then it starts anew."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def of(self, docs: list[list[str]]) -> np.ndarray:
        new = set(chain.from_iterable(docs)).difference(self.known)
        if len(self.table) + len(new) > CACHE and self.known:
            self.known, self.table = {}, self.table[:0]
            new = set(chain.from_iterable(docs))
        fresh = sorted(new)
        self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
        if fresh:
            self.table = np.concatenate([self.table, self.model.vectors(fresh)])
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64)
        for word in fresh:
            if len(word) > LONGEST:
                del self.known[word]
        return self.table[ids]


_LATEST: list[Scores] = []


def scores_of(model: Model) -> Scores:
    """This worker's Scores of the model; those of an earlier model are let go."""
    if not _LATEST or _LATEST[0].model.key != model.key:
        _LATEST[:] = [Scores(model)]
    return _LATEST[0]


def _judged(texts: list, model: Model, penalty: float) -> dict[str, list]:
    """Documents are read TOKENIZED at a time, and labelled together until HELD scores are
    held: a Viterbi step costs the same for one document as for thousands."""
    out: dict[str, list] = {"lang_pred": [], "score": [], "n_spans": [], "spans": []}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for k in range(0, len(texts), TOKENIZED):
        words = [words_of(t) if model.langs else [] for t in texts[k : k + TOKENIZED]]
        scores = scores_of(model).of(words)
        held.append((scores, np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, chain.from_iterable(words)), np.int32, len(scores))))
        size += scores.size
        if size > HELD:
            _labelled(held, model, penalty, out)
            held, size = [], 0
    if held:
        _labelled(held, model, penalty, out)
    return out


def _labelled(held: list, model: Model, penalty: float, out: dict[str, list]) -> None:
    scores, lengths, letters = (np.concatenate(x) for x in zip(*held))
    starts = np.cumsum(lengths) - lengths
    labels = viterbi(scores, starts, lengths, penalty)
    for a, n in zip(starts.tolist(), lengths.tolist()):
        if not n:
            row = (UND, 0.0, 0, "[]")
        else:
            own = labels[a : a + n]
            by = np.bincount(own, letters[a : a + n], len(model.langs))
            top = int(by.argmax())
            cuts = [0, *(np.nonzero(own[1:] != own[:-1])[0] + 1).tolist(), n]
            row = (model.langs[top], float(by[top] / by.sum()), len(cuts) - 1, json.dumps([[model.langs[own[i]], j - i] for i, j in zip(cuts, cuts[1:])]))
        for c, v in zip(out.values(), row):
            c.append(v)


def language_id(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters in spans of lang_pred),
    n_spans and spans: JSON list of [language, words] runs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids} | _judged(texts, shared.value, penalty)

    out = by_document(docs, run, "doc_id long, lang_pred string, score double, n_spans long, spans string", rows=10_000)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans", "spans")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and of whose letters the
    predicted language has at least that share."""
    shipped(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        got = _judged(list(texts), shared.value, penalty)
        return pd.Series([p != UND and s >= least for p, s in zip(got["lang_pred"], got["score"])], dtype=bool)

    return docs.where(ok(F.col("text")))
