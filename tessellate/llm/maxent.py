"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are counted over all training documents.  The most frequent ones, about WORDS, are dealt
into CLASSES classes by k-means over the kinds of documents they stand in; all other tokens,
unseen ones included, form one class more.  A token's probability is P(class | context) *
P(token | class).  The first factor is a softmax over weights of the context's features: the last
word (hashed), the last class and the last two, and skips to the class two and three places back.
The second factor has no context, so its best weights are known: the token's share of its class,
and in the class of other tokens (count + 1) / (all + distinct + 1), which leaves unseen tokens
the share of one, as the base score does.

Training: the documents are dealt by hash into ROUNDS parts, so all are read once.  In a round
each task sums over its documents what each feature and class should have (observed) and what
the weights give (expected).  Their difference is the gradient; the step is scaled for each
weight, log((observed + PRIOR) / (expected + PRIOR)) / features, which is iterative scaling.
The sums are added up FAN at a time, in order of task, so results do not depend on timing.

Scale: what is sent to the workers and the driver is WORDS tokens and a table of fixed size;
counts of all other tokens stay in a table and meet the documents in a join, in which no token
holds more of the rows than the least of the WORDS frequent ones.  Documents are scored in
batches of about PIECE bytes.

Defined cases: a null or empty text is the end alone; a null doc_id is learned from and not
held out; repeated rows are documents of their own; without any training token both scores are
0; an empty table gives an empty one; other columns are ignored; whole texts are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored, total_bytes

WORDS, CLASSES, KINDS = 1 << 16, 47, 8
HASHED = 1 << 13  # rows of weights that word features share
ROUNDS, PRIOR = 4, 4.0
PIECE = 1 << 18  # bytes of text that are read at once
TASK = 1 << 25  # bytes of text of a training task, at least
BATCH = 1 << 13  # tokens of a softmax
SHARDS, FAN = 8, 32
END = b"\n"  # no word has a line feed
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """The rows of a batch (doc_id, text, ...) in pieces of about PIECE bytes, with their tokens
    and the number of each one's tokens."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + PIECE)))
        part = batch.slice(at, end - at)
        flat: list[bytes] = []
        ends = []
        for text in part.column(1).to_pylist():
            flat += tokens_of(text)
            ends.append(len(flat))
        yield part, flat, np.diff(ends, prepend=0)
        at = end


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n, k0 ...): how often, and in documents of which kind, by the hashes of their tokens."""
    for batch in batches:
        for _, flat, n in pieces_of(batch):
            known = dict.fromkeys(flat)
            words = list(known)
            known.update(zip(words, range(len(words))))
            ids = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat))
            doc = np.repeat(np.arange(len(n)), n)
            kind = ((hashes(words) >> np.uint32(8)) % np.uint32(KINDS)).astype(np.int64)
            of_docs = np.bincount(doc * KINDS + kind[ids], minlength=len(n) * KINDS).reshape(-1, KINDS)
            share = of_docs * 1000 // n[:, None]  # whole numbers add up alike in any order
            kinds = [np.bincount(ids, share[:, k][doc], len(words)).astype(np.int64) for k in range(KINDS)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(ids, minlength=len(words)).astype(np.int64)), *map(pa.array, kinds)], names=["token", "n", *(f"k{k}" for k in range(KINDS))])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n, k0 ...) over all of docs."""
    names = ["n", *(f"k{k}" for k in range(KINDS))]
    each = id_text(docs).mapInArrow(_counted, "token binary, " + ", ".join(f"{c} long" for c in names))
    return each.groupBy("token").agg(*(F.sum(c).alias(c) for c in names))


def clustered(points: np.ndarray, weights: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The cluster of each point by weighted k-means, from centres far from each other."""
    if not len(points):
        return np.zeros(0, np.int64)
    centres = points[[int(weights.argmax())]]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k and (far * weights).max() > 1e-12:
        centres = np.vstack([centres, points[int((far * weights).argmax())]])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    of = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        of = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        total = np.bincount(of, weights, len(centres))
        moved = np.stack([np.bincount(of, weights * points[:, j], len(centres)) for j in range(points.shape[1])], 1)
        centres = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-12)[:, None], centres)
    return of


N_OUT = CLASSES + 1
# Rows of weights: the last two classes, the last but two, the last word
PAIRS, SKIP, WORD = 0, N_OUT * N_OUT, N_OUT * N_OUT + N_OUT
ROWS = WORD + HASHED
ACTIVE = 5  # features of a token; those of one class are sums of pairs'


@dataclass
class Model:
    words: dict[bytes, int]  # the frequent tokens
    of: np.ndarray  # their classes; last, that of all others
    codes: np.ndarray  # hashes
    logs: np.ndarray  # log10(count + 1); last, 0 for others
    share: np.ndarray  # log10 of a token's share of its class; last, 0
    bias: np.ndarray
    weights: np.ndarray  # (ROWS, N_OUT)
    ones: np.ndarray  # (N_OUT, N_OUT) of the last class
    twos: np.ndarray  # of the last but one
    n: int  # training tokens
    distinct: int
    rest: int  # tokens of the last class, and distinct ones
    distinct_rest: int

    def rows(self, flat: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of some documents with n each: the frequent word (else -1), its class,
        and the weights' rows of its context.  Before a document stand ends."""
        word = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        own = self.of[word]
        code = self.codes[word]
        other = np.nonzero(word < 0)[0]
        code[other] = hashes([flat[i] for i in other.tolist()])
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        end = self.words.get(END, -1)

        def back(values: np.ndarray, k: int, first: int) -> np.ndarray:
            out = np.full(len(values), first, values.dtype)
            out[k:] = np.where(place[k:] < k, first, values[:-k])
            return out

        one, two, three = (back(own, k, self.of[end]) for k in (1, 2, 3))
        last = back(code, 1, self.codes[end])
        last = ((last ^ (last >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASHED.bit_length() + 1)
        return word, own, np.stack([one * N_OUT + two, SKIP + three, WORD + last.astype(np.int64)])

    def table(self) -> np.ndarray:
        """The weights, those of single classes added to their pairs', and the bias."""
        out = self.weights.copy()
        out[:SKIP] += (self.ones[:, None] + self.twos[None] + self.bias).reshape(SKIP, N_OUT)
        return out


def softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(class | context), (tokens, N_OUT)."""
    out = table.take(rows[0], axis=0)
    for r in rows[1:]:
        out += table.take(r, axis=0)
    np.clip(out, -60, 60, out=out)
    np.exp(out, out=out)
    out *= (1 / (out @ np.ones(N_OUT, np.float32)))[:, None]
    return out


def frequent(counts: DataFrame) -> DataFrame:
    """The end and the most frequent tokens, about WORDS at most: all whose count is above a bound
    that a histogram of counts (2^6 bins to a doubling) gives, and of the bin below it a share by
    hash, so no task sorts them."""
    size, end = F.floor(F.log2("n") * 64).cast("int"), F.col("token") == F.lit(END)
    bins = sorted(map(tuple, counts.where(~end).groupBy(size).agg(F.count("*")).collect()), reverse=True)
    held, least, share = 0, 0, 1.0
    for least, k in bins:
        share = min(1.0, (WORDS - held) / k)
        if share < 1:
            break
        held += k
    some = F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20))
    return counts.where(end | (size > least) | ((size == least) & some)).orderBy("token")


def start(counts: DataFrame) -> Model:
    """A model with counts but no weights yet."""
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = frequent(counts).collect()  # about WORDS at most
    table = np.array([r[1:] for r in rows], np.float64).reshape(-1, KINDS + 1)
    points = np.sqrt(table[:, 1:] / np.maximum(table[:, 1:].sum(1, keepdims=True), 1))
    of = clustered(points, table[:, 0], CLASSES)
    sizes = np.bincount(of, table[:, 0], N_OUT)
    rest = n - int(table[:, 0].sum())
    sizes[CLASSES] = rest
    share = np.log10(table[:, 0] / sizes[of]) if len(rows) else table[:, 0]
    words = {bytes(r[0]): i for i, r in enumerate(rows)}
    bias = np.log((sizes + 1) / (n + N_OUT)).astype(np.float32)
    zeros = lambda rows: np.zeros((rows, N_OUT), np.float32)
    return Model(words, np.append(of, CLASSES), np.append(hashes(list(words)), np.uint32(0)), np.append(np.log10(table[:, 0] + 1), 0), np.append(share, 0), bias, zeros(ROWS), zeros(N_OUT), zeros(N_OUT), n, distinct, rest, distinct - len(rows))


def _expected(table: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    """Adds the probabilities of a batch to the rows of its features."""
    p = softmax(table, rows)
    for r in rows:
        r = r.astype(np.uint16)  # sorted by digits
        order = np.argsort(r, kind="stable")
        own = r[order]
        at = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
        into[own[at]] += np.add.reduceat(p.take(order, axis=0), at, axis=0)


def _sums(shared):
    """(task, shard, sums) over a task's documents: observed and expected counts of each weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, task = shared.value, TaskContext.get().partitionId()
        table = model.table()
        observed, expected = np.zeros(ROWS * N_OUT), np.zeros((ROWS, N_OUT), np.float32)
        seen = 0
        for batch in batches:
            for _, flat, n in pieces_of(batch):
                _, own, rows = model.rows(flat, n)
                seen += len(own)
                for r in rows:
                    np.add.at(observed, r * N_OUT + own, 1.0)
                for k in range(0, len(own), BATCH):
                    _expected(table, rows[:, k : k + BATCH], expected)
        if seen:
            both = np.stack([observed.reshape(ROWS, N_OUT).astype(np.float32), expected], 1)
            for shard, x in enumerate(np.array_split(both, SHARDS)):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([shard], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["task", "shard", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The rows of one shard as one, added in order of task."""
    rows = sorted(zip(table.column("task").to_pylist(), table.column("sums")), key=lambda x: x[0])
    total = np.frombuffer(rows[0][1].as_buffer(), np.float32).copy()
    for _, x in rows[1:]:
        total += np.frombuffer(x.as_buffer(), np.float32)
    return pa.table({"task": pa.array([rows[0][0] // FAN], pa.int64()), "shard": table.column("shard").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def step(docs: DataFrame, model: Model, tasks: int) -> Model:
    """The model after one update from docs, read by that many tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "task long, shard long, sums binary"
    sums = id_text(docs).coalesce(tasks).mapInArrow(_sums(shared), schema)
    while tasks > 1:
        sums = sums.groupBy("shard", F.floor(F.col("task") / FAN).alias("_group")).applyInArrow(_added, schema)
        tasks = -(-tasks // FAN)
    found = sorted(((r["shard"], r["sums"]) for r in sums.collect()), key=lambda x: x[0])  # of fixed size
    shared.unpersist()
    if not found:
        return model
    both = np.frombuffer(b"".join(bytes(x) for _, x in found), np.float32).reshape(ROWS, 2, N_OUT)
    scaled = lambda sums: np.log((sums[:, 0] + PRIOR) / (sums[:, 1] + PRIOR)) / ACTIVE
    pairs = both[:SKIP].reshape(N_OUT, N_OUT, 2, N_OUT)
    return replace(model, weights=model.weights + scaled(both), ones=model.ones + scaled(pairs.sum(1)), twos=model.twos + scaled(pairs.sum(0)))


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the documents that are not held out, and the table of their token counts."""
    own = docs.where(~held_out())
    counts = stored(token_counts(own), "counts")
    model = start(counts)
    if model.n:
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total_bytes(id_text(docs)) // TASK)
        part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(rounds))
        for r in range(rounds):
            model = step(own.where(part == r), model, tasks)
    return model, counts


def _scored(shared):
    """What a document's frequent tokens and classes give, and its other tokens with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for batch in batches:
            for part, flat, n in pieces_of(batch):
                word, own, rows = m.rows(flat, n)
                logs = np.empty(len(own))
                for k in range(0, len(own), BATCH):
                    some = own[k : k + BATCH]
                    logs[k : k + BATCH] = np.log10(softmax(table, rows[:, k : k + BATCH])[np.arange(len(some)), some])
                logs += m.share[word]
                doc = np.repeat(np.arange(len(n)), n)
                other = np.nonzero(word < 0)[0]
                found = Counter(zip(doc[other].tolist(), map(flat.__getitem__, other.tolist())))  # in order of document
                sizes = np.bincount(np.fromiter((d for d, _ in found), np.int64, len(found)), minlength=len(n))
                flat_rare = pa.StructArray.from_arrays([pa.array([w for _, w in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "times"])
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), flat_rare)
                sums = lambda x: pa.array(np.bincount(doc, x, len(n)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(0), pa.array(n.astype(np.int64)), pa.array(np.bincount(doc[other], minlength=len(n)).astype(np.int64)), sums(m.logs[word]), sums(logs), rare],
                    names=["row", "doc_id", "n_tokens", "n_rare", "base", "model", "rare"],
                )

    return run


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    each = stored(rows.mapInArrow(_scored(shared), "row long, doc_id long, n_tokens long, n_rare long, base double, model double, rare array<struct<token: binary, times: long>>"), "scored")
    met = each.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.times").join(counts.select("token", "n"), "token")
    found = met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    both = each.drop("rare").join(found, "row", "left")
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    base = F.col("base") + logs - F.col("n_tokens") * float(np.log10(model.n + model.distinct + 1))
    own = F.col("model") + logs - F.col("n_rare") * float(np.log10(model.rest + model.distinct_rest + 1))
    if not model.n:
        base = own = F.lit(0.0)
    return both.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_tokens") - F.col("n_rare") + known).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"))


def lm_scores(docs: DataFrame) -> DataFrame:
    model, counts = train(docs)
    return scored(docs, model, counts)
