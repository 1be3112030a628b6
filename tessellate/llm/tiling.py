"""Benchmark decontamination by greedy string tiling.

Documents and test items become word lists (A-Z lower-cased, ASCII punctuation dropped).
Seeds are the items' runs of MIN_MATCH words, of an item with fewer words its whole text; a
running Karp-Rabin hash (sums of powers kept along the text, a run's hash the difference of
two of them) joins the documents' runs with them.  Of a row of shared seeds on one diagonal
only the first is listed, as the word before differs there, so texts that repeat a word cost
one entry for each maximal match and not one for each pair of places.  Extended word by word
it is a maximal match; then, again and again, the longest match with no word yet marked in
either text is marked as a tile, and what tiles cut off of other matches comes back while
it is long enough.  An item's coverage is the share of its words in tiles, in whatever
order they appear, so reordered passages count.  A document is contaminated by an item at
THRESHOLD or more.

The items are broadcast in blocks of at most BLOCK_BYTES of text each, one block after the
other: driver and executors hold one at a time, the documents are scanned once for each, and
nothing is shuffled.  A worker's index of a full block takes some 20 times its text at most.

Defined cases: null and empty texts match nothing, and items without words are in no
document; items of fewer than MIN_MATCH words match where they stand whole; repeated items
and ids are each reported; rows with a null doc_id or item_id are judged too and keep the
null; ties between matches go to the earlier place in the document, then in the item; other
columns are ignored; an empty table gives an empty table; texts are searched whole.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_document, shipped, stored
from .licenses import words_of

MIN_MATCH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BITS = 20
_AT_START, _NO_WORD = np.uint64(1), np.uint64(2)  # what stands before the first word of a document, of an item
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, x in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x)]), dtype=np.uint64)
    return _POWERS


def coded(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word, the same within a process."""
    x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (x ^ (x >> np.uint64(32))) * _BASE


def running(codes: np.ndarray) -> np.ndarray:
    """Sums of codes over powers of the base up to each place."""
    inverse = _powers(len(codes) + 1)[1]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * inverse[: len(codes)], dtype=np.uint64)])


def rolled(sums: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all runs of width words."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return (sums[width:] - sums[:n]) * _powers(n + width)[0][width - 1 : n + width - 1]


class Seeds:
    """The runs of `width` words of some items, in order of their hash and the word before."""

    def __init__(self, width: int, items: list[tuple[int, list[bytes]]]):
        self.width = width
        hashes, before, item, place = [], [], [], []
        for k, words in items:
            codes = coded(words)
            h = rolled(running(codes), width)
            hashes.append(h)
            before.append(np.concatenate([[_NO_WORD], codes[: len(h) - 1]]).astype(np.uint64))
            item.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        join = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t)
        h, before = join(hashes, np.uint64), join(before, np.uint64)
        order = np.lexsort((before, h))
        h, before = h[order], before[order]
        self.item, self.place = join(item, np.int32)[order], join(place, np.int32)[order]
        del hashes, item, place
        self.hashes, first = np.unique(h, return_index=True)
        self.bounds = np.append(first, len(h))
        both = h ^ (before * _BASE)
        cut = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
        order = np.argsort(both[cut])
        self.after, self.low, self.high = both[cut][order], cut[order].astype(np.int32), np.append(cut[1:], len(h))[order].astype(np.int32)
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.hashes >> np.uint64(64 - _BITS)] = True

    def starts(self, codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the document, place in the item) where a shared row of seeds begins."""
        h = rolled(sums, self.width)
        p = np.nonzero(self.map[h >> np.uint64(64 - _BITS)])[0] if len(self.hashes) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h[p]), max(len(self.hashes) - 1, 0))
        if len(p):
            same = self.hashes[k] == h[p]
            p, k = p[same], k[same]
        if not len(p):
            return p, p, p
        before = np.where(p > 0, codes[p - 1], _AT_START)
        both = h[p] ^ (before * _BASE)
        x = np.minimum(np.searchsorted(self.after, both), len(self.after) - 1)
        known = self.after[x] == both  # those that the word before extends to the left
        low, high = self.bounds[k], self.bounds[k + 1]
        skip, to = np.where(known, self.low[x], high), np.where(known, self.high[x], high)
        begins, sizes = np.concatenate([low, to]), np.concatenate([skip - low, high - to])
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        return self.item[at], np.repeat(np.concatenate([p, p]), sizes), self.place[at]


class Suite:
    """The test items, indexed by their seeds; an item with fewer than `width` words is one seed."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = MIN_MATCH):
        self.ids = [i for i, _ in items]
        known: dict[bytes, bytes] = {}
        self.words = [[known.setdefault(w, w) for w in words_of(t)] for _, t in items]  # equal words once
        self.widths = [min(width, len(w)) for w in self.words]
        self.seeds = [Seeds(n, [(k, w) for k, w in enumerate(self.words) if self.widths[k] == n]) for n in sorted(set(self.widths) - {0})]

    def hits(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For each item, (place in the document, place in the item) where a match begins."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not words:
            return out
        codes = coded(words)
        sums = running(codes)
        for seeds in self.seeds:
            for item, p, q in zip(*(x.tolist() for x in seeds.starts(codes, sums))):
                out.setdefault(item, []).append((p, q))
        return out


def matches(doc: list[bytes], item: list[bytes], seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in doc, place in item) that begin at the seeds."""
    out = []
    for p, q in sorted(seeds):
        n, most = 0, min(len(doc) - p, len(item) - q)
        while n < most and doc[p + n] == item[q + n]:
            n += 1
        if n >= width:
            out.append((n, p, q))
    return out


def most_covered(item: list[bytes], found: list[tuple[int, int, int]]) -> int:
    """How many of an item's words lie in any match: no tiling covers more."""
    held, end = 0, 0
    for q, n in sorted((q, n) for n, _, q in found):
        held += max(0, q + n - max(q, end))
        end = max(end, q + n)
    return held


def tiles(item: list[bytes], found: list[tuple[int, int, int]], width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of matches: (length, place in doc, place in item), longest first."""
    heap = [(-n, p, q) for n, p, q in found]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item = bytearray(len(item))
    out, free = [], len(item)
    while heap and free >= width:
        n, p, q = heapq.heappop(heap)
        n = -n
        ok = [not in_item[q + i] and p + i not in in_doc for i in range(n)]
        if all(ok):
            out.append((n, p, q))
            in_doc.update(range(p, p + n))
            in_item[q : q + n] = b"\1" * n
            free -= n
            continue
        i = 0
        while i < n:  # what is left of it
            j = i
            while j < n and ok[j]:
                j += 1
            if j - i >= width:
                heapq.heappush(heap, (i - j, p + i, q + i))
            i = max(j, i) + 1
    return out


def judge(text: str | None, suite: Suite, threshold: float = THRESHOLD) -> list[dict]:
    doc = words_of(text)
    out = []
    for k, seeds in suite.hits(doc).items():
        item, width = suite.words[k], suite.widths[k]
        found = matches(doc, item, seeds, width)
        if most_covered(item, found) / len(item) < threshold:
            continue
        got = tiles(item, found, width)
        covered = sum(n for n, _, _ in got) / len(item)
        if covered >= threshold:
            out.append({"item": k, "item_id": suite.ids[k], "coverage": covered, "tiles": [{"doc_word": p, "item_word": q, "n_words": n} for n, p, q in got]})
    return sorted(out, key=lambda x: x["item"])


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items, in lists of at most block_bytes of text (or one longer item)."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((r["text"] or "").encode("utf-8"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


_LATEST: list = [None, None]


def _suite(shared, width: int) -> Suite:
    """This worker's index of the latest block."""
    if _LATEST[0] is not shared.value:
        _LATEST[:] = [shared.value, Suite(shared.value, width)]
    return _LATEST[1]


def _each_block(docs: DataFrame, benchmark: DataFrame, block_bytes: int, scan) -> None:
    """scan(shared block, whether it is the only one) for each block.  Of several, one is scanned
    and let go before the next is sent."""
    blocks = blocks_of(benchmark, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    only = following is None
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        scan(shared, only)
        if not only:
            shared.unpersist()
        block, following = following, next(blocks, None)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, coverage,
    n_tiles, tiles (word places, longest first)."""
    kind = "array<struct<item:long,item_id:long,coverage:double,tiles:array<struct<doc_word:long,item_word:long,n_words:long>>>>"
    parts = []

    def scan(shared, only: bool) -> None:
        def run(ids: list, texts: list) -> dict:
            suite = _suite(shared, width)
            return {"doc_id": ids, "found": [judge(t, suite, threshold) for t in texts]}

        part = by_document(docs, run, f"doc_id long, found {kind}").select("doc_id", F.explode("found").alias("f"))
        part = part.select("doc_id", "f.item_id", "f.coverage", F.size("f.tiles").cast("long").alias("n_tiles"), "f.tiles")
        parts.append(part if only else stored(part, "contaminated"))

    _each_block(docs, benchmark, block_bytes, scan)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates."""
    shipped(docs.sparkSession)
    left = [docs]

    def scan(shared, only: bool) -> None:
        @F.pandas_udf("boolean")
        def ok(texts):
            suite = _suite(shared, width)
            return texts.map(lambda t: not judge(t, suite, threshold)).astype(bool)

        part = left[0].where(ok(F.col("text")))
        left[0] = part if only else stored(part, "clean")

    _each_block(docs, benchmark, block_bytes, scan)
    return left[0]
