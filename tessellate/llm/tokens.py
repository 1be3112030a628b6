"""Token counts with a whole-token shortcut.

Offline, each string of the vocabulary is encoded by itself, by the same merges: those
that come out as one token are proven.  A pre-token among them counts 1 without any
merging; only the rest is merged, once for each distinct string a worker sees.

The counts equal the tokenizers library's for a byte-level BPE file: the split pattern
of such files, its added tokens cut out of a text first (its default), no begin or end
tokens, no truncation or padding.

Defined cases: null and empty texts have 0 tokens; runs of any length are merged with a
heap, in n log n time, and not remembered if they are long; null ids pass through; repeated
rows are each counted; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import Remembered, by_document

# The split pattern of byte-level BPE files, with white space as Unicode defines it.
_S = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SHORT, _NONE = 64, 1 << 62
CACHE = 1 << 18  # pre-tokens that a worker remembers, and as many older ones


def byte_marks() -> dict[int, str]:
    """The printable stand-in of each byte in such vocabularies, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _merge_short(raw: bytes, rank) -> int:
    """The same for few bytes, with a list of the ranks of neighbours instead of a heap."""
    part = [raw[i : i + 1] for i in range(len(raw))]
    near = [rank(pair, _NONE) for pair in zip(part, part[1:])]
    while near and (least := min(near)) < _NONE:
        i = near.index(least)
        part[i : i + 2] = [part[i] + part[i + 1]]
        del near[i]
        if i:
            near[i - 1] = rank((part[i - 1], part[i]), _NONE)
        if i < len(near):
            near[i] = rank((part[i], part[i + 1]), _NONE)
    return len(part)


def merge_count(raw: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many tokens the merges leave of raw: lowest rank first, then leftmost."""
    n = len(raw)
    if n <= SHORT:
        return _merge_short(raw, ranks.get)
    part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] is not None else n
        if j >= n or part[i] != a or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get((part[x], part[y]))) is not None:
                heapq.heappush(heap, (r, x, part[x], part[y]))
    return left


class Counter:
    """Built once in each worker from the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark = {m: b for b, m in byte_marks().items()}
        raw = lambda s: bytes(mark[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(SPLIT)
        self.proven: set[str] = set()
        for piece in spec["model"]["vocab"]:
            if all(c in mark for c in piece) and merge_count(b := raw(piece), self.ranks) == 1:
                try:
                    self.proven.add(b.decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        self.known = Remembered(CACHE)  # proven strings enter it when met

    def piece(self, text: str) -> int:
        n = 1 if text in self.proven else self.known.older(text)
        if n is None:
            n = merge_count(text.encode("utf-8"), self.ranks)
        self.known.put(text, n)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        for part in parts:
            words = self.split.findall(part)
            counts = list(map(self.known.get, words))
            if None in counts:
                counts = [self.piece(w) if n is None else n for w, n in zip(words, counts)]
            total += sum(counts)
        return total


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  path: a byte-level BPE .json file that
    every executor has under this path."""

    def run(ids: list, texts: list) -> dict:
        c = counter(path)
        counts = [c.count(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [len((t or "").encode("utf-8")) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return by_document(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
