"""License scans: fuzzy short-notice search.

A text is lower-cased (A-Z), cut into words and joined by single spaces.  Each notice
phrase with up to k edits is split into k+1 seeds (pigeonhole: at least one seed is
untouched by k edits); where a seed occurs, the regex library's bounded-error matching
verifies a window around it and reports span and edits.  A fuzzy match must hold the
notice's key words unchanged, so that one license is not read as its neighbour.

Base places, where a phrase's words stand consecutively, are the matches with no edit
that lie on word bounds; each exact place holds every seed, so candidates include all.

Defined cases: null and empty texts have no word and no label, score 0; ties between
matches of equal edits go to the earliest; null ids pass through; other columns are
ignored; repeated rows are each searched; an empty table gives an empty table; whole texts of
any length are searched.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property, lru_cache

import regex
from pyspark.sql import DataFrame

from .common import by_document

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    keys: tuple[str, ...]  # words that a fuzzy match must hold
    base: bool = True

    @cached_property
    def spaced(self) -> bytes:
        return f" {self.phrase} ".encode()

    @cached_property
    def seeds(self) -> list[tuple[bytes, int]]:
        raw, parts = self.phrase.encode(), self.edits + 1
        cuts = [len(raw) * i // parts for i in range(parts + 1)]
        return [(raw[a:b], a) for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def pattern(self):
        return regex.compile(rb"(?b)(?<=\x20)(?:%s){e<=%d}(?=\x20)" % (regex.escape(self.phrase.encode()), self.edits))


NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",)),
    Notice("apache license version 2", "apache-2", 3, ("2",)),
    Notice("cc by nc", "cc-by-nc", 0, ()),
    Notice("gnu general public license", "gpl", 3, ("gnu",), False),
    Notice("mozilla public license", "mpl", 2, ("public",), False),
)


@lru_cache(8)
def _first_seeds(notices: tuple[Notice, ...]) -> tuple:
    return tuple((n, n.seeds) for n in notices)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().translate(_SPACED).split()


def scan(text: str | None, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
    """Number of words, and matches (label, first word, end word, edits, base)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    found = []
    for notice, seeds in _first_seeds(notices):
        spots: set[int] = set()
        for seed, offset in seeds:
            at = line.find(seed)
            while at >= 0:
                spots.add(at - offset)
                at = line.find(seed, at + 1)
        if not spots:
            continue
        n, k = len(notice.phrase), notice.edits
        exact = [at for at in sorted(spots) if at > 0 and line.startswith(notice.spaced, at - 1)]
        found += [(at, at + n, notice, 0) for at in exact]
        done = -1  # end of the last fuzzy match
        for at in sorted(spots) if k else ():
            i = bisect_right(exact, at)
            if at < done or (i and at < exact[i - 1] + n):
                continue
            lo, hi = max(0, line.rfind(b" ", 0, max(1, at - k))), min(len(line), at + n + k + 1)
            m = notice.pattern.search(line, lo, hi)
            if not m or m.start() < done or any(m.start() < e + n and e < m.end() for e in exact[max(0, i - 1) : i + 1]):
                continue
            if all(key.encode() in m[0].split() for key in notice.keys):
                done = m.end()
                found.append((m.start(), m.end(), notice, sum(m.fuzzy_counts)))
    found.sort(key=lambda x: (x[0], x[1], x[2].label))
    out, at, word = [], 0, 0
    for s, e, notice, edits in found:
        word += line.count(b" ", at, s)
        at = s
        out.append((notice.label, word - 1, word - 1 + len(line[s:e].split()), edits, notice.base and edits == 0))
    return len(words), out


def license_spans(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, found: array of (label, first, end, edits, base), in words."""

    def run(ids: list, texts: list) -> dict:
        both = [scan(t, notices) for t in texts]
        return {"doc_id": ids, "n_words": [n for n, _ in both], "found": [[dict(zip(("label", "first", "end", "edits", "base"), x)) for x in f] for _, f in both]}

    return by_document(docs, run, "doc_id long, n_words long, found array<struct<label:string,first:long,end:long,edits:int,base:boolean>>")


def license_digests(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    from pyspark.sql import functions as F

    spans = license_spans(docs, notices)
    base = F.filter("found", lambda x: x["base"])
    size = {n.label: len(n.phrase) for n in notices}
    length = F.create_map(*(F.lit(x) for kv in size.items() for x in kv))
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: 1.0 - x["edits"] / F.element_at(length, x["label"]))), F.lit(0.0)).alias("score"),
    )
