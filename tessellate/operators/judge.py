"""Support judges: whether cited evidence supports a claim.

A judge turns an array of (claim, evidence texts) into an array of booleans.  Features of a
claim and of each evidence sentence are computed once in a row, in a first pass over the arrays,
and compared in a second; all of it stays within the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Units that a claim may not add.  Tokens are stemmed, so the last one never
# occurs among them; it is kept because results must agree.
UNITS = ("day", "hour", "month", "year", "gb", "tb", "minute")
THRESHOLD = 0.8


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


@dataclass(frozen=True)
class Judge:
    name: str
    version: str
    supported: Callable[[Column, float], Column]
    threshold: float = THRESHOLD

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("the support threshold must be between 0 and 1")

    def __call__(self, pairs: Column) -> Column:
        """pairs: array<struct<claim, evidence array<string>>>."""
        return self.supported(pairs, self.threshold)

    def judged(self, rows: DataFrame, pairs: str, out: str) -> DataFrame:
        """rows with `out`, a verdict for each of the array `pairs`."""
        return rows.withColumn(out, self(F.col(pairs)))


@dataclass(frozen=True)
class Asked:
    """A judge that a service is: verdicts come from a table of distinct pairs."""

    name: str
    model: str
    ask: Callable[[DataFrame], DataFrame]  # (claim, evidence) -> the same with supported
    version: str = "2.0"
    threshold: None = None

    def judged(self, rows: DataFrame, pairs: str, out: str) -> DataFrame:
        """As Judge.judged(), of rows (case_id, stage, ...)."""
        each = rows.select("case_id", "stage", F.posexplode(pairs).alias("pos", "pair")).select("case_id", "stage", "pos", "pair.claim", "pair.evidence")
        said = self.ask(each.select("claim", "evidence").distinct())
        lists = each.join(said, ["claim", "evidence"]).groupBy("case_id", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "supported"))), lambda x: x["supported"]).alias(out))
        return rows.join(lists, ["case_id", "stage"], "left").withColumn(out, F.coalesce(out, F.array().cast("array<boolean>")))


def _lexical(pairs: Column, threshold: float) -> Column:
    """Share of the claim's tokens among those of all evidence; true of an empty claim."""
    seen = F.transform(pairs, lambda p: F.struct(F.array_distinct(T.content_tokens(p["claim"])).alias("t"), F.array_distinct(F.flatten(F.transform(p["evidence"], T.content_tokens))).alias("e")))
    return F.transform(seen, lambda x: (F.size(x["t"]) == 0) | (T.coverage(x["t"], x["e"]) >= threshold))


def _features(text: Column) -> list[Column]:
    return [T.claim_tokens(text).alias("t"), T.subjects(text).alias("s"), T.denies(text).alias("neg"), T.numbers(text).alias("num")]


def _sentence_fits(c: Column, e: Column, threshold: float) -> Column:
    """c, e: features of the claim and of one sentence."""
    guards = _within(c["s"], e["s"]) & (c["neg"] == e["neg"]) & _within(F.array_intersect(c["t"], T.strings(UNITS)), e["t"]) & _within(c["num"], e["num"])
    return guards & (T.coverage(c["t"], e["t"]) >= threshold)


def _faced(pairs: Column, claim: Callable[[Column], Column], evidence: Callable[[Column], Column], fits: Callable[[Column, Column], Column]) -> Column:
    """fits() of what claim() makes of each claim and evidence() of its evidence.  What is made of
    evidence is made once for all claims of the row that have the same."""
    lists = F.array_distinct(F.transform(pairs, lambda p: p["evidence"]))
    known = F.transform(lists, lambda x: F.struct(x.alias("evidence"), evidence(x).alias("e")))
    both = lambda k: F.transform(pairs, lambda p: F.struct(claim(p["claim"]).alias("c"), F.get(F.filter(k, lambda x: x["evidence"] == p["evidence"]), F.lit(0))["e"].alias("e")))
    faced = F.get(F.transform(F.array(known), both), F.lit(0))
    return F.transform(faced, lambda x: fits(x["c"], x["e"]))


def _conservative(pairs: Column, threshold: float) -> Column:
    """One evidence sentence must hold subjects, polarity, units, numbers and enough tokens."""
    known = lambda texts: F.transform(F.flatten(F.transform(texts, T.sentences)), lambda s: F.struct(*_features(s)))
    return _faced(pairs, lambda c: F.struct(*_features(c)), known, lambda c, es: (F.size(c["t"]) > 0) & F.exists(es, lambda e: _sentence_fits(c, e, threshold)))


def _keeps_bounds(c: Column, e: Column) -> Column:
    """Quantities of the sentence that the claim names too are exact or bounded alike."""
    same = lambda x, y: (x["number"] == y["number"]) & (x["unit"] == y["unit"])
    return F.forall(e["b"], lambda y: (y["kind"] == "exact") | F.forall(c["b"], lambda x: ~same(x, y) | (x["kind"] == y["kind"])))


def _structured(pairs: Column, threshold: float) -> Column:
    """As conservative, with company names resolved, bounds kept, and lists read."""
    full = lambda x: F.struct(x.alias("text"), *_features(x), T.bounds(x).alias("b"))
    claim = lambda c: F.get(F.transform(F.array(T.canonical_claim(c)), full), F.lit(0))
    known = lambda texts: F.transform(F.flatten(F.transform(texts, T.resolved_sentences)), full)
    fits = lambda c, e: T.is_member(c["text"], e["text"]) | ((F.size(c["t"]) > 0) & _sentence_fits(c, e, threshold))
    return _faced(pairs, claim, known, lambda c, es: F.exists(es, lambda e: _keeps_bounds(c, e) & fits(c, e)))


JUDGES = {"lexical": Judge("lexical", "2.0", _lexical), "conservative": Judge("conservative", "2.0", _conservative), "structured": Judge("structured", "3.0", _structured)}
