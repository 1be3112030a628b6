"""Evidence for claims over a whole corpus: which sentences support a claim, wherever they are.

A sentence supports a claim as the conservative judge says: it holds the claim's subjects, units
and numbers, denies or not as the claim does, and has at least `threshold` of its tokens.  Of n
tokens a sentence then lacks fewer than n - ceil(threshold n) + 1, so it has at least one of any
that many: claims are joined with sentences on that many of their rarest tokens only, and only
the pairs that meet are compared.

Copies count once: sentences are compared by their text, each one once, and given back with all
the documents that hold them.  A claim without tokens has no support.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .judge import THRESHOLD, _features, _sentence_fits


def sentences_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence) of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def featured(texts: DataFrame, text: str, number: str) -> DataFrame:
    """The distinct texts with a number of their own and the struct f of what judges compare."""
    one = texts.select(text).distinct().withColumn(number, F.monotonically_increasing_id())
    return stored(one.select(number, text, F.struct(*_features(F.col(text))).alias("f")), number)


def rarest(claims: DataFrame, sentences: DataFrame, threshold: float) -> DataFrame:
    """(claim_no, token): the tokens of each claim that a supporting sentence can't all lack."""
    each = claims.select("claim_no", F.explode("f.t").alias("token"))
    df = sentences.select(F.explode("f.t").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    known = each.join(df, "token", "left").groupBy("claim_no").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("ts"))
    n = F.size("ts")
    least = F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")  # that a supporting sentence has
    return known.select("claim_no", F.explode(F.slice("ts", F.lit(1), n - least + 1)).alias("x")).where("x.df > 0").select("claim_no", "x.token")


def supporting(docs: DataFrame, claims: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(claim_id, doc_id, pos, coverage) of claims (claim_id, claim) and the sentences of docs
    (doc_id, text) that support them; coverage is the share of the claim's tokens."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    told, found = stored(sentences_of(docs), "sentences"), claims.where("claim IS NOT NULL")
    s, c = featured(told, "sentence", "sentence_no"), featured(found, "claim", "claim_no")
    tokens = s.select("sentence_no", F.explode("f.t").alias("token"))
    met = tokens.join(rarest(c, s, threshold), "token").select("claim_no", "sentence_no").distinct()
    both = met.join(c.select("claim_no", "claim", F.col("f").alias("c")), "claim_no").join(s.select("sentence_no", "sentence", F.col("f").alias("e")), "sentence_no")
    fits = both.where(_sentence_fits(F.col("c"), F.col("e"), threshold)).select("claim", "sentence", T.coverage(F.col("c.t"), F.col("e.t")).alias("coverage"))
    return found.join(fits, "claim").join(told, "sentence").select("claim_id", "doc_id", "pos", "coverage")


def support_counts(docs: DataFrame, claims: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(claim_id, documents, first_id) of all claims: how many documents support each, and the
    smallest id of those."""
    each = supporting(docs, claims, threshold).groupBy("claim_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_id"))
    return claims.select("claim_id").join(each, "claim_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
