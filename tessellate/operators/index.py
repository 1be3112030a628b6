"""A stored inverted index, kept as tables of segments below one path.

    documents/segment=n           doc_id, dl and the tokens of each document added in segment n
    postings/segment=n/bucket=b   term, tier, doc_id, tf, dl; b is a hash of the term, terms in order
    blocks/segment=n              of each term and tier: bucket, postings, greatest tf, least dl
    dead/segment=n                doc_id, of (its segment), dl and distinct terms of what segment n hides

A segment is written by Spark's writers, each table as a whole, so writing one again after a
failure replaces it.  Adding a document hides an earlier one of the same id; removing one hides
it too.  Document frequencies, the number of documents and their lengths are sums over segments
less the sums over what is dead, so no segment is ever rewritten, and a search scans no text:
it reads the buckets of its terms only.

Pruned search: a tier holds postings of like weight, so a block's greatest tf and least dl bound
its scores closely.  The scores by the rarest terms alone give a k-th score that the final one
can't be below.  Terms are then put in order, most frequent first: a document that has only
blocks of the first terms, with bounds that sum to less, can't be among the k.  Documents of the
other blocks are the candidates, and only their postings are joined and summed.

Ids are unique in a segment.  A null text has no tokens, but is a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import stored
from .retrieve import B, K1, best, bm25_idf, counted, exact_sum, few, repeats, top

BUCKETS, TIERS = 64, 8
PROBE = 64  # postings of a case that the first pass reads, about
MARGIN = 1e-6  # by which rounding may move a sum
_POSTINGS = "term string, tier int, doc_id {id}, tf long, dl int, segment int, bucket int"
_BLOCKS = "bucket int, term string, tier int, n long, max_tf long, min_dl int, segment int"
_DOCUMENTS = "doc_id {id}, dl int, words array<string>, segment int"
_DEAD = "doc_id {id}, of int, dl int, terms array<string>, segment int"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, name: str, schema: str, id_type: str) -> DataFrame:
    return spark.read.schema(schema.format(id=id_type)).parquet(f"{path.rstrip('/')}/{name}")


def write_segment(path: str, number: int, docs: DataFrame, removed: DataFrame | None = None, tokens: T.Terms = T.content_tokens, buckets: int = BUCKETS) -> None:
    """Writes segment `number`: docs (doc_id, text) are added, after the ids in `removed` (doc_id)
    are removed from the segments before."""
    words = docs.select("doc_id", tokens.kept(F.coalesce("text", F.lit(""))).alias("words"))
    _write(path, number, words.select("doc_id", F.size("words").alias("dl"), "words"), removed, tokens, buckets)


def compact(spark: SparkSession, path: str, into: str, tokens: T.Terms = T.content_tokens, id_type: str = "bigint", buckets: int = BUCKETS) -> None:
    """Writes what is alive as one segment of a new index; no text is cut anew."""
    _write(into, 0, documents(spark, path, id_type).select("doc_id", "dl", "words"), None, tokens, buckets)


def _write(path: str, number: int, words: DataFrame, removed: DataFrame | None, tokens: T.Terms, buckets: int) -> None:
    spark, id_type = words.sparkSession, words.schema["doc_id"].dataType.simpleString()
    at = lambda name: f"{path.rstrip('/')}/{name}/segment={number}"
    words.write.mode("overwrite").parquet(at("documents"))
    own = spark.read.schema(f"doc_id {id_type}, dl int, words array<string>").parquet(at("documents"))
    gone = own.select("doc_id") if removed is None else own.select("doc_id").union(removed.select(F.col("doc_id").cast(id_type)))
    _hidden(spark, path, number, gone, tokens, id_type).write.mode("overwrite").parquet(at("dead"))
    mean = own.agg(F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0))).first()[0]
    # counted in the row; not explode(), for which Spark infers a filter that counts a second time
    each = own.select("doc_id", "dl", F.explode_outer(counted(F.transform("words", tokens.term))).alias("one"))
    each = each.select("doc_id", "dl", "one.term", "one.tf").where("term IS NOT NULL")
    if repeats(own):
        each = each.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))
    tier = F.floor(TIERS * F.col("tf") / (F.col("tf") + _length(F.col("dl"), F.lit(mean)))).cast("int")
    each = each.select("term", tier.alias("tier"), "doc_id", "tf", "dl", bucket_of(F.col("term"), buckets).alias("bucket"))
    each.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "tier").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    found = spark.read.schema(_POSTINGS.format(id=id_type).replace(", segment int", "")).parquet(at("postings"))
    found.groupBy("bucket", "term", "tier").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")).write.mode("overwrite").parquet(at("blocks"))


def _hidden(spark: SparkSession, path: str, number: int, gone: DataFrame, tokens: T.Terms, id_type: str) -> DataFrame:
    """(doc_id, of, dl, terms) of the documents of earlier segments that `gone` hides now."""
    before = _table(spark, path, "documents", _DOCUMENTS, id_type).where(F.col("segment") < number)
    terms = F.array_distinct(F.transform("words", tokens.term)).alias("terms")
    if not number or before.isEmpty():
        return before.where("false").select("doc_id", F.col("segment").alias("of"), "dl", terms)
    # ids are joined first: words are moved of what goes only, and not even of that where it is little
    hit = stored(before.select("doc_id").join(gone.distinct(), "doc_id", "left_semi").distinct(), "hidden")
    old = before.join(F.broadcast(hit) if few(hit) else hit, "doc_id", "left_semi").select("doc_id", F.col("segment").alias("of"), "dl", terms)
    dead = _table(spark, path, "dead", _DEAD, id_type).where(F.col("segment") < number).select("doc_id", "of")
    return old.join(dead, ["doc_id", "of"], "left_anti")


def documents(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, dl, words, segment) of what is alive."""
    dead = _table(spark, path, "dead", _DEAD, id_type).select("doc_id", F.col("of").alias("segment"))
    return _table(spark, path, "documents", _DOCUMENTS, id_type).join(dead, ["doc_id", "segment"], "left_anti")


def postings(spark: SparkSession, path: str, id_type: str = "bigint", within: list[int] | None = None) -> DataFrame:
    """(term, tier, doc_id, tf, dl, segment, bucket) of what is alive, of some buckets only if given."""
    found = _table(spark, path, "postings", _POSTINGS, id_type)
    if within is not None:
        found = found.where(F.col("bucket").isin(within))
    dead = _table(spark, path, "dead", _DEAD, id_type).select("doc_id", F.col("of").alias("segment"))
    return found.join(dead, ["doc_id", "segment"], "left_anti")


def collection(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row, n and avgdl: sums of the segments less those of the dead."""
    sums = lambda df, sign: df.agg((sign * F.count("*")).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("dl"))
    both = sums(_table(spark, path, "documents", _DOCUMENTS, id_type), 1).union(sums(_table(spark, path, "dead", _DEAD, id_type), -1))
    total = both.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    return total.select("n", F.coalesce(F.nullif(F.try_divide("dl", "n"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def document_frequencies(spark: SparkSession, path: str, id_type: str = "bigint", within: list[int] | None = None) -> DataFrame:
    """(term, df) of what is alive."""
    blocks = _table(spark, path, "blocks", _BLOCKS, id_type)
    blocks = blocks if within is None else blocks.where(F.col("bucket").isin(within))
    dead = _table(spark, path, "dead", _DEAD, id_type).select(F.explode("terms").alias("term"), F.lit(-1).cast("bigint").alias("n"))
    return blocks.select("term", "n").union(dead).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")


def _length(dl: Column, mean: Column) -> Column:
    return K1 * (1 - B + B * dl / mean)


def _weight(tf: Column, dl: Column) -> Column:
    """A posting's share of a score; needs idf and avgdl."""
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _asked(spark: SparkSession, path: str, queries: DataFrame, tokens: T.Terms, id_type: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """(case_id, term, bucket, df, idf, avgdl) of the queries' known terms, and their buckets (no
    more than there are)."""
    terms = queries.select("case_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    terms = stored(terms.withColumn("bucket", bucket_of(F.col("term"), buckets)), "terms")
    within = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
    one = F.broadcast(collection(spark, path, id_type))  # a single row
    known = document_frequencies(spark, path, id_type, within).crossJoin(one).select("term", "df", bm25_idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    return stored(terms.join(known, "term"), "asked"), within


def _summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("case_id", "doc_id").agg(exact_sum(F.col("weight")).alias("score"))


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int, tokens: T.Terms = T.content_tokens, id_type: str = "bigint", buckets: int = BUCKETS) -> DataFrame:
    """The ranking of retrieve.bm25() from the index: every posting of the queries' terms is joined."""
    asked, within = _asked(spark, path, queries, tokens, id_type, buckets)
    live = postings(spark, path, id_type, within)
    if few(asked):
        return _scored(spark, path, live, asked, k, id_type)
    hits = live.join(asked, ["bucket", "term"])
    return top(_summed(hits.withColumn("weight", _weight(F.col("tf"), F.col("dl")))), k)


def _scored(spark: SparkSession, path: str, live: DataFrame, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """The ranking by postings of asked terms: each is moved once, to the task of its document."""
    found = live.join(F.broadcast(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
    return best(found, asked, collection(spark, path, id_type).first()["n"], k)


def _needed(spark: SparkSession, path: str, queries: DataFrame, k: int, tokens: T.Terms, id_type: str, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is asked, the live postings of its buckets, all blocks (case_id, term, tier, segment, n) of
    the queries, and those of them (case_id, bucket, term, tier, segment) whose documents can be ranked."""
    asked, within = _asked(spark, path, queries, tokens, id_type, buckets)
    live = postings(spark, path, id_type, within)
    stats = _table(spark, path, "blocks", _BLOCKS, id_type).where(F.col("bucket").isin(within))
    blocks = stats.join(asked, ["bucket", "term"]).withColumn("bound", _weight(F.col("max_tf"), F.col("min_dl")))
    blocks = stored(blocks.select("case_id", "bucket", "term", "tier", "segment", "n", "bound"), "blocks")
    each = blocks.groupBy("case_id", "bucket", "term").agg(F.sum("n").alias("n"), F.max("bound").alias("bound"))
    # first pass: the rarest terms alone
    rare = Window.partitionBy("case_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
    probes = each.withColumn("before", F.coalesce(F.sum("n").over(rare), F.lit(0))).where(F.col("before") < max(PROBE, 4 * k)).select("case_id", "bucket", "term")
    hits = live.join(asked.join(probes, ["case_id", "bucket", "term"], "left_semi"), ["bucket", "term"])
    ranked = top(_summed(hits.withColumn("weight", _weight(F.col("tf"), F.col("dl")))), k)
    least = ranked.where(F.col("rank") == k).select("case_id", (F.col("score") - MARGIN).alias("least"))
    # second pass: blocks that only documents below `least` can be left with
    order = Window.partitionBy("case_id").orderBy(F.col("n").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("case_id", "bucket", "term", F.coalesce(F.sum("bound").over(order), F.lit(0.0)).alias("before"))
    needed = blocks.join(each, ["case_id", "bucket", "term"]).join(least, "case_id", "left")
    needed = needed.where(F.col("least").isNull() | (F.col("before") + F.col("bound") >= F.col("least"))).select("case_id", "bucket", "term", "tier", "segment")
    return asked, live, blocks, needed


def _pruned(asked: DataFrame, live: DataFrame, needed: DataFrame) -> DataFrame:
    """The hits of each case's candidates."""
    candidates = stored(live.join(needed, ["bucket", "term", "tier", "segment"]).select("case_id", "doc_id", "segment").distinct(), "candidates")
    of_any = live.join(candidates.select("doc_id", "segment").distinct(), ["doc_id", "segment"], "left_semi")
    return of_any.join(asked, ["bucket", "term"]).join(candidates, ["case_id", "doc_id", "segment"], "left_semi")


def pruned_bm25(spark: SparkSession, path: str, queries: DataFrame, k: int, tokens: T.Terms = T.content_tokens, id_type: str = "bigint", buckets: int = BUCKETS) -> DataFrame:
    """The same ranking, summing the postings of candidates only: where the queries' blocks are few, of
    documents that are some case's, which the task that has a document's postings finds out."""
    asked, live, _, needed = _needed(spark, path, queries, k, tokens, id_type, buckets)
    at = ["bucket", "term", "tier", "segment"]
    if few(asked):
        blocks = stored(needed.select(at).distinct().withColumn("needed", F.lit(True)), "needed")
        if few(blocks):
            return _scored(spark, path, live.join(F.broadcast(blocks), at, "left").withColumn("needed", F.coalesce("needed", F.lit(False))), asked, k, id_type)
    return top(_summed(_pruned(asked, live, needed).withColumn("weight", _weight(F.col("tf"), F.col("dl")))), k)


def pruning(spark: SparkSession, path: str, queries: DataFrame, k: int, tokens: T.Terms = T.content_tokens, id_type: str = "bigint", buckets: int = BUCKETS) -> DataFrame:
    """(case_id, postings, summed): how many postings each case's terms have, and how many of
    them are its candidates', what pruned_bm25() has to sum for it."""
    asked, live, blocks, needed = _needed(spark, path, queries, k, tokens, id_type, buckets)
    hits = _pruned(asked, live, needed)
    all_ = blocks.groupBy("case_id").agg(F.sum("n").alias("postings"))
    return all_.join(hits.groupBy("case_id").agg(F.count("*").alias("summed")), "case_id", "left").select("case_id", "postings", F.coalesce("summed", F.lit(0)).alias("summed"))
