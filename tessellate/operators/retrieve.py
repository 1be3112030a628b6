"""Lexical retrieval as joins on terms.

Contract of a retriever: (docs, queries, k) -> (case_id, rank, doc_id, score); docs has
doc_id and text, queries has case_id and question.  Only documents that share a term with a
query are ever joined.  Texts are read and cut into words once: the grouped postings, cut to the
queries' terms where no others are needed, are written as a table that all that follows reads.
Besides the terms it has a row of the empty term for each document, its number of tokens, which
no join by term reads.  Tokens are counted in the row of their document, so no exchange counts them;
where the queries' terms are few enough, others are dropped there too.

A document's postings meet in one task, and are scored there for all queries; only the k best of a
task go on to the window of each query.

Scores are sums of whole numbers of 2^-40, the same in any order, and ranked by nine decimals,
then by id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import shipped, stored

K1, B = 1.5, 0.75


WHOLE = ""  # the term of a document as such; no token is empty


FEW = 1 << 18  # terms that are sent to all tasks, some 16 MB
LISTED = 1 << 13  # terms that a plan may list
CELLS = 1 << 19  # scores of documents for queries that a task sums at once
ROWS = 1 << 19  # postings that a task sums
HITS = 1 << 20  # of which so many are listed for queries at once


def counted(terms: Column) -> Column:
    """array<struct<term, tf>> of an array of terms: each once, in order."""
    one = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # value is evaluated once
    starts = lambda xs: F.array_compact(F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i)))
    runs = lambda xs, at: F.transform(at, lambda i, j: F.struct(F.get(xs, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(xs)) - i).cast("long").alias("tf")))
    return one(F.sort_array(terms), lambda xs: one(starts(xs), lambda at: runs(xs, at)))


def _counted(docs: DataFrame, tokens: T.Terms, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, dl, tf), of the given terms only if there are any given, and of WHOLE: a row for
    each term of a row of docs, moved nowhere."""
    words = docs.select("doc_id", tokens.kept(F.coalesce("text", F.lit(""))).alias("words"))
    kept, listed = F.transform("words", tokens.term), None
    if terms is not None:
        wanted = terms.select("term").distinct()
        head = [r["term"] for r in wanted.limit(LISTED + 1).collect()]
        listed = len(head) <= LISTED
        if listed:
            kept = F.filter(kept, lambda t: t.isin(head))
    whole = F.struct(F.lit(WHOLE).alias("term"), F.lit(1).cast("long").alias("tf"))
    each = words.select("doc_id", F.size("words").alias("dl"), F.array_append(counted(kept), whole).alias("terms"))
    # explode() has Spark infer a filter below the projection, by which all texts are cut twice
    each = each.select("doc_id", "dl", F.explode_outer("terms").alias("one")).select("doc_id", "one.term", "dl", "one.tf")
    if terms is None or listed:
        return each
    wanted = wanted.union(docs.sparkSession.range(1).select(F.lit(WHOLE)))
    return each.join(F.broadcast(wanted) if few(wanted) else wanted, "term", "left_semi").select("doc_id", "term", "dl", "tf")


def merged(each: DataFrame) -> DataFrame:
    """Rows of equal ids (and lengths) as one document."""
    return each.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))


def repeats(ids: DataFrame) -> bool:
    """Whether a doc_id comes twice."""
    return not ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _grouped(docs: DataFrame, tokens: T.Terms, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, dl, tf), of the given terms only if there are any given, and of WHOLE."""
    return merged(_counted(docs, tokens, terms))


def postings(docs: DataFrame, tokens: T.Terms = T.content_tokens, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl), of the given terms only if there are any given."""
    return _grouped(docs, tokens, terms).where(F.col("term") != WHOLE).select("doc_id", "term", "tf", "dl")


def document_frequencies(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def _collection(found: DataFrame) -> DataFrame:
    """n and avgdl of the rows of WHOLE."""
    mean = F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0))
    return found.where(F.col("term") == WHOLE).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), mean.alias("avgdl"))


def collection(docs: DataFrame, tokens: T.Terms = T.content_tokens) -> DataFrame:
    """One row: n documents, and their mean length (1 where that is 0 or undefined)."""
    length = F.size(tokens.kept(F.coalesce("text", F.lit(""))))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(length), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


UNIT = float(1 << 40)


def exact_sum(value: Column) -> Column:
    """Sum of values below 2^20 or so, rounded to 2^-40 each: the same however rows arrive, and
    added up before rows are moved."""
    return F.sum(F.rint(value * UNIT).cast("long")) / UNIT


def top(scored: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    order = Window.partitionBy("case_id").orderBy(F.round("score", 9).desc(), F.col("doc_id").asc())
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("case_id", "rank", "doc_id", "score")


def few(rows: DataFrame) -> bool:
    """Whether rows are so few that they can be sent to all tasks: counted, not estimated."""
    return rows.limit(FEW + 1).count() <= FEW


def parts(spark, documents: int, queries: int) -> int:
    """How many tasks share the scoring: what each holds does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-documents * queries // CELLS))


def _best_of_task(known: pa.Table, k: int, k1: float, b: float, flagged: bool):
    """What a task does with the postings of its documents: sums the weights of each document for
    each query, as whole numbers, and gives the rows that can be among a query's k best."""
    words, cases = known["term"].combine_chunks().dictionary_encode(), known["case_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    by_term = np.argsort(words.indices.to_numpy(zero_copy_only=False), kind="stable")
    term = words.indices.to_numpy(zero_copy_only=False)[by_term]
    asking = cases.indices.to_numpy(zero_copy_only=False)[by_term].astype(np.int64)
    start = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    idf = known["idf"].to_numpy()[by_term][start[:-1]]
    words, cases, norm = words.dictionary, cases.dictionary, known["avgdl"][0].as_py()
    near = int(2e-9 * UNIT) + 1  # scores further apart differ in the nine decimals that rank

    def run(batches):
        batches = list(batches)
        rows = pa.Table.from_batches(batches) if batches else None
        if not rows:
            return
        ids = rows["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        names = pc.sort_indices(ids.dictionary, null_placement="at_start")
        place = np.empty(len(names), np.int64)
        place[names.to_numpy()] = np.arange(len(names))
        doc = place[ids.indices.to_numpy(zero_copy_only=False)]
        names = ids.dictionary.take(names)
        at = pc.index_in(rows["term"], value_set=words).to_numpy().astype(np.int64)
        tf, dl = rows["tf"].to_numpy().astype(np.float64), rows["dl"].to_numpy().astype(np.float64)
        if flagged:  # documents without a needed posting are out
            live = np.zeros(len(names), bool)
            live[doc[rows["needed"].to_numpy(zero_copy_only=False)]] = True
            names, kept = names.filter(pa.array(live)), live[doc]
            doc, at, tf, dl = (np.cumsum(live) - 1)[doc][kept], at[kept], tf[kept], dl[kept]
        n = len(names)
        if not n:
            return
        weight = np.rint(idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / norm)) * UNIT).astype(np.int64)
        times = start[at + 1] - start[at]
        total, scores, i = np.concatenate([[0], np.cumsum(times)]), np.zeros(len(cases) * n, np.int64), 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, "right")) - 1)
            hit = np.repeat(np.arange(i, j), times[i:j])
            case = asking[start[at[hit]] + np.arange(total[i], total[j]) - total[hit]]
            np.add.at(scores, case * n + doc[hit], weight[hit])
            i = j
        scores = scores.reshape(len(cases), n)
        least = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k] - near, 1) if n > k else np.ones(len(cases), np.int64)
        case, doc = np.nonzero(scores >= least[:, None])
        score = scores[case, doc]
        order = np.lexsort((doc, -score, case))  # of equal scores, the first k ids
        case, doc, score = case[order], doc[order], score[order]
        first = np.ones(len(case), bool)
        first[1:] = (case[1:] != case[:-1]) | (score[1:] != score[:-1])
        nth = np.arange(len(case)) - np.maximum.accumulate(np.where(first, np.arange(len(case)), 0))
        case, doc, score = case[nth < k], doc[nth < k], score[nth < k]
        yield pa.RecordBatch.from_arrays([cases.take(pa.array(case)), names.take(pa.array(doc)), pa.array(score / UNIT)], ["case_id", "doc_id", "score"])

    return run


def best(found: DataFrame, known: DataFrame, documents: int, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The ranking by found (doc_id, term, tf, dl; needed, if only documents with such a posting may be
    ranked), of terms in known, for known (case_id, term, idf, avgdl), few() rows."""
    if k < 1:
        raise ValueError("k must be positive")
    spark, flagged = found.sparkSession, "needed" in found.columns
    schema = ty.StructType([ty.StructField("case_id", known.schema["case_id"].dataType), ty.StructField("doc_id", found.schema["doc_id"].dataType), ty.StructField("score", ty.DoubleType())])
    table = known.select("case_id", "term", "idf", "avgdl").toArrow()
    if not table.num_rows:
        return top(spark.createDataFrame([], schema), k)
    shipped(spark)
    tasks = max(parts(spark, documents, len(table["case_id"].unique())), -(-found.count() // ROWS))
    found = found.select("doc_id", "term", "tf", "dl", *(["needed"] if flagged else [])).repartition(tasks, "doc_id")
    return top(found.mapInArrow(_best_of_task(table, k, k1, b, flagged), schema), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, tokens: T.Terms = T.content_tokens, k1: float = K1, b: float = B) -> DataFrame:
    asked = stored(queries.select("case_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")), "asked")
    found = stored(_counted(docs, tokens, asked), "postings")
    if repeats(found.where(F.col("term") == WHOLE)):
        found = stored(merged(found), "postings")
    one = stored(_collection(found), "collection")
    found = found.where(F.col("term") != WHOLE)
    known = document_frequencies(found).crossJoin(F.broadcast(one)).select("term", bm25_idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    known = stored(asked.join(known, "term"), "known")
    if few(known):
        return best(found, known, one.first()["n"], k, k1, b)
    tf, dl, norm = F.col("tf"), F.col("dl"), F.col("avgdl")
    weight = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / norm))
    hits = found.join(known, "term").select("case_id", "doc_id", weight.alias("weight"))
    return top(hits.groupBy("case_id", "doc_id").agg(exact_sum(F.col("weight")).alias("score")), k)


def expanded_bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return bm25(docs, queries, k, T.expanded_tokens)


def tfidf(docs: DataFrame, queries: DataFrame, k: int, tokens: T.Terms = T.content_tokens) -> DataFrame:
    """Cosines of L2-normalised (1 + ln tf) idf vectors."""
    found = stored(_grouped(docs, tokens), "postings")
    one = F.broadcast(_collection(found).select("n"))  # a single row
    found = found.where(F.col("term") != WHOLE)
    idf = document_frequencies(found).crossJoin(one).select("term", tfidf_idf(F.col("n"), F.col("df")).alias("idf"))
    asked = queries.select("case_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("tf"))
    weight, square = (1 + F.log("tf")) * F.col("idf"), F.col("w") * F.col("w")
    unit = F.coalesce(F.nullif(F.sqrt(exact_sum(square)), F.lit(0.0)), F.lit(1.0)).alias("norm")
    weights = found.join(idf, "term").select("doc_id", "term", weight.alias("w"))
    norms = weights.groupBy("doc_id").agg(unit)
    wanted = asked.select("term").distinct()
    d = weights.join(wanted, "term", "left_semi").join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
    q = asked.join(idf, "term").select("case_id", "term", weight.alias("w"))
    q = q.join(q.groupBy("case_id").agg(unit), "case_id").select("case_id", "term", (F.col("w") / F.col("norm")).alias("qw"))
    return top(q.join(d, "term").groupBy("case_id", "doc_id").agg(exact_sum(F.col("qw") * F.col("weight")).alias("score")), k)


RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"bm25": bm25, "tfidf": tfidf, "expanded_bm25": expanded_bm25}


def compared(docs: DataFrame, queries: DataFrame, k: int, names: list[str]) -> DataFrame:
    """The rankings of several retrievers, with a column that names each."""
    out = None
    for name in dict.fromkeys(names):
        one = RETRIEVERS[name](docs, queries, k).withColumn("retriever", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ranked_lists(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """cases with `ranked`, the ids in order of rank; an empty list where nothing was found."""
    lists = ranked.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ranked"))
    return cases.join(lists, "case_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(lists.schema["ranked"].dataType)))
