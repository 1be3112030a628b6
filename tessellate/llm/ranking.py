"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks of at most BLOCK.  For each term of a block the index holds the
places of its documents in the block and, for each bit of an impact, a bitmap over those
documents.  A search spreads the bitmaps over the block's places, adds those of an item's terms
by bitwise carry arithmetic, for all items of a chunk that hold the term at once, and finds the k
highest sums from the most significant slice down.  What a block gives is at most k rows an item.

An impact is w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + ((50 n N) div L), w = floor(1000
ln((2N + 2) / (2 df + 1))): N documents with a term, L all their terms, n a document's terms, tf
and df as usual.  The index of a stated set of items is cut to their terms before it is made.

Scale: a document's terms are counted in its own row; postings are shuffled once by block and
term and once by block and chunk, groups that BLOCK and ITEMS bound whatever the input.  A term
in every document has one row a block.  The items' terms are sent to the workers only where they
have under VOCABULARY bytes; else postings meet them in a join.

Defined cases: a null or empty text, or one without a term, has no terms and is never found; a
null doc_id is ranked after all others of its score; rows that share a doc_id are documents of
their own; rows that share an item_id are one item of all their terms; an empty table gives an
empty one; other columns are ignored; whole texts are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_document, id_text, stored

K = 50
BLOCK = 1 << 14  # documents of a block, so that a place takes 16 bits
ITEMS = 128  # of a chunk, about
VOCABULARY = 1 << 22
_BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _TABLE[_c] = _c + 32
for _c in _BETWEEN:
    _TABLE[_c] = 0x20
_TABLE = bytes(_TABLE)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def asked(items: DataFrame, per_chunk: int = ITEMS) -> DataFrame:
    """(chunk, item_id, term): each item's distinct terms."""
    each = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = by_document(each, lambda ids, texts: {"item_id": ids, "terms": [[*map(bytes.decode, dict.fromkeys(terms_of(t)))] for t in texts]}, "item_id long, terms array<string>")
    n = max(1, -(-items.select("item_id").distinct().count() // per_chunk))
    each = lists.select("item_id", F.explode("terms").alias("term")).distinct()
    return each.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("chunk"), "item_id", "term")


def counted(docs: DataFrame, terms: DataFrame | None = None, block: int = BLOCK, most: int = VOCABULARY) -> DataFrame:
    """(block, place, doc_id, n, terms, tfs): each document with its place in a block, its number
    of terms and how often it holds each of the given terms (of all, if none are given)."""
    known = None
    if terms is not None:
        size = terms.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0
        if size <= most:  # bytes, checked
            known = docs.sparkSession.sparkContext.broadcast({r["term"].encode() for r in terms.select("term").distinct().collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = None if known is None else known.value
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n, lists = [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    n.append(len(words))
                    lists.append(Counter(words if own is None else filter(own.__contains__, words)))
                at = np.arange(seen, seen + len(n))
                seen += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + at // block), pa.array((at % block).astype(np.int32)), part.column(0), pa.array(n, pa.int64()), pa.array([[*map(bytes.decode, x)] for x in lists], pa.list_(pa.string())), pa.array([[*x.values()] for x in lists], pa.list_(pa.int64()))],
                    names=["block", "place", "doc_id", "n", "terms", "tfs"],
                )

    return id_text(docs).mapInArrow(run, "block long, place int, doc_id long, n long, terms array<string>, tfs array<long>")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, term, places, slices) of (block, term, array of (place, impact) by place)."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        place, impact = (flat.field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
        ends = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()
        places, slices = [], []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            values = impact[a:b].astype("<u8")
            bits = int(values.max()).bit_length()
            table = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits].T
            places.append(place[a:b].astype("<u2").tobytes())
            slices.append(np.packbits(table, axis=1, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(slices, pa.binary())], names=["block", "term", "places", "slices"])


def index(documents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(block, term, places, slices) of counted() documents: places of 16 bits, ascending, and
    the impacts' bitmaps over them, the least significant first, each filled up to whole bytes."""
    n_docs, n_terms = documents.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = documents.where("n > 0").select("block", "place", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("block", "place", "n", "x.terms", "x.tfs").withColumnsRenamed({"terms": "term", "tfs": "tf"})
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    df = documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("w"))
    m = F.expr(f"50 + ((50 * n * {n_docs}L) div {max(1, n_terms)}L)")
    impacts = each.withColumn("m", m).join(weights, "term").select("block", "term", "place", F.expr("w * ((1000000000L * tf) div (1000 * tf + 20 * m))").alias("impact"))
    lists = impacts.where("impact > 0").groupBy("block", "term").agg(F.array_sort(F.collect_list(F.struct("place", "impact"))).alias("x"))
    return lists.mapInArrow(_sliced, "block long, term string, places binary, slices binary")


def spread_out(places: np.ndarray, slices: bytes, size: int) -> np.ndarray:
    """The bitmaps of a term over all `size` (a multiple of 64) places of its block, as words."""
    table = np.frombuffer(slices, np.uint8).reshape(-1, -(-len(places) // 8))
    dense = np.zeros((len(table), size), np.uint8)
    dense[:, places] = np.unpackbits(table, axis=1, count=len(places), bitorder="little")
    return np.packbits(dense, axis=1, bitorder="little").view("<u8")


def add(sums: np.ndarray, items: np.ndarray, bitmaps: np.ndarray) -> None:
    """Adds the numbers in a term's bitmaps (slices, words) to those of the items in sums
    (slices, items, words): sum and carry of three bits, slice by slice."""
    carry = np.zeros((len(items), sums.shape[2]), np.uint64)
    for b in range(len(sums)):
        old = sums[b, items]
        if b < len(bitmaps):
            either = old ^ bitmaps[b]
            both = old & bitmaps[b]
        elif carry.any():
            either, both = old, np.uint64(0)
        else:
            break
        sums[b, items] = either ^ carry
        carry = both | (either & carry)


def highest(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the numbers in bitmaps (slices, words) the places of those surely among the k highest,
    and of those that tie for what is left; only numbers over 0 count."""
    sure = np.zeros(sums.shape[1], np.uint64)
    open_ = np.bitwise_or.reduce(sums, axis=0) if len(sums) else sure
    for level in sums[::-1]:
        both = sure | (open_ & level)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            open_ = open_ & level
        else:
            sure, open_ = both, open_ & ~level
            if n == k:
                open_ = np.zeros_like(open_)
                break
    return tuple(np.nonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))[0] for x in (sure, open_))


def _searched(k: int):
    """A function over the rows of one block and chunk: of terms, and one with the doc_ids."""

    def run(table: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        ids, rows = None, []
        for r in range(table.num_rows):
            if table.column("places")[r].is_valid:
                rows.append(r)
            else:
                ids = table.column("ids")[r].as_py()
        names: dict = {}
        users = [[names.setdefault(i, len(names)) for i in table.column("items")[r].as_py()] for r in rows]
        if rows:
            size = -(-len(ids) // 64) * 64
            most = max(len(table.column("slices")[r].as_buffer()) // -(-(len(table.column("places")[r].as_buffer()) // 2) // 8) for r in rows)
            sums = np.zeros((most + len(rows).bit_length(), len(names), size // 64), np.uint64)
            for r, of in zip(rows, users):
                places = np.frombuffer(table.column("places")[r].as_buffer(), "<u2")
                add(sums, np.array(of), spread_out(places, table.column("slices")[r].as_py(), size))
            for name, j in names.items():
                own = np.ascontiguousarray(sums[:, j])
                sure, tied = highest(own, k)
                tied = sorted(tied.tolist(), key=lambda p: (ids[p] is None, ids[p]))[: k - len(sure)]
                for p in [*sure.tolist(), *tied]:
                    bits = (own[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)
                    for c, v in zip(out, (name, ids[p], sum(1 << b for b in np.nonzero(bits)[0].tolist()))):
                        c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item_id", "doc_id", "score"])

    return run


def search(found: DataFrame, documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of asked() items over an index() of counted() documents."""
    users = items.groupBy("chunk", "term").agg(F.collect_list("item_id").alias("items"), F.max(F.isnull("item_id")).alias("nameless"))
    users = users.select("chunk", "term", F.when(F.col("nameless"), F.array_append("items", F.lit(None).cast("long"))).otherwise(F.col("items")).alias("items"))
    parts = found.join(users, "term").select("block", "chunk", "places", "slices", "items", F.lit(None).cast("array<long>").alias("ids"))
    ids = documents.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id")))["doc_id"].alias("ids"))
    chunks = items.select("chunk").distinct().agg(F.collect_list("chunk").alias("chunks"))  # a number for every ITEMS items
    ids = ids.crossJoin(F.broadcast(chunks)).select("block", F.explode("chunks").alias("chunk"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("slices"), F.lit(None).cast("array<long>").alias("items"), "ids")
    each = parts.unionByName(ids).groupBy("block", "chunk").applyInArrow(_searched(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, per_chunk: int = ITEMS, most: int = VOCABULARY) -> DataFrame:
    """The k highest documents of each item, by an index cut to the items' terms."""
    if k < 1 or not 0 < block <= 1 << 16:
        raise ValueError("k must be positive, and a block have 1 to 65536 documents")
    wanted = stored(asked(items, per_chunk), "asked")
    documents = stored(counted(docs, wanted, block, most), "counted")
    return search(index(documents, wanted), documents, wanted, k)


def oracle(k: int = K) -> str:
    """The same in DuckDB's SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"regexp_extract_all(translate(text, '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
    each AS (SELECT r, doc_id, n, unnest(terms) AS term FROM sized),
    tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM each GROUP BY ALL),
    df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
    scored AS (
      SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM asked JOIN tf USING (term) JOIN w USING (term), whole GROUP BY item_id, r, doc_id),
    placed AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {k}
    """
