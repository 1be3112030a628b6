"""Suffix-array dedup: repeated 50-byte strings by merging shard Burrows-Wheeler
transforms.

1. Which parts can repeat.  Each 50-byte window has an anchor: its leftmost least-hashed
   24-byte gram (a minimizer), which depends on the window's bytes alone, so equal windows
   have equal anchors.  Anchors that occur in two or more documents are candidates; the
   stretch of windows around a candidate, at most 76 bytes, is a segment.  Nothing repeated
   is outside the segments, and equal windows are in segments of one bucket (a hash of
   the anchor).  Equal segments are merged before any shuffle, with their smallest id.
2. In each bucket the distinct segments are packed into shards.  A shard's windows are sorted
   once and its Burrows-Wheeler transform is taken, over blocks of STEP bytes: the symbol of a
   suffix is the block before it, named exactly by its rank.  Of the transform only the rows
   that lead to whole windows are kept, by depth.  The shards are merged by iterative
   interleave refinement: the interleave starts as one shard after another, and each round
   reads the symbols in its order and sorts it stably by them, which orders the merged
   suffixes by STEP bytes more.  No suffix is compared or sorted
   again.  Bounds between neighbours follow from the rounds alone: they share a prefix of k
   blocks if in the last k rounds they read equal symbols.  After 50 bytes, rows without a
   bound between them are the repeated intervals, and each takes the smallest id in it.
3. Back at the documents, bytes under windows whose smallest id is below the document's own
   are removed.

Documents are grouped into chunks of about `chunk_bytes`, and both sides exchange one packed
row for each chunk and bucket, so a passage that a third of the documents share costs one
segment in each chunk.  All steps are one plan of shuffles: a lost executor's part is made
again, and made equal, since a chunk's segments are numbered in order of id and text.

Defined cases: null and empty texts are empty; texts under 50 bytes lose nothing; rows with
the same doc_id never remove each other's bytes; a row without doc_id neither removes
nor loses any; other columns are ignored; a text longer than PIECE is scanned in pieces
whose windows are those of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, total_bytes

LENGTH = 50
GRAM = 24
STEP = 10
CHUNK = 8 << 20  # bytes of text in a chunk
BUCKET = 4 << 20  # bytes of text for each bucket
SHARD = 1 << 18  # suffixes sorted at once
PIECE = 1 << 16  # windows scanned at once; arrays of that size stay in the processor's cache
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64((1 << 24) - 1)
_KEPT = np.uint64((1 << 48) - 1)  # bits of an anchor that travel; a chance match costs work only
NEVER = np.iinfo(np.int64).max


def _gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of width bytes, by doubling."""
    join = lambda x, y: (x ^ (x >> np.uint64(29))) * _MIX + y
    size, powers = 1, {1: (raw.astype(np.uint64) + np.uint64(1)) * _GOLD}
    while size * 2 <= width:
        x = powers[size]
        size *= 2
        powers[size] = join(x[: len(x) - size // 2], x[size // 2 :])
    out = powers[size]
    for n in sorted(powers, reverse=True):
        while size + n <= width:
            out = join(out[: len(powers[n]) - size], powers[n][size:])
            size += n
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first and last window of each stretch of windows of raw."""
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(raw, GRAM)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    size, width = 1, LENGTH - GRAM + 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    at = (least & _PLACE).astype(np.int64)
    cut = np.nonzero(at[1:] != at[:-1])[0] + 1
    lo = np.concatenate([[0], cut])
    return h[at[lo]] & _KEPT, lo, np.concatenate([cut, [len(at)]]) - 1


class Chunk:
    """The documents of a chunk in order of id and text, laid end to end, and the
    stretches of windows that lie within one document."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.raw = [(texts[i] or "").encode("utf-8") for i in order]
        size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.all = b"".join(self.raw)
        self.bytes = np.frombuffer(self.all, np.uint8)
        self.own = np.array([NEVER if i is None else i for i in self.ids], np.int64)
        self._scan()

    def _scan(self) -> None:
        hashes, los, his, docs = [], [], [], []
        total = len(self.bytes)
        for a in range(0, total, PIECE):  # windows that start in [a, a + PIECE)
            h, lo, hi = anchors(self.bytes[a : min(total, a + PIECE + LENGTH - 1)])
            lo, hi = lo + a, hi + a
            # cut where documents end: windows of document d start before ends[d] - 49
            d = np.searchsorted(self.ends, lo, side="right")
            last = np.searchsorted(self.ends, hi, side="right")
            over = np.nonzero(last > d)[0]
            if len(over):
                extra = [(h[i], max(lo[i], self.starts[e]), hi[i], e) for i in over.tolist() for e in range(d[i] + 1, last[i] + 1)]
                h = np.concatenate([h, np.array([x[0] for x in extra], np.uint64)])
                lo = np.concatenate([lo, np.array([x[1] for x in extra], np.int64)])
                hi = np.concatenate([hi, np.array([x[2] for x in extra], np.int64)])
                d = np.concatenate([d, np.array([x[3] for x in extra], np.int64)])
            hi = np.minimum(hi, self.ends[d] - LENGTH)
            ok = (hi >= lo) & (self.own[d] != NEVER)
            hashes.append(h[ok]), los.append(lo[ok]), his.append(hi[ok]), docs.append(d[ok])
        join = lambda x, t: np.concatenate([*x, np.zeros(0, t)])
        self.hash, self.lo, self.hi, self.doc = join(hashes, np.uint64), join(los, np.int64), join(his, np.int64), join(docs, np.int64)
        order = np.argsort(self.lo, kind="stable")
        self.hash, self.lo, self.hi, self.doc = self.hash[order], self.lo[order], self.hi[order], self.doc[order]

    def segments(self, wanted: np.ndarray, buckets: int):
        """Of the stretches with wanted (sorted) anchors: their places, the number of each
        one's distinct segment in its bucket's order, and the distinct segments as
        (bucket, anchor, text, smallest id) sorted by bucket, first seen first."""
        if len(wanted):
            k = np.minimum(np.searchsorted(wanted, self.hash), len(wanted) - 1)
            at = np.nonzero(wanted[k] == self.hash)[0]
        else:
            at = np.zeros(0, np.int64)
        known: dict[bytes, int] = {}
        number = [0] * len(at)
        first = []
        whole = self.all
        for j, (lo, hi) in enumerate(zip(self.lo[at].tolist(), self.hi[at].tolist())):
            text = whole[lo : hi + LENGTH]
            n = known.setdefault(text, len(known))
            number[j] = n
            if n == len(first):
                first.append(j)
        first, number = np.array(first, np.int64), np.array(number, np.int64)
        anchor = self.hash[at[first]]
        bucket = bucket_of(anchor, buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        least = np.full(len(first), NEVER, np.int64)
        np.minimum.at(least, number, self.own[self.doc[at]])
        texts = list(known)
        return at, rank[number], bucket[order], anchor[order], [texts[i] for i in order.tolist()], least[order]


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _narrow(h: np.ndarray) -> bytes:
    """Anchors in six bytes each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _by_bucket(bucket: np.ndarray):
    """(bucket, start, end) of the runs of a sorted array."""
    cut = np.nonzero(bucket[1:] != bucket[:-1])[0] + 1
    ends = np.append(cut, len(bucket)) if len(bucket) else []
    starts = np.concatenate([[0], cut]) if len(bucket) else []
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, ends)]


def _table(schema: dict, **cols) -> pa.Table:
    return pa.table({k: pa.array(cols[k], t) for k, t in schema.items()})


_ANCHORS = {"bucket": pa.int64(), "pid": pa.int64(), "anchors": pa.binary()}
_SEGMENTS = {"bucket": pa.int64(), "pid": pa.int64(), "anchors": pa.binary(), "sizes": pa.binary(), "least": pa.binary(), "texts": pa.binary()}
_LEAST = {"pid": pa.int64(), "bucket": pa.int64(), "anchors": pa.binary(), "least": pa.binary()}
_FLAG = np.uint64(1)


def _chunk_anchors(table: pa.Table, buckets: int) -> pa.Table:
    """A chunk's anchors for each bucket; the lowest bit (not part of the hash from here
    on) says that two of its documents hold it."""
    chunk = Chunk(table)
    pid = table.column("pid")[0].as_py()
    h = chunk.hash & ~_FLAG
    own = chunk.own[chunk.doc]
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    at = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
    lo, hi = (np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)) if len(h) else (own, own)
    h = h[at] | (lo != hi).astype(np.uint64)
    bucket = bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    h, bucket = h[order], bucket[order]
    runs = _by_bucket(bucket)
    return _table(_ANCHORS, bucket=[r[0] for r in runs], pid=[pid] * len(runs), anchors=[_narrow(h[a:b]) for _, a, b in runs])


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: which of its anchors two or more documents hold."""
    bucket = table.column("bucket")[0].as_py()
    pids = table.column("pid").to_pylist()
    each = [_wide(x) for x in table.column("anchors").to_pylist()]
    h = np.concatenate(each)
    order = np.argsort(h & ~_FLAG, kind="stable")
    key = (h & ~_FLAG)[order]
    at = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    times = np.diff(np.append(at, len(key)))
    shared = (times > 1) | (np.bitwise_or.reduceat(h[order] & _FLAG, at) > 0)
    yes = np.empty(len(h), bool)
    yes[order] = np.repeat(shared, times)
    cuts = np.cumsum([0, *map(len, each)])
    found = [(p, (x & ~_FLAG)[yes[a:b]]) for p, x, a, b in zip(pids, each, cuts, cuts[1:])]
    found = [(p, x) for p, x in found if len(x)]
    return _table(_ANCHORS, bucket=[bucket] * len(found), pid=[p for p, _ in found], anchors=[_narrow(x) for _, x in found])


def _wanted(table: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(_wide(x) for x in table.column("anchors").to_pylist())]))


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _chunk_segments(docs: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows or not found.num_rows:
        return _table(_SEGMENTS, **dict.fromkeys(_SEGMENTS, []))
    chunk = Chunk(docs)
    chunk.hash &= ~_FLAG
    _, _, bucket, anchor, texts, least = chunk.segments(_wanted(found), buckets)
    runs = _by_bucket(bucket)
    pid = docs.column("pid")[0].as_py()
    size = np.fromiter(map(len, texts), np.int32, len(texts))
    return _table(_SEGMENTS, bucket=[r[0] for r in runs], pid=[pid] * len(runs), anchors=[_narrow(anchor[a:b]) for _, a, b in runs], sizes=[size[a:b].tobytes() for _, a, b in runs], least=[least[a:b].tobytes() for _, a, b in runs], texts=[_packed(b"".join(texts[a:b])) for _, a, b in runs])


def block_names(shards: list[np.ndarray], step: int = STEP) -> list[np.ndarray]:
    """Ranks of the step bytes from each place of each shard that has as many, over all
    shards: equal blocks and only they have equal names."""
    words, tails = [], []
    for s in shards:
        n = len(s) - step + 1
        eight = np.zeros(n, np.uint64)
        for j in range(min(step, 8)):
            eight = (eight << np.uint64(8)) | s[j : j + n]
        tail = np.zeros(n, np.uint64)
        for j in range(8, step):
            tail = (tail << np.uint64(8)) | s[j : j + n]
        words.append(eight), tails.append(tail)
    name = _ranks(np.concatenate(words))
    if step > 8:
        name = _ranks((name.astype(np.uint64) << np.uint64(8 * (step - 8))) | np.concatenate(tails))
    return np.split(name, np.cumsum([len(x) for x in words])[:-1])


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)
    s = x[order]
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]), dtype=np.int32)
    return out


def _stable(x: np.ndarray) -> np.ndarray:
    """Stable order of names (int32) by two radix passes."""
    o = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return o[np.argsort((x[o] >> 16).astype(np.uint16), kind="stable")]


def transforms(name: np.ndarray, windows: np.ndarray, rounds: int, step: int = STEP) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's Burrows-Wheeler transform by depth, and its windows in sorted order.

    The row of a window at depth k is its suffix that starts k blocks before the window's
    end; the symbol is the block before that.  Only these rows lead to windows, so the
    others of the shard's transform are left out."""
    order, out = np.arange(len(windows)), []
    for k in range(rounds):
        out.append(name[windows[order] + (rounds - 1 - k) * step])
        order = order[_stable(out[-1])]
    return out, order


def merged(shards: list[np.ndarray], windows: list[np.ndarray], depth: int = LENGTH, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' transforms.  windows: places in each shard with depth bytes after
    them.  Returns, in merged order, each window's number (shards one after another) and
    whether it begins a new interval, that is whether its common prefix with the one before is
    shorter than depth: neighbours share all of it if they read equal symbols and shared all
    they had before that round."""
    rounds = depth // step
    names = block_names(shards, step)
    own = [transforms(x, w, rounds, step) for x, w in zip(names, windows)]
    starts = np.cumsum([0, *map(len, windows)])[:-1]
    final = np.concatenate([o + a for (_, o), a in zip(own, starts)])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(w) for w in windows])
    total = len(final)
    row = np.arange(total)  # the shard's row that each place of the interleave points to
    group = np.zeros(total, np.int32)
    new = np.zeros(total, bool)
    for k in range(rounds):
        read = np.concatenate([t[k] for t, _ in own])[row]
        order = _stable(read)
        read, group, shard = read[order], group[order], shard[order]
        new = np.concatenate([[True], (read[1:] != read[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new, dtype=np.int32)
        row[np.argsort(shard, kind="stable")] = np.arange(total)
    return final[row], new


def _bucket_least(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, the smallest id of each window of its segments."""
    cols = {k: table.column(k).to_pylist() for k in _SEGMENTS}
    known: dict[bytes, int] = {}
    least: list[int] = []
    numbers = []
    for sizes, mins, texts in zip(cols["sizes"], cols["least"], map(_unpacked, cols["texts"])):
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32))]).tolist()
        own = []
        for a, b, m in zip(cuts, cuts[1:], np.frombuffer(mins, np.int64).tolist()):
            n = known.setdefault(texts[a:b], len(known))
            if n == len(least):
                least.append(m)
            elif m < least[n]:
                least[n] = m
            own.append(n)
        numbers.append(np.array(own, np.int64))
    texts = list(known)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    cuts = [0]  # shards are cut between segments
    while cuts[-1] < len(whole):
        k = max(int(np.searchsorted(ends, cuts[-1] + SHARD, side="right")) - 1, int(np.searchsorted(ends, cuts[-1], side="right")))
        cuts.append(int(ends[k]))
    starts, n = ends - size, size - LENGTH + 1
    every = _ranges(starts, n)  # places of windows
    at = np.searchsorted(every, cuts)
    order, new = merged([whole[a:b] for a, b in zip(cuts, cuts[1:])], [every[i:j] - a for i, j, a in zip(at, at[1:], cuts)])
    ids = np.repeat(np.array(least, np.int64), n)[order]
    first = np.nonzero(new)[0]
    of = np.empty(len(every), np.int64)
    of[order] = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(every))))
    begin = np.cumsum(n) - n
    out = [of[_ranges(begin[own], n[own])].tobytes() for own in numbers]
    return _table(_LEAST, pid=cols["pid"], bucket=cols["bucket"], anchors=cols["anchors"], least=out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def _removed(docs: pa.Table, found: pa.Table, buckets: int, keep: bool) -> pa.Table:
    if not docs.num_rows:
        return _digests([], keep)
    chunk = Chunk(docs)
    chunk.hash &= ~_FLAG
    gone = np.zeros(len(chunk.bytes), bool)  # windows that an earlier document has
    if found.num_rows:
        at, number, _, _, texts, _ = chunk.segments(_wanted(found), buckets)
        rows = sorted(zip(found.column("bucket").to_pylist(), found.column("least").to_pylist()))
        least = np.frombuffer(b"".join(x for _, x in rows), np.int64)
        n = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
        first = np.cumsum(n) - n
        if n.sum() != len(least):
            raise RuntimeError("a chunk's segments came back changed")
        places = _ranges(chunk.lo[at], n[number])
        gone[places[least[_ranges(first[number], n[number])] < np.repeat(chunk.own[chunk.doc[at]], n[number])]] = True
    begun = np.cumsum(gone, dtype=np.int32)
    covered = begun.copy()
    covered[LENGTH:] -= begun[:-LENGTH]  # windows begun in the last 50 places
    covered = covered > 0
    out = []
    for doc_id, raw, a, b in zip(chunk.ids, chunk.raw, chunk.starts.tolist(), chunk.ends.tolist()):
        own = covered[a:b]
        n = int(own.sum())
        if n:
            edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))
            kept = chunk.bytes[a:b][~own].tobytes()
        else:
            spans, kept = [], raw
        out.append((doc_id, len(raw), n, spans, kept))
    return _digests(out, keep)


def _digests(rows: list, keep: bool) -> pa.Table:
    cols = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "n_bytes": pa.array([r[1] for r in rows], pa.int64()),
        "n_removed": pa.array([r[2] for r in rows], pa.int64()),
        "n_spans": pa.array([len(r[3]) for r in rows], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string()),
    }
    if keep:
        cols["kept"] = pa.array([r[4] for r in rows], pa.binary())
        cols["spans"] = pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table(cols)


def without_repeats(docs: DataFrame, keep: bool = True, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep the kept bytes and
    the removed spans (byte places)."""
    size = total_bytes(docs)
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // bucket_bytes))
    rows = id_text(docs).withColumn("pid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    held = rows.groupBy("pid").applyInArrow(lambda table: _chunk_anchors(table, buckets), "bucket long, pid long, anchors binary")
    shared = held.groupBy("bucket").applyInArrow(_shared_anchors, "bucket long, pid long, anchors binary")
    segments = rows.groupBy("pid").cogroup(shared.groupBy("pid")).applyInArrow(_bound(_chunk_segments, buckets), "bucket long, pid long, anchors binary, sizes binary, least binary, texts binary")
    least = segments.groupBy("bucket").applyInArrow(_bucket_least, "pid long, bucket long, anchors binary, least binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if keep else "")
    return rows.groupBy("pid").cogroup(least.groupBy("pid")).applyInArrow(_bound(_removed, buckets, keep), schema)


def _bound(fn, *more):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right, *more)

    return run
