"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are split into BLOCKS blocks.  Two fingerprints that differ in at
most `distance` bits agree on at least BLOCKS - distance blocks, so they share one of the
keys made of that many blocks: joining on those keys and verifying the Hamming distance
misses no pair.  With 6 blocks and distance 3 a key has about 32 bits.

Copies count once: distinct fingerprints are joined.  Of each group that shares a key only
the edges of a spanning forest are emitted, each from a node to the smallest one of its tree:
linear in the group, and no link between components is lost.  A key shared by over TILE
fingerprints is first compared with its smallest one, the pivot.  What is within the distance
d of the pivot is linked to it and thereby done; by the triangle inequality only what lies
within 2d of the pivot can be linked to those, and it is compared with them in cells of
TILE by TILE; what is left is compared with itself in such cells.  So a group of copies costs
one row for each, and no task holds an unbounded group.

The keys of a few blocks are joined first, and their stars taken; of the other keys only those
are read whose nodes are not yet all in one star, and only edges between stars are emitted.  So a large group of copies is settled by a few of its keys.

Components come from alternating large-star and small-star rounds over tables in the shared
folder, after two rounds without a join that leave about one edge for each node: a node has
at most one smaller neighbour for each key and cell, so a window over those is bounded.

Groups are sorted before they are read, so edges do not depend on the order of arrival, and
what is made again after an executor is lost is equal.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; rows with the same doc_id are judged each by its own text, so one id may be in
several components; a row without doc_id has a fingerprint, and its component_id is the
smallest id reachable, null if there is none; other columns are ignored; an empty table
gives an empty table; long texts are hashed whole, BATCH shingles at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FEW, by_document, dropped, id_text, sized, stored

SEED = 42
SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
TILE = 4096
NUMBER = 54  # bits of a key below the number of its choice of blocks (of 512 at most)
BATCH = 1 << 17  # shingles hashed at once


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64 bits; a bit is set if it is in over half of the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")  # one shingle: its bits
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), BATCH):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[k : k + BATCH].tolist(), ends[k : k + BATCH].tolist())])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(ids: list, texts: list) -> dict:
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": fps}

    return by_document(docs, run, "doc_id long, fp long")


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """A mask for each choice of blocks that a close pair may agree on, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(label, root) of each tree of a spanning forest of the links among rows (ids: labels,
    ascending; fps: rows of words); its root is the tree's smallest label."""
    out = []
    while len(ids):
        root, queue, ids, fps = ids[0], [fps[0]], ids[1:], fps[1:]
        while queue and len(ids):
            near = _differing(fps, queue.pop()) <= distance
            if near.any():
                out += [(i, root) for i in ids[near]]
                queue += list(fps[near])
                ids, fps = ids[~near], fps[~near]
    return out


def _differing(fps: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ other).sum(1, dtype=np.int32)


def _across(ids: np.ndarray, fps: np.ndarray, linked: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """For each row that isn't `linked` an edge to the first linked row within the distance."""
    done, out = fps[linked], []
    for i, x in zip(ids[~linked], fps[~linked]) if linked.any() else ():
        near = _differing(done, x) <= distance
        if near.any():
            out.append((i, ids[linked][near.argmax()]))
    return out


KEYS = ("key", "i", "j")  # a group's key and the cell in it; i is -1 - its row where done ones are met


def _groups(distance: int):
    """Over batches of (key, i, j, linked, label, words of a fingerprint ...) sorted by those
    up to label: the edges of each cell, between labels."""

    def edges(table: pa.Table):
        cols = [table.column(i).to_numpy(zero_copy_only=False) for i in range(table.num_columns)]
        rows, linked, ids, fps = cols[1], cols[3], cols[4], np.stack(cols[5:], 1).view(np.uint64)  # signed words would count bits of absolute values
        new = np.ones(len(ids), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in cols[:3]])
        at = np.nonzero(new)[0]
        size = np.diff(np.append(at, len(ids)))
        plain = (size == 2) & (rows[at] >= 0)
        two = at[plain]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1, dtype=np.int32) <= distance]
        us, vs = [ids[near + 1]], [ids[near]]
        for s, n in zip(at[(size > 1) & ~plain], size[(size > 1) & ~plain]):
            part = slice(s, s + n)
            found = _forest(ids[part], fps[part], distance) if rows[s] >= 0 else _across(ids[part], fps[part], linked[part], distance)
            us.append(np.array([x for x, _ in found], np.int64))
            vs.append(np.array([y for _, y in found], np.int64))
        u, v = np.concatenate(us), np.concatenate(vs)
        u, v = u[u != v], v[u != v]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            keys = [table.column(i).to_numpy() for i in range(3)]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
            rest = table.slice(cut)
            if cut:
                yield edges(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return run


def _dealt(rest: DataFrame, linked: DataFrame, key: str, size: Column, tile: int) -> DataFrame:
    """Cells of what is left of the groups: rest (key, node, near) against itself, and its near
    rows against `linked` (key, node).  `size` weighs a row; a cell holds about 2 * tile of it.
    Each side is dealt in ceil(weight / tile) chunks by a hash of the node."""
    chunks = lambda df, name: df.groupBy(key).agg(F.ceil(F.sum(size) / F.lit(tile)).cast("int").alias(name))
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    more = [c for c in rest.columns if c not in (key, "node", "near")]
    own = rest.join(chunks(rest, "t"), key).withColumn("own", chunk("t")).withColumn("other", every("t"))
    own = own.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(False).alias("linked"), "node", *more)
    near = rest.where("near")
    of_near, of_linked = chunks(near, "t"), chunks(linked.join(near.select(key).distinct(), key, "left_semi"), "d")
    left = near.join(of_near, key).join(of_linked, key).select(key, (-1 - chunk("t")).alias("i"), every("d").alias("j"), F.lit(False).alias("linked"), "node", *more)
    right = linked.join(of_near, key).join(of_linked, key).select(key, chunk("d").alias("j"), every("t").alias("i"), "node", *more)
    right = right.select(key, (-1 - F.col("i")).alias("i"), "j", F.lit(True).alias("linked"), "node", *more)
    return own.unionByName(left).unionByName(right)


def links(met: DataFrame, words: DataFrame, distance: int, tile: int = TILE, labels: DataFrame | None = None) -> DataFrame:
    """(u, v), u > v: spanning edges of the links among nodes that share a key.  met: key and
    node; words: node and the words of its fingerprint.  With labels (node, comp), each
    the smallest node known to be of a node's component, edges are between labels, and keys
    of a single one are left out."""
    names = [x for x in words.columns if x != "node"]
    known = labels is not None
    if known:
        met = met.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("label"))
    else:
        met = met.withColumn("label", F.col("node"))
    keys = met.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("label", "node"))["node"].alias("pivot"))
    keys = stored(keys.where("lo < hi"), "keys")
    cells = met.join(keys.where(F.col("n") <= tile).select("key"), "key").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("linked"), "node", "label")
    hot, direct = keys.where(F.col("n") > tile), None
    if not hot.isEmpty():
        pivots = hot.join(words.withColumnRenamed("node", "pivot"), "pivot").select("key", "pivot", "lo", *(F.col(x).alias(f"p{x}") for x in names))
        far = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"p{x}"))) for x in names), F.lit(0)).cast("int")
        each = met.join(pivots, "key").join(words, "node").withColumn("far", far).withColumn("done", (F.col("far") <= distance) | (F.col("label") == F.col("lo")))
        each = stored(each.where("node <> pivot OR done").select("key", "node", "label", "lo", "far", "done"), "hot")
        direct = each.where((F.col("far") <= distance) & (F.col("label") > F.col("lo"))).select(F.col("label").alias("u"), F.col("lo").alias("v"))
        # what is done by its label alone may lie anywhere, so all that is left is near it
        near = F.lit(True) if known else F.col("far") <= 2 * distance
        cells = cells.unionByName(_dealt(each.where("NOT done").select("key", "node", "label", near.alias("near")), each.where("done").select("key", "node", "label"), "key", F.lit(1), tile))
    cells = cells.join(words, "node").select(*KEYS, "linked", "label", *names)
    cells = cells.repartition(*KEYS).sortWithinPartitions(*KEYS, "linked", "label")
    found = cells.mapInArrow(_groups(distance), "u long, v long")
    return (found if direct is None else found.union(direct)).distinct()


EARLY = 6  # blocks whose keys are joined first


def clusters(keyed: DataFrame, words: DataFrame, distance: int, early: Column, tile: int = TILE) -> DataFrame:
    """(node, comp): the smallest node reachable by links among nodes that share a key, for the
    nodes that have any.  keyed: key and node; early: whether a key is joined first."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stored(keyed.join(shared, "key").select("key", "node"), "met")
    now = stored(_starred(thinned(links(met.where(early), words, distance, tile))), "edges")
    first = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))  # of one component, if not yet the whole
    later = links(met.where(~early), words, distance, tile, first)
    return components(now.union(later))


def block_keys(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """keyed for clusters(), of nodes with 64-bit fingerprints fp: a row for each choice of
    blocks.  A key is a hash with the number of the choice on top."""
    masks = block_masks(distance, blocks)
    keys = F.array(*(F.shiftrightunsigned(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m))), 10).bitwiseOR(F.lit(i << NUMBER)) for i, m in enumerate(masks)))
    return nodes.select("node", F.explode(keys).alias("key"))


def thinned(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (u, v), u > v, of the same components and about as many as nodes: each round ties
    a node's smaller neighbours to the smallest of them.  No join; a node's window holds its
    smaller neighbours only, of which links() makes one for each key and cell."""
    for _ in range(rounds):
        least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        both = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = both.select("e.u", "e.v").where("u > v").distinct()
    return edges


def _starred(now: DataFrame) -> DataFrame:
    """Edges after a large-star and a small-star round."""
    both = now.union(now.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))  # small star: u > v holds
    each = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return large.join(least, "u").select(each.alias("e")).select("e.u", "e.v").where("u > v").distinct()


def _is_starred(now: DataFrame) -> bool:
    """Whether each node is either a centre or has one neighbour, which is a centre."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for the nodes that edges (u > v) have."""
    now = stored(thinned(edges.select("u", "v").where("u <> v")), "edges")
    while not _is_starred(now):
        old, now = now, stored(_starred(now), "edges")
        dropped(old)
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.union(pairs.select("comp", "comp").distinct())


def linked(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """fps (doc_id, fp) with component_id, the smallest doc_id reachable.  Nodes are fingerprints,
    so rows that share an id and differ in text stay apart."""
    nodes = fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"))
    found = clusters(block_keys(nodes.withColumn("fp", F.col("node")), distance, blocks), nodes.select("node", F.col("node").alias("w0")), distance, F.col("key") < EARLY << NUMBER, tile)
    found = stored(nodes.join(found, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "nodes")
    names = found.groupBy("comp").agg(F.min("least").alias("component_id"))
    return fps.join(found.join(names, "comp").select(F.col("node").alias("fp"), "component_id"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    found = linked(stored(fingerprints(docs), "fingerprints"), distance, blocks)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The XXH64 of each distinct shingle, ascending; a shorter text is one shingle, and one
    without words has none."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    w = min(width, len(words))
    starts, ends = (ends - size)[: len(words) - w + 1], ends[w - 1 :]
    return np.unique(np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]), "<u8"))


_FIELDS = tuple(np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F))


def _added(rows: np.ndarray, field: int, times: int) -> list[np.ndarray]:
    """The even and the odd fields (1 << field bits) of rows of words, each widened to twice the
    bits and added up over `times` rows at a time, as many as can't overflow."""
    n, out = -(-len(rows) // times), []
    for shift in (0, 1 << field):
        part = (rows >> np.uint64(shift)) & _FIELDS[field]
        total = part[:n].copy()
        for k in range(1, times):
            more = part[k * n : (k + 1) * n]
            total[: len(more)] += more
        out.append(total)
    return out


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit set.  Bits come in the order of the fields."""
    out = []
    for pairs in _added(rows, 0, 3):
        for nibbles in _added(pairs, 1, 5):
            for shift in (0, 4):
                part = (nibbles >> np.uint64(shift)) & _FIELDS[2]
                out.append(sum(part[k : k + 17].sum(0, dtype=np.uint64).view(np.uint8).astype(np.int64) for k in range(0, len(part), 17)))
    return np.concatenate(out)


def wide_fingerprint(hashes: np.ndarray, bits: int = 3456) -> bytes:
    """As fingerprint(), of a set of shingles, over bits made from each XXH64 by a mixing step."""
    salt = np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    counts = np.zeros(bits, np.int64)
    for k in range(0, len(hashes), 1020):
        z = hashes[k : k + 1020, None] * salt
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        counts += bit_counts(z)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def allowed_bits(similarity: float, bits: int, deviations: float = 6) -> int:
    """Bits that fingerprints of sets of that Jaccard similarity differ in, on average, and
    some standard deviations more: a filter only, as the sets are compared after it."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def _common(flat: np.ndarray, sizes: np.ndarray, members: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many of `members` each of the sets laid end to end in flat has."""
    mark[members] = True
    out = np.add.reduceat(mark[flat], np.cumsum(sizes) - sizes, dtype=np.int64)
    mark[members] = False
    return out


def exact_forest(nodes: np.ndarray, sizes: np.ndarray, flat: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """As _forest(), among sets of that Jaccard similarity and more.  nodes: ascending; flat:
    the members of all sets, one after the other."""
    out = []
    flat = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    while len(nodes):
        root, queue = nodes[0], [flat[: sizes[0]]]
        nodes, flat, sizes = nodes[1:], flat[sizes[0] :], sizes[1:]
        while queue and len(nodes):
            members = queue.pop()
            common = _common(flat, sizes, members, mark)
            near = common / (sizes + len(members) - common) >= similarity
            if near.any():
                queue += np.split(flat[np.repeat(near, sizes)], np.cumsum(sizes[near])[:-1])
                out += [(v, root) for v in nodes[near]]
                nodes, flat, sizes = nodes[~near], flat[np.repeat(~near, sizes)], sizes[~near]
    return out


def exact_across(nodes: np.ndarray, sizes: np.ndarray, flat: np.ndarray, linked: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """As _across(), among sets."""
    out = []
    if linked.any() and not linked.all():
        flat = np.unique(flat, return_inverse=True)[1]
        mark = np.zeros(int(flat.max()) + 1, bool)
        done, n, ids = flat[np.repeat(linked, sizes)], sizes[linked], nodes[linked]
        ends = np.cumsum(sizes)
        for k in np.nonzero(~linked)[0]:
            common = _common(done, n, flat[ends[k] - sizes[k] : ends[k]], mark)
            near = common / (n + sizes[k] - common) >= similarity
            if near.any():
                out.append((nodes[k], ids[near.argmax()]))
    return out


def _exact_groups(similarity: float):
    """Over batches of (comp, i, j, linked, node, set) sorted by those up to node: edges of each cell."""

    def edges(across: bool, linked: list, nodes: list, sets: list) -> pa.RecordBatch:
        parts = np.array(nodes, np.int64), np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
        found = exact_across(*parts, np.array(linked), similarity) if across else exact_forest(*parts, similarity)
        u, v = (np.array([e[x] for e in found], np.int64) for x in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches):
        at, held = None, ([], [], [])
        for batch in batches:
            keys = zip(*(batch.column(x).to_pylist() for x in range(3)))
            for key, linked, node, members in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if key != at and held[0]:
                    yield edges(at[1] < 0, *held)
                    held = ([], [], [])
                at = key
                for x, value in zip(held, (linked, node, np.frombuffer(members.as_py(), "<u8"))):
                    x.append(value)
        if held[0]:
            yield edges(at[1] < 0, *held)

    return run


def _jaccard(batches):
    """(node, comp, size, alike) of (node, comp, set, the component's smallest node's set)."""
    for batch in batches:
        sizes, alike = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(z.as_py() or b"", "<u8") for z in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            sizes.append(len(x))
            alike.append(common / max(len(x) + len(y) - common, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(alike, pa.float64())], names=["node", "comp", "size", "alike"])


def exact_links(groups: DataFrame, sets: DataFrame, similarity: float, tile: int = 1 << 20) -> DataFrame:
    """(u, v), u > v: spanning edges of the links of that Jaccard similarity and more among the
    nodes of a group.  groups: node and comp, its smallest node; sets: node, members (8 bytes
    each).  Each node is compared with its group's smallest one, the pivot; only what
    isn't linked to it goes on to cells, as in links(), of about 2 * tile members each.  The
    Jaccard distance is a metric too."""
    sets = sets.where("length(members) > 0")
    pivot = groups.where("node = comp").join(sets, "node").select("comp", F.col("members").alias("other"))
    pairs = groups.where("node <> comp").join(sets, "node").join(pivot, "comp", "left").select("node", "comp", "members", "other")
    judged = stored(pairs.mapInArrow(_jaccard, "node long, comp long, size long, alike double"), "judged")
    done, rest = judged.where(F.col("alike") >= similarity), judged.where(F.col("alike") < similarity)
    direct = done.select(F.col("node").alias("u"), F.col("comp").alias("v"))
    near = F.col("alike") >= 2 * similarity - 1 - 1e-9
    # a group whose one other node is neither linked nor near to anything has no more pairs
    more = rest.groupBy("comp").agg(F.count("*").alias("n"), F.max(near).alias("near")).where("n > 1 OR near").select("comp")
    rest = rest.join(more, "comp", "left_semi").select("comp", "node", "size", near.alias("near"))
    if rest.isEmpty():
        return direct
    cells = _dealt(rest, done.select("comp", "node", "size"), "comp", F.col("size"), tile)
    cells = cells.join(sets, "node").select("comp", "i", "j", "linked", "node", "members")
    cells = cells.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "linked", "node")
    return cells.mapInArrow(_exact_groups(similarity), "u long, v long").union(direct).distinct()


def text_hash(text: str | Column = "text") -> Column:
    """The signed XXH64 of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5, bits: int = 3456, block: int = 24, verified: int = 512, few: int = FEW) -> DataFrame:
    """doc_id, mark (text_hash()) and comp of each row: rows share comp if a chain of pairs
    of that Jaccard similarity of their shingle sets links them.

    Nodes are distinct shingle sets.  At a similarity of 0.8 some 15 % of the bits differ,
    which 64 bits can't tell apart by blocks.  A fingerprint of 3456 bits split into 144 blocks
    of 24 bits shares one for sure if it differs in up to 143 bits, and with a chance of
    1 - (1 - 0.85^24)^144 = 95 % at the very threshold, 99 % at 0.84 and 99.9 % at 0.86; the
    first `verified` bits, with six standard deviations allowed, then sort out most others.
    Unrelated fingerprints meet in a block with a chance of 2^-24.  What is left are groups
    of candidates: their texts are read again and judged by their sets themselves.

    block: whole bytes.  An empty table gives an empty table."""
    step = block // 8
    n_blocks, n_words = bits // block, verified // 64
    kind = "int32" if n_blocks << block <= 1 << 32 else "int64"  # unsigned

    def run(ids: list, texts: list) -> dict:
        import xxhash

        sets = [shingle_set(t, width) for t in texts]
        raw = np.frombuffer(b"".join(wide_fingerprint(s, bits) for s in sets), np.uint8).reshape(len(sets), bits // 8)
        cut = raw[:, : n_blocks * step].reshape(len(sets), n_blocks, step)
        keys = np.arange(n_blocks, dtype=np.int64) << block  # the block's number above what it holds
        for k in range(step):
            keys = keys | (cut[:, :, k].astype(np.int64) << (8 * k))
        words = np.ascontiguousarray(raw[:, : 8 * n_words]).view("<i8")
        signed = lambda values: np.fromiter(values, np.uint64, len(texts)).view(np.int64)
        return {"doc_id": ids, "mark": signed(xxhash.xxh64_intdigest(t or "", 42) for t in texts), "node": signed(xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), "keys": list(keys.astype(kind)), "words": list(words)}

    def members(nodes: list, texts: list) -> dict:
        return {"node": nodes, "members": [shingle_set(t, width).tobytes() for t in texts]}

    wide = stored(by_document(docs, run, f"doc_id long, mark long, node long, keys array<{'int' if kind == 'int32' else 'long'}>, words array<long>"), "wide")
    rows = stored(wide.select("doc_id", "mark", "node"), "rows")
    nodes = stored(wide.groupBy("node").agg(F.first("keys").alias("keys"), F.first("words").alias("words")), "nodes")
    dropped(wide)
    words_of = nodes.select("node", *(F.col("words")[i].alias(f"w{i}") for i in range(n_words)))
    loose = stored(clusters(nodes.select("node", F.explode("keys").alias("key")), words_of, allowed_bits(similarity, verified), F.shiftrightunsigned("key", block) < EARLY), "groups")
    one = stored(rows.join(loose.select("node"), "node").groupBy("node").agg(F.min(F.struct("mark", "doc_id")).alias("row")), "wanted")
    one = sized(one, few)
    texts = id_text(docs).withColumn("mark", text_hash()).withColumnRenamed("doc_id", "id")
    met = texts.join(one, (F.col("mark") == F.col("row.mark")) & F.col("id").eqNullSafe(F.col("row.doc_id")))
    sets = by_document(met.select(F.col("node").alias("doc_id"), "text").groupBy("doc_id").agg(F.first("text").alias("text")), members, "node long, members binary")
    found = components(exact_links(loose, stored(sets, "sets"), similarity))
    return rows.select("doc_id", "mark", "node").join(found, "node", "left").select("doc_id", "mark", F.coalesce("comp", "node").alias("comp"))


def without_similar(docs: DataFrame, few: int = FEW, **more) -> DataFrame:
    """One row of docs, all columns, of each group that similar_rows() links: that of the smallest
    doc_id, one without doc_id if none has any.  Of rows equal in doc_id and text one stays,
    chosen by a hash of all its columns.  Only ids and hashes are grouped; texts are moved only
    where what goes is too much to be sent to all tasks."""
    rows = stored(similar_rows(docs, few=few, **more), "linked")
    pairs = rows.groupBy("comp", "doc_id", "mark").agg(F.count("*").alias("times"))
    least = pairs.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "mark")).alias("least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    gone = pairs.join(least, "comp").where(~stays | (F.col("times") > 1))
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), stays.alias("again")), "gone")
    # packed, so that no column of docs can clash with ours
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    out = packed.join(sized(gone, few), same, "left_anti")
    again = gone.where("again")
    if not again.isEmpty():
        one = packed.join(sized(again, few), same, "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.unionByName(one)
    return out.select("row.*")


def similar_documents(docs: DataFrame, similarity: float = 0.8, **more) -> DataFrame:
    """doc_id, component_id: the smallest doc_id of the rows that similar_rows() links."""
    rows = stored(similar_rows(docs, similarity, **more), "linked")
    names = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "comp").select("doc_id", "component_id")
