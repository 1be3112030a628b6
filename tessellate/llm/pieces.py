"""SentencePiece encoding and decoding by weighted finite-state transducers.

Normaliser, pieces and byte fallback are compiled into one transducer over the characters
of raw texts.  The normaliser (space to U+2581, one in front) is composed into the arcs: an
arc that reads U+2581 also reads a space, and the one in front is an arc that reads
nothing.  Pieces are the paths of a trie; arcs that lead from each node to where its longest
suffix goes on let one pass over a text meet every piece that ends at each place.  A character
that is no piece is read by an arc that emits its bytes.

Each input is composed with it, and the shortest path of the tropical semiring (costs add up
along a path, the least counts) gives the pieces: place by place, the least of the costs to
where an arriving arc begins plus the arc's own.

Unigram models: an arc costs minus its piece's log probability, so the shortest path is
the model's segmentation.  BPE models: merging is not a sum of costs, but it is regular.
A sequence of pieces is what the merges make if and only if this holds of each
two neighbours alone, so the transducer's states remember the last piece and an arc costs
nothing if the pair is stable under the merges and infinity otherwise.  The pieces of a text's
beginning are what the merges make of it, so exactly one arc to each place is finite, and the
first found is the least.  A pair is stable if nothing merges across its boundary while both
sides grow, which is read off the merges that made each; stable pairs are remembered.

If no piece has U+2581 after another character, no path crosses from one such chunk to
the next but at a state that any arc can leave, so chunks are composed one by one and
remembered (a bounded number of at most LONGEST characters).

Defined cases: null and empty texts have no pieces; a literal U+2581 reads as a space, as
in the library; runs without spaces take time in proportion to length; repeated rows are each
encoded; null ids pass through; other columns are ignored; an empty table gives an empty
table.  Models with a character map or user-defined symbols are refused.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import Remembered, by_document, shipped

SPACE = "▁"
CACHE = 1 << 16  # chunks that a worker remembers (and as many older ones), and pairs
PAIRS = 1 << 18
ROOM = 1 << 18  # arcs of suffixes that are kept
UNK_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_INF = float("inf")


class Arcs(dict):
    """The arcs of a node by character; one that has no arc of its own for it goes where its
    longest suffix goes, which is kept while there is room."""

    __slots__ = ("back", "room")

    def __missing__(self, c):
        to = 0 if self.back is None else self.back[c]
        if self.room[0]:
            self.room[0] -= 1
            self[c] = to
        return to


class Transducer:
    def __init__(self, path: str, remembered: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or any(p.type == USER for p in model.pieces):
            raise NotImplementedError("character maps and user-defined symbols")
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.merges = model.trainer_spec.model_type == 2
        if not self.merges and model.trainer_spec.model_type != 1:
            raise NotImplementedError("only unigram and BPE models")
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.worst = min(self.score.values()) - UNK_PENALTY
        if self.merges and any(c not in self.ids for piece in self.ids for c in piece):
            raise NotImplementedError("pieces with characters that are no pieces")
        self._compile()
        whole = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        gap, word = f"[ {SPACE}]", f"[^ {SPACE}]"
        self.chunks = re.compile(f"{word}+" if self.squeeze else "(?s:.+)" if whole else f"{gap}*{word}+|{gap}+")
        self.whole = whole
        self.pairs = 0  # remembered in the arcs
        self.spines: dict[int, tuple] = {}
        self.known = Remembered(remembered)
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.out = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(self.names, self.kinds)]

    def _compile(self) -> None:
        """Nodes of the machine: arcs by character, where to go on if none fits (the node of the
        longest proper suffix), and the arcs that end there, longest first: (characters, piece,
        pieces it is known to be stable after, pieces it is known not to be)."""
        self.sizes = list(map(len, self.names))
        self.arriving = [(n, i, set(), set()) for i, n in enumerate(self.sizes)]
        self.arcs: list[dict] = [{}]
        own = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                if c not in self.arcs[node]:
                    self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    own.append(-1)
                node = self.arcs[node][c]
            own[node] = i
        self.back, self.ends = [0] * len(self.arcs), [()] * len(self.arcs)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, to in self.arcs[node].items():
                    at = self.back[node]
                    while at and c not in self.arcs[at]:
                        at = self.back[at]
                    self.back[to] = at = self.arcs[at].get(c, 0) if node else 0
                    self.ends[to] = (self.arriving[own[to]], *self.ends[at]) if own[to] >= 0 else self.ends[at]
                    below.append(to)
            level = below
        for arcs in self.arcs:  # the normaliser
            if SPACE in arcs:
                arcs[" "] = arcs[SPACE]
        room, self.arcs = [ROOM], [Arcs(x) for x in self.arcs]
        for node, arcs in enumerate(self.arcs):
            arcs.back, arcs.room = self.arcs[self.back[node]] if node else None, room

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: best score first, then leftmost."""
        part = list(text)
        while True:
            best, at = -_INF, -1
            for i in range(len(part) - 1):
                s = self.score.get(part[i] + part[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]

    def spine(self, piece: int) -> tuple:
        """Of the merges that make a piece by itself: what its last character belongs to from merge
        to merge, and likewise its first, each with its score; None if they don't make it, or
        if a merge has a better score than one before it."""
        got = self.spines.get(piece)
        if got is None:
            part = list(self.names[piece])
            right, left, before, sound = [(part[-1], _INF)], [(part[0], _INF)], _INF, True
            while len(part) > 1:
                scores = [self.score.get(x + y, -_INF) for x, y in zip(part, part[1:])]
                best = max(scores)
                if best == -_INF or best > before:
                    sound = False
                    break
                before, at = best, scores.index(best)
                part[at : at + 2] = [part[at] + part[at + 1]]
                if part[-1] != right[-1][0]:
                    right.append((part[-1], best))
                if part[0] != left[-1][0]:
                    left.append((part[0], best))
            got = self.spines[piece] = (right, left) if sound else (None, None)
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether the merges leave pieces a and b as they are, side by side.  a: -1 at the start
        of a path or after bytes, where nothing can merge."""
        _, _, yes, no = self.arriving[b]
        if a not in yes and a not in no:
            if self.pairs >= PAIRS:
                for _, _, *sets in self.arriving:
                    for x in sets:
                        x.clear()
                self.pairs = 0
            self.pairs += 1
            (yes if self._apart(a, b) else no).add(a)
        return a in yes

    def _apart(self, a: int, b: int) -> bool:
        left = self.spine(b)[1]
        if a < 0 or left is None:
            return a < 0 and left is not None or self.merged(("" if a < 0 else self.names[a]) + self.names[b]) == [self.names[x] for x in (a, b) if x >= 0]
        right = self.spine(a)[0]
        if right is None:
            return self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        i = j = 0
        while True:
            of_a = right[i + 1][1] if i + 1 < len(right) else -_INF
            of_b = left[j + 1][1] if j + 1 < len(left) else -_INF
            across = self.score.get(right[i][0] + left[j][0])
            if across is not None and across > of_a and across >= of_b:  # of equal merges the leftmost is first
                return False
            if of_a == of_b == -_INF:
                return True
            if of_a >= of_b:
                i += 1
            else:
                j += 1

    def shortest(self, text: str) -> list[int]:
        """The pieces on the shortest path that reads text."""
        last = (self._stable_path if self.merges else self._least_path)(text)
        out: list[int] = []
        sizes, j = self.sizes, len(text)
        while j:
            p = last[j]
            if p >= 0:
                out.append(p)
                j -= sizes[p]
            else:
                j -= 1
                out += self._fallback(SPACE if text[j] == " " else text[j])[::-1]
        out.reverse()
        return out

    def _stable_path(self, text: str) -> list[int]:
        """For each place the piece that arrives there at finite cost (-1: bytes)."""
        arcs, ends, stable = self.arcs, self.ends, self.stable
        last, node = [-1], 0
        for c in text:
            node = arcs[node][c]
            for size, p, yes, no in ends[node]:
                q = last[-size]  # where the arc begins
                if q in yes or (q not in no and stable(q, p)):
                    last.append(p)
                    break
            else:
                last.append(-1)
        return last

    def _least_path(self, text: str) -> list[int]:
        """For each place the piece of the arc on its path of least cost (-1: bytes)."""
        cost, last, node = [0.0], [-1], 0
        for c in text:
            node = self.arcs[node][c]
            least, by, plain = _INF, -1, False
            for size, p, _, _ in self.ends[node]:
                plain |= size == 1
                if (w := cost[-size] - self.score[self.names[p]]) <= least:  # of equal paths that of shorter pieces
                    least, by = w, p
            if not plain and (w := cost[-1] - self.worst) < least:
                least, by = w, -1
            cost.append(least)
            last.append(by)
        return last

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unknown]

    def composed(self, text: str) -> list[str]:
        """The chunks of a raw text that the machine reads one by one, with the normaliser's space
        in front."""
        if not self.squeeze:
            return self.chunks.findall(" " + text if self.prefix else text)
        words = self.chunks.findall(text)
        out = [f" {w}" for w in words]
        if out and not self.prefix:
            out[0] = words[0]
        return ["".join(out)] if self.whole and out else out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = self.composed(text)
        got = list(map(self.known.get, chunks))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    c = chunks[i]
                    if (x := self.known.get(c)) is None and (x := self.known.older(c)) is None:
                        x = array("i", self.shortest(c)).tobytes()
                        self.known.put(c, x)
                    got[i] = x
        return np.frombuffer(b"".join(got), np.int32)

    def decode(self, ids) -> str:
        """Texts of the pieces; bytes that are no UTF-8 become U+FFFD one by one."""
        ids = np.asarray(ids, np.int32)
        if not len(ids):
            return ""
        out, raw = self.out, self.is_byte[ids].any()
        ids = ids.tolist()
        if raw:
            parts, run = [], b""
            for i in ids:
                if self.kinds[i] == BYTE:
                    run += bytes((int(self.names[i][3:5], 16),))
                else:
                    if run:
                        parts.append(_lenient(run))
                        run = b""
                    parts.append(out[i].decode("utf-8"))
            text = "".join([*parts, _lenient(run)])
        else:
            text = b"".join(map(out.__getitem__, ids)).decode("utf-8")
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.names[first].startswith(SPACE) else text


def _lenient(run: bytes) -> str:
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(2)
def transducer(path: str, remembered: int = CACHE) -> Transducer:
    return Transducer(path, remembered)


def encode_documents(docs: DataFrame, path: str, remembered: int = CACHE) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces (array of ids), round_trip (whether decoding
    gives the text back, spaces for U+2581).  path: the model file, the same on every
    executor; remembered: chunks that a worker remembers (about 250 bytes each, and as many
    older ones)."""

    def run(ids: list, texts: list) -> dict:
        t = transducer(path, remembered)
        pieces = [t.encode(x) for x in texts]
        back = [t.decode(p) == (x or "").replace(SPACE, " ") for p, x in zip(pieces, texts)]
        return {"doc_id": ids, "n_bytes": [len((x or "").encode("utf-8")) for x in texts], "n_pieces": [len(p) for p in pieces], "pieces": pieces, "round_trip": back}

    return by_document(docs, run, "doc_id long, n_bytes long, n_pieces long, pieces array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of doc_id and pieces; null pieces give an empty text."""
    from pyspark.sql import functions as F

    shipped(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(pieces):
        t = transducer(path)
        return pieces.map(lambda p: "" if p is None else t.decode(p))

    return encoded.select("doc_id", text("pieces").alias("text"))
