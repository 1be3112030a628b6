"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions only
near its hits, then validation of checksums that tokens carry.

The prefilter runs over the text's bytes twice: lower-cased for keywords, and mapped to
two classes (hex digit or not), where 24 hex digits are one keyword.  A regular
expression is tried only where a keyword begins.  As every pattern begins with its
keyword and no two keywords of a kind begin at one place, this finds what a leftmost
non-overlapping search of the whole text would.

Base kinds: assign (a keyword, an assignment sign, a value of 6 or more), access (AKIA,
20 or more in all) and hex (24 or more).  Added kinds: github and npm tokens, whose last
six characters are the CRC-32 of the rest in base 62, kept only if it holds; pem, a
private key from its opening line to its closing one, or where another key's line or the
end of the text comes first, over the header and base64 lines that follow.  Spans are in code points, end exclusive, and cover the
whole match.

Defined cases: null and empty texts have no span; a failing match still takes up its
text, as in a search; null ids pass through; repeated rows are each scanned; other columns are
ignored; an empty table gives an empty table; one text is in memory at a time per batch
row, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import by_document, shipped

KINDS = ("assign", "access", "hex", "github", "npm", "pem")
BASE = KINDS[:3]
HEX_LEAST = 24
_WORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "pem": ("-----begin ",)}
_PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "pem": re.compile(rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
}
_MARK = re.compile(rb"-----(?:BEGIN |(END [A-Z ]{0,30}PRIVATE KEY-----)?)")
_NEXT = rb"[\x20\t]*+(?:\r?\n|\r|\\r\\n|\\n)[\x20\t]*+"  # a line's end, as itself or escaped
_LINE = rb"(?:(?:" + _NEXT + rb"|[\x20\t]++)[A-Za-z0-9+/]{24,}+={0,2}+|" + _NEXT + rb"[A-Za-z0-9+/]{1,23}+={0,2}+(?=[\x20\t]*+(?:[\r\n]|\\[rn]|\Z)))"
_BODY = re.compile(rb"(?:(?:" + _NEXT + rb"[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)++(?:" + _NEXT + rb"(?=[\r\n\\]))?)?(?:" + _LINE + rb")++")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CLASSES = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(width, "0")


def checksum_holds(token: bytes) -> bool:
    """Of prefix_ + 30 characters + the CRC-32 of those 30 in base 62."""
    body = token[4:]
    return base62(zlib.crc32(body[:30])) == body[30:].decode("ascii")


@lru_cache(1)
def _automata():
    import ahocorasick

    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keys in _WORDS.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return checksum_holds(m[0])
    return True


def _key_end(raw: bytes, at: int) -> int:
    """Where the private key ends whose opening line ends at `at`."""
    mark = _MARK.search(raw, at)
    if mark and mark[1]:
        return mark.end()
    body = _BODY.match(raw, at)
    return body.end() if body else at


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    if not text:
        return []
    raw = text.encode("utf-8")
    words, runs = _automata()
    found, done = [], dict.fromkeys(KINDS, 0)
    for end, (kind, n) in words.iter(raw.lower().decode("latin-1")):
        at = end + 1 - n
        if at < done[kind] or not (m := _PATTERNS[kind].match(raw, at)):
            continue
        done[kind] = _key_end(raw, m.end()) if kind == "pem" else m.end()
        if _passes(kind, m):
            found.append((at, kind, done[kind]))
    classes = raw.translate(_CLASSES)
    if b"h" * HEX_LEAST in classes:
        for end, n in runs.iter(classes.decode("latin-1")):
            at = end + 1 - n
            if at >= done["hex"]:
                done["hex"] = _PATTERNS["hex"].match(raw, at).end()
                found.append((at, "hex", done["hex"]))
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    if len(raw) != len(text):  # bytes to code points
        marks, at, seen = {}, 0, 0
        for p in sorted({p for s, _, e in found for p in (s, e)}):
            seen += len(raw[at:p].decode("utf-8"))
            at, marks[p] = p, seen
        found = [(marks[s], k, marks[e]) for s, k, e in found]
    return found


def spans_text(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end) of each document."""

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "found": [[{"kind": k, "start": s, "end": e} for s, k, e in scan(t)] for t in texts]}

    return by_document(docs, run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def secret_digests(docs: DataFrame) -> DataFrame:
    def run(ids: list, texts: list) -> dict:
        cols: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in texts:
            found = scan(text)
            kinds = [k for _, k, _ in found]
            base = spans_text([x for x in found if x[1] in BASE])
            for k, v in zip(cols, (*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), spans_text(found))):
                cols[k].append(v)
        return {"doc_id": ids} | cols

    return by_document(docs, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each found span of text replaced by mark (overlapping spans by one)
    and n_chars, where there is such a column, brought up to date; all else stays."""
    from pyspark.sql import functions as F

    shipped(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else cleaned(t, mark))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def cleaned(text: str, mark: str = "[REDACTED]") -> str:
    parts, at = [], 0
    for s, _, e in scan(text):
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]]) if parts else text
