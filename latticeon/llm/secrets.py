"""Secret scans by a trigram inverted index.

Each rule's regular expression is analysed once (``trigram_query``) into a
Boolean query over the trigrams that every match must contain. A batch of texts
is indexed: for each trigram that some rule needs, the postings are a bitmap of
the batch's documents. Evaluating the Boolean queries intersects and unites
postings; only documents that survive are verified with the regular expression.
A rule whose expression has no mandatory trigram scans every text.

Trigrams are taken over the UTF-8 bytes with A-Z lower-cased, so a query is a
superset test for expressions in either case. The work is one pass over the
text column, without a shuffle: an index shard per Arrow batch.

Null text: empty. Empty text: no spans. Repeated rows: each scanned alike.
Matches of one kind never overlap; those of different kinds may.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import to_text, tune

_EXACT_LIMIT = 64
_CLASS_LIMIT = 8
ALL = ("all",)


def _ci(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches; those too short are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 0
    base: bool = False


RULES: tuple[Rule, ...] = (
    Rule("assign", "(" + "|".join(map(_ci, ("password", "passwd", "secret", "token"))) + "|" + _ci("api") + "_?" + _ci("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", "[0-9a-f]+", 0, 16, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 30),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _fold(c: int) -> str:
    return chr(c).lower() if c < 128 else chr(c)


def _trigrams(s: str) -> set[bytes]:
    b = s.encode()
    return {b[i : i + 3] for i in range(len(b) - 2)}


def _and(parts):
    flat = {q for p in parts for q in ((p[1] if p[0] == "and" else [p]) if p != ALL else [])}
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _or(parts):
    flat = {q for p in parts for q in (p[1] if p[0] == "or" else [p])}
    return ALL if not flat or ALL in flat else next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of_exact(strings):
    return _or([_and([("tri", t) for t in _trigrams(s)]) for s in strings])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 3 * _CLASS_LIMIT:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > _CLASS_LIMIT:
            return None
    return out


def _analyse(node):
    """(set of the only possible strings, or None; query that any match fulfils)."""
    exact, query = {""}, ALL

    def flush():
        nonlocal exact, query
        query, exact = _and([query, _of_exact(exact)]), None

    tail: set[str] | None = {""}
    whole = True
    for op, arg in node:
        item: set[str] | None = None
        inner = ALL
        if op is sre.LITERAL:
            item = {_fold(arg)}
        elif op is sre.IN:
            item = _class(arg)
        elif op is sre.SUBPATTERN:
            item, inner = _analyse(arg[3])
        elif op is sre.BRANCH:
            got = [_analyse(b) for b in arg[1]]
            if all(e is not None for e, _ in got):
                item = set().union(*(e for e, _ in got))
            else:
                inner = _or([q if e is None else _of_exact(e) for e, q in got])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            e, q = _analyse(body)
            if e is not None and high == 1:
                item = e | ({""} if low == 0 else set())
            elif low >= 1:
                inner = q if e is None else _of_exact(e)
        elif op is sre.AT:
            item = {""}
        if item is not None and len(item) * len(tail) <= _EXACT_LIMIT:
            tail = {a + b for a in tail for b in item}
            continue
        query = _and([query, _of_exact(tail), inner if item is None else _of_exact(item)])
        tail, whole = {""} if item is None else item, False
    if whole:
        return tail, ALL
    return None, _and([query, _of_exact(tail)])


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; ALL if it has no mandatory trigram."""
    exact, query = _analyse(_parser.parse(pattern))
    return query if exact is None else _of_exact(exact)


def _leaves(query) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*map(_leaves, query[1])) if query[0] in ("and", "or") else set()


class TrigramIndex:
    """Postings, as bitmaps over a batch's documents, of the trigrams that queries need."""

    def __init__(self, queries):
        self.trigrams = sorted(set().union(set(), *map(_leaves, queries)))
        self.number = {t: i for i, t in enumerate(self.trigrams)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.slot[int.from_bytes(t, "big")] = i + 1
        self.low = np.arange(256, dtype=np.uint32)
        self.low[65:91] += 32

    def postings(self, offsets: np.ndarray, data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """offsets: where each text starts in data, and the end. Returns trigram x document."""
        n = len(offsets) - 1
        bits = np.zeros((len(self.trigrams), n), bool)
        first, last = int(offsets[0]), int(offsets[-1])
        for at in range(first, last, piece):
            b = self.low[data[at : min(at + piece + 2, last)]]
            if len(b) < 3:
                continue
            slots = self.slot[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            hits = np.flatnonzero(slots)
            where = hits + at
            doc = np.searchsorted(offsets, where, "right") - 1
            inside = where + 3 <= offsets[doc + 1]
            bits[slots[hits[inside]].astype(np.int64) - 1, doc[inside]] = True
        return bits

    def evaluate(self, query, bits: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(bits.shape[1], bool)
        if query[0] == "tri":
            return bits[self.number[query[1]]]
        parts = [self.evaluate(q, bits) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(self.queries)
        # A greedy run of one class is as well found at its least length: no shorter run is kept.
        self.regexes = [re.compile(r.pattern[:-1] + f"{{{r.min_len},}}" if r.kind == "hex" else r.pattern) for r in rules]

    def spans(self, rule: int, text: str) -> list[tuple[int, int, int]]:
        r = self.rules[rule]
        return [(m.start(), rule, m.end()) for m in self.regexes[rule].finditer(text) if m.end(r.group) - m.start(r.group) >= r.min_len]

    def batch(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        n = len(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        if not n:
            return found
        texts = texts.cast(pa.large_string())
        _, off, buf = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        bits = self.index.postings(offsets, data)
        strings = texts.to_pylist()
        for k, query in enumerate(self.queries):
            for i in np.flatnonzero(self.index.evaluate(query, bits)):
                if strings[i]:
                    found[i] += self.spans(k, strings[i])
        for f in found:
            f.sort()
        return found


_SCANNER: Scanner | None = None


def scanner() -> Scanner:
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


DIGEST = "struct<n_assign:long,n_access:long,n_hex:long,base_sha256:string,spans:string>"


def _digest(texts: pa.Array) -> pa.Array:
    s = scanner()
    kinds, base = [r.kind for r in s.rules], [r.base for r in s.rules]
    cols: list[list] = [[], [], [], [], []]
    for spans in s.batch(texts):
        for k in range(3):
            cols[k].append(sum(1 for x in spans if x[1] == k))
        own = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans if base[k]]
        cols[3].append(hashlib.sha256(",".join(own).encode()).hexdigest())
        cols[4].append(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))
    types = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _spans(texts: pa.Array) -> pa.Array:
    s = scanner()
    return pa.array([[{"kind": s.rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in s.batch(texts)], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def secret_spans(text: str = "text") -> Column:
    """The general operator: array of {kind, start, end} in code points, ends exclusive."""

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def secret_spans_(t: pa.Array) -> pa.Array:
        return _spans(t)

    return secret_spans_(to_text(text))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each input row."""

    @F.arrow_udf(DIGEST)
    def scan(t: pa.Array) -> pa.Array:
        return _digest(t)

    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), scan(to_text(text)).alias("r")).select("doc_id", "r.*")
