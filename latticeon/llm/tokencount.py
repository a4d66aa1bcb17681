"""Token counts of byte-level BPE by heap-and-linked-list merging.

``merge_count`` holds a pre-token's symbols in a doubly linked list and all
adjacent mergeable pairs in a heap ordered by (rank, place); the lowest is
popped, checked to be still current, merged, and its new neighbours are pushed.
The count is initial symbols minus merges; identifiers are never emitted.

A text is cut at the vocabulary's special strings (each one token), then into
pieces of an optional blank and a run of non-space, whose pre-tokens don't
depend on their surroundings; counts of pieces and pre-tokens are remembered in
bounded caches. One pass over the text column, no shuffle. Null text: empty,
no tokens.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, to_text, tune

MODEL = "byte_bpe_50k.json"
LIMIT = 512
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters on which the two libraries' notions of white space differ.
_ODD = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The printable stand-ins of the 256 bytes in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class TokenCounter:
    def __init__(self, path: str, cache: int = 600_000):
        model = json.load(open(path, encoding="utf-8"))
        vocab = model["model"]["vocab"]
        self.first = [vocab[c] for c in byte_chars()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = BoundedCache(self.merge_count, cache)
        self.pieces = BoundedCache(lambda p: sum(map(self.tokens.__getitem__, _PATTERN.findall(p))), cache)

    def merge_count(self, token: str) -> int:
        data = token.encode()
        n = left = len(data)
        first, rank_of, made = self.first, self.ranks.get, self.made
        sym = [first[b] for b in data]
        # pair[i]: rank of the current pair that begins at i, or -1; heap entries that differ are stale.
        pair = [rank_of(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = heappop(heap)
            i, r = e & 0xFFFFFFFF, e >> 32
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            s = sym[i] = made[r]
            pair[j] = -1
            left -= 1
            if k < n:
                before[k] = i
                r = pair[i] = rank_of(s << 20 | sym[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = rank_of(sym[h] << 20 | s, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return left

    def _plain(self, text: str) -> int:
        if _ODD.search(text):
            return sum(map(self.tokens.__getitem__, _PATTERN.findall(text)))
        return sum(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each input row. path must exist on every executor."""

    @F.arrow_udf("long")
    def count(t: pa.Array) -> pa.Array:
        of = counter(path).count
        return pa.array([of(x.as_py()) for x in t], pa.int64())

    tune(docs.sparkSession)
    t = to_text(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), count(t).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
