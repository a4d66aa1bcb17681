"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Sequences of equal composition are interchangeable, so the packer works on the
histogram of piece lengths, which has at most ``capacity`` entries however many
documents there are. ``plan`` fills a bin greedily (longest piece that fits,
again and again), then replaces its smallest piece with two unpacked pieces that
fit the expanded gap more tightly, and repeats the resulting composition as often as the
histogram allows. The plan has a few entries per length.

Spark tokenises once (kept in the shared folder), counts lengths per salt, and
gives every piece its number among those of its length: a running number within
(length, salt) plus the count of the salts before. The plan turns the number
into sequence and offset by a range lookup. Salts grow with the data, so no
length, however common, is numbered by one task.

Null text: empty, whose ids are the end id alone. A row is a document: repeated
rows are packed each (their numbering among themselves is arbitrary). Empty table:
no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_groups, enter, keeps, materialise, to_text, tune
from .tokencount import byte_chars

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
END = "</w>"
MARK = "\x01"
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[^\W_]|(?:[^\w\s]|_)+")
#: Outside of these, Unicode tables of different libraries may differ: the library reads the whole word itself.
_UNUSUAL = "[^\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff–—‘-„…]"


class FastEncoder:
    """The ids of a tokenizers file.

    Words of a group of texts are told apart by Arrow's dictionary encoding; a word's ids depend on
    the word alone. Words not met before go to a byte-pair merger whose ranks are the file's ids, a word's end being
    the byte 1. It may join any neighbours that spell a token, the file only those of the
    token's own merge: the same wherever ids rise with the merges (looked at here) and
    each token, encoded by itself, stays whole (so in the public file). Other files, and words with unusual characters,
    are left to the library.

    Words are remembered in Arrow and NumPy arrays of about ``limit`` bytes at most.
    """

    def __init__(self, path: str, limit: int = 20 << 20):
        self.path, self.limit = path, limit
        self._library = None
        file = json.load(open(path, encoding="utf-8"))
        vocab = file["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.merger = self._merger(file)
        self.forget()

    @staticmethod
    def _merger(file: dict):
        import tiktoken

        model = file["model"]
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        special = {t["content"] for t in file["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in special}
        first = len(plain) - len(made)
        if model.get("end_of_word_suffix") != END or made != list(range(first, first + len(made))):
            return None
        back = {c: i for i, c in enumerate(byte_chars())}
        ranks = {bytes([back[c] for c in t.removesuffix(END)]) + MARK.encode() * t.endswith(END): i for t, i in plain.items()}
        return tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @cached_property
    def library(self):
        """The whole tokenizer; few words need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: pa.Array) -> np.ndarray:
        """new: distinct words, A-Z lower-cased. Returns their places."""
        plain = pc.invert(pc.match_substring_regex(new, _UNUSUAL)) if self.merger else pc.is_null(new)
        alone = pc.and_(plain, pc.utf8_is_alpha(new))
        words, other = new.filter(alone), new.filter(pc.invert(alone))
        parts, own = [], []  # of the other words: pre-tokens, or ids
        for w, ok in zip(other.to_pylist(), plain.filter(pc.invert(alone)).to_pylist()):
            parts.append(_PRETOKEN.findall(w.lower()) if ok else [])
            own.append(None if ok else np.frombuffer(self.whole(w), "<u4"))
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(f"{MARK} ", pa.large_string()))[0].as_py()
        some = [w for p in parts for w in p]
        text = f"{MARK} ".join(([joined] if joined else []) + some)
        ids = np.array(self.merger((text + MARK).lower()) if text else [], np.uint32)
        stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        tokens = np.concatenate([np.ones(len(words), np.int64), np.array([len(p) for p in parts], np.int64)])
        if len(stops) != tokens.sum() + 1 or stops[-1] != len(ids):
            raise ValueError("a word was not encoded by itself")
        last = stops[np.cumsum(tokens)]
        sizes = np.diff(last, prepend=0)
        starts = last - sizes
        at = len(ids)
        for i, x in enumerate(own, len(words)):
            if x is not None:
                starts[i], sizes[i] = at, len(x)
                at += len(x)
        base = len(self.known)
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids, *[x for x in own if x is not None]])
        self.known = pa.concat_arrays([self.known, words, other])
        first = np.asarray(alone)
        return base + np.where(first, np.cumsum(first) - 1, len(words) + np.cumsum(~first) - 1)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit words."""
        if self.known.nbytes + self.ids.nbytes + 2 * self.sizes.nbytes > self.limit:
            self.forget()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        special = pc.match_substring(texts, "<|")  # special tokens may stand anywhere in a word
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, pa.scalar("", pa.large_string()), texts)))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        found = pc.index_in(words, self.known)
        at, new = np.asarray(pc.fill_null(found, 0), np.int64).copy(), pc.is_null(found)
        if found.null_count:
            at[np.asarray(new)] = self.learn(words.filter(new))
        at = at[np.asarray(coded.indices)]
        own = self.sizes[at]
        ends = np.cumsum(own)
        stream = self.ids[np.repeat(self.starts[at] - (ends - own), own) + np.arange(ends[-1])] if len(ends) else self.ids[:0]
        cuts = (4 * np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]).tolist()
        raw = stream.astype("<u4").tobytes()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(np.asarray(special)).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


_ENCODERS: dict[str, FastEncoder] = {}
keeps("packing", _ENCODERS.clear)


def encoder(path: str) -> FastEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]


def cut_document(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of pieces of at most capacity ids; only longer documents are cut."""
    return [(k, a // 4, len(p) // 4, zlib.crc32(p)) for k, a in enumerate(range(0, len(ids), 4 * capacity)) for p in [ids[a : a + 4 * capacity]]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram of lengths: compositions and how often each is used."""
    left = {n: c for n, c in histogram.items() if c > 0}
    sizes = sorted(left)
    bins: list[tuple[tuple[int, ...], int]] = []

    def largest(room: int, used: dict[int, int]) -> int:
        i = bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= used.get(sizes[i], 0):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def best_two(room: int, used: dict[int, int], least: int) -> tuple[int, int] | None:
        """Two unpacked pieces with the largest sum that is over least and at most room."""
        top, got, hi = least, None, bisect_right(sizes, room) - 1
        lo = 0
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            need = 2 if lo == hi else 1
            if left[a] - used.get(a, 0) < need:
                lo += 1
                continue
            if left[b] - used.get(b, 0) < need:
                hi -= 1
                continue
            if a + b > room:
                hi -= 1
            else:
                if a + b > top:
                    top, got = a + b, (a, b)
                    if top == room:
                        break
                lo += 1
        return got

    while sizes:
        used: dict[int, int] = {}
        content: list[int] = []
        room = capacity
        while room and (n := largest(room, used)):
            content.append(n)
            used[n] = used.get(n, 0) + 1
            room -= n
        while room and content:
            small = min(content)
            used[small] -= 1
            two = best_two(room + small, used, small)
            if two is None:
                used[small] += 1
                break
            content.remove(small)
            for n in two:
                used[n] = used.get(n, 0) + 1
                content.append(n)
            room += small - sum(two)
        used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        bins.append((tuple(sorted(content, reverse=True)), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                sizes.pop(bisect_right(sizes, n) - 1)
    return bins


def slots(bins) -> pd.DataFrame:
    """For each length, runs of its numbers: number low.. goes to sequence seq + (number - low), at offset."""
    seen: dict[int, int] = {}
    rows, seq = [], 0
    for content, times in bins:
        offset = 0
        for n in content:
            low = seen.get(n, 0)
            rows.append((n, low, low + times, seq, offset))
            seen[n] = low + times
            offset += n
        seq += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "seq", "offset"])


def tokenised_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece, in one pass without a shuffle."""
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(doc_id).alias("doc_id"), to_text(text).alias("text"))

    def cut(batches):
        enter("packing")
        enc = encoder(path)
        for batch in batches:
            for group in byte_groups(batch, 1):
                found = [cut_document(ids + end, capacity) for ids in enc.encode(group.column(1))]
                each = group.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                columns = zip(*[p for x in found for p in x])
                yield pa.RecordBatch.from_arrays([each, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long").fields]))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 250_000) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. Read several times: materialise it first."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = sum(histogram.values())
    if not total:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    salts = max(8, -(-total // rows_per_salt))
    # A row's place in the materialised table, so that equal rows get different salts.
    salted = pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "salt"])
    table = slots(plan(histogram, capacity))
    lists = [(n, *[t[c].tolist() for c in ("low", "high", "seq", "offset")]) for n, t in ((int(n), t) for n, t in table.groupby("length", sort=True))]
    runs = spark.createDataFrame(lists, "length long, low array<long>, high array<long>, seq array<long>, offset array<long>")
    n = F.col("base") + F.col("own")
    runs = runs.select("length", F.explode(F.arrays_zip("low", "high", "seq", "offset")).alias("run")).select("length", "run.*")
    # Runs of a length tile its numbers: exactly one matches. The plan's size is bounded by the capacity, not by the data.
    at = numbered.withColumn("number", n).join(F.broadcast(runs), ["length"]).filter((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    tune(docs.sparkSession)
    return pack_pieces(materialise(tokenised_pieces(docs, path, capacity, end_id, doc_id, text)), capacity)
