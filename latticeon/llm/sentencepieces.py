"""N-best segmentation into sentence pieces by A-star search over the piece lattice.

A text is normalised (a blank in front, blanks become U+2581) and cut where a blank
follows other characters; no piece crosses such a place, so segments are independent. In a segment's
lattice of pieces a forward Viterbi pass gives the best score of every prefix. The backward search
extends suffixes from the end; suffix score plus prefix score is exact, so
hypotheses leave the agenda best first, and the best extension of one is followed at once. A character that is no piece is spelled by its byte pieces.

The N best of a text combine its segments' alternatives: only the N - 1 occurrences
whose second choice costs least can take part, and those are searched and merged exactly. The
forward pass of each segment keeps the second score, too, which tells these occurrences. The
merge carries which occurrence takes which alternative, so each hypothesis has its ids.

Scores: those of a unigram model; of a merge-based model, which only ranks its pieces,
``-ln(2 + rank)``. Segments are remembered in a bounded cache. Null text: empty, no pieces,
one hypothesis of score 0. Repeated rows are segmented each; an empty table gives no rows. U+2581 in a text
is read as a blank, which decoding gives back.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, to_text, tune

MODEL = "piece_bpe_32k.model"
N_BEST = 4
BLANK = "▁"


class PieceModel:
    def __init__(self, path: str, n: int = N_BEST, merge_ranks: bool = True, cache: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        self.piece: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.texts: list[bytes] = []
        usual = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.texts.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.texts.append(b"")
            else:
                usual.append((-sp.get_score(i), i, p))
                self.texts.append(p.replace(BLANK, " ").encode())
        usual.sort()
        for rank, (s, i, p) in enumerate(usual):
            self.piece[p] = (-math.log(2 + rank) if merge_ranks else -s, i)
        self.reach: dict[str, tuple] = {p[:k]: () for p in self.piece for k in range(1, len(p))}
        self.reach.update({p: (w, (i,)) for p, (w, i) in self.piece.items()})
        # Nodes: (children, score or None, ids).
        self.trie: dict[str, tuple] = {}
        for p in sorted(self.reach, key=len):
            level = self.trie
            for ch in p[:-1]:
                level = level[ch][0]
            w = self.reach[p]
            level[p[-1]] = ({}, w[0] if w else None, w[1] if w else None)
        self.byte_score = min(s for s, _ in self.piece.values()) - 5.0
        inner = any(BLANK in p.lstrip(BLANK) for p in self.piece)
        self.cut = re.compile(".+" if inner else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.S)
        self.segments = BoundedCache(lambda s: self._remember(s), cache)

    def lattice(self, s: str):
        """For each end the (start, score, ids) of the edges that end there, and the best score of each prefix."""
        n, get = len(s), self.reach.get
        ends: list[list] = [[] for _ in range(n + 1)]
        best = [-1e300] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base = best[i]
            p = get(s[i])
            if not p:
                b = s[i].encode("utf-8", "surrogatepass")
                w = self.byte_score * len(b)
                ends[i + 1].append((i, w, tuple([self.byte[x] for x in b])))
                if base + w > best[i + 1]:
                    best[i + 1] = base + w
                if p is None:
                    continue
            j = i + 1
            while p is not None:
                if p:
                    w = p[0]
                    ends[j].append((i, w, p[1]))
                    if base + w > best[j]:
                        best[j] = base + w
                j += 1
                if j > n:
                    break
                p = get(s[i:j])
        return ends, best

    def search(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a segment, best first."""
        ends, best = self.lattice(s)
        size = len(s)
        # Entries: negated total, place, tie break, suffix score, suffix. Deeper places first among equals.
        agenda = [(-best[size], size, 0, 0.0, None)]
        out, tie = [], 0
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            f, at, _, g, suffix = pop(agenda)
            while at:
                # Follow the best edge at once; only the others wait on the agenda.
                edges = ends[at]
                if len(edges) > 1:
                    top = max([(best[i] + w, i, w, ids) for i, w, ids in edges])
                    for i, w, ids in edges:
                        if i != top[1]:
                            tie += 1
                            push(agenda, (-(g + w + best[i]), i, tie, g + w, (ids, suffix)))
                    at, w, ids = top[1:]
                else:
                    at, w, ids = edges[0]
                g += w
                suffix = (ids, suffix)
            ids = []
            while suffix is not None:
                ids += suffix[0]
                suffix = suffix[1]
            out.append((g, ids))
            if len(out) == n:
                break
        return out

    def _remember(self, s: str) -> tuple[float, float, bytes]:
        """Best score, what the second choice costs, ids of the best.

        A forward pass over the pieces' trie that keeps two scores a place.
        """
        n, root = len(s), self.trie
        best, second = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base, other = best[i], second[i]
            node = root.get(s[i])
            if node is None or node[1] is None:
                raw = s[i].encode("utf-8", "surrogatepass")
                w, j = self.byte_score * len(raw), i + 1
                v, old = base + w, best[j]
                if v > old:
                    u = other + w
                    best[j], second[j], back[j] = v, old if old > u else u, (i, tuple([self.byte[x] for x in raw]))
                elif v > second[j]:
                    second[j] = v
            j = i + 1
            while node is not None:
                w = node[1]
                if w is not None:
                    v, old = base + w, best[j]
                    if v > old:
                        u = other + w
                        best[j], second[j], back[j] = v, old if old > u else u, (i, node[2])
                    elif v > second[j]:
                        second[j] = v
                if j == n:
                    break
                node = node[0].get(s[j])
                j += 1
        ids: list[int] = []
        j = n
        while j:
            j, own = back[j]
            ids += own[::-1]
        ids.reverse()
        return best[n], best[n] - second[n], array("I", ids).tobytes()

    def _spell(self, ids) -> str:
        return b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace")

    def normalise(self, text: str) -> str:
        return (" " + text).replace(" ", BLANK) if text else ""

    def _alternatives(self, s: str, total: float, ids: bytes) -> list[tuple[float, bytes]]:
        """What each of the n best segmentations of a segment costs beside its best, and its ids; the best is the given one."""
        found = [(max(0.0, total - x), array("I", i).tobytes()) for x, i in self.search(s, self.n)]
        return [(0.0, ids), *[x for x in found if x[1] != ids]][: self.n]

    def _choose(self, text: str):
        """Best score, ids of the best by segment, and of each hypothesis its cost and the (segment, ids) that it takes instead."""
        pieces = self.cut.findall(self.normalise(text))
        if not pieces:
            return 0.0, (), [(0.0, ())]
        best, cost, ids = zip(*map(self.segments.__getitem__, pieces))
        chosen: list[tuple[float, tuple]] = [(0.0, ())]
        if self.n > 1:
            c = np.array(cost)
            m = min(self.n - 1, len(c))
            for k in np.argpartition(c, m - 1)[:m].tolist():
                if cost[k] < math.inf:
                    every = self._alternatives(pieces[k], best[k], ids[k])
                    chosen = heapq.nsmallest(self.n, [(x + y, (*took, (k, i))) for x, took in chosen for y, i in every], key=lambda z: z[0])
        return math.fsum(best), ids, chosen

    @staticmethod
    def _joined(ids, chosen) -> list[bytes]:
        out = [b"".join(ids)]
        for _, took in chosen[1:]:
            own = list(ids)
            for k, i in took:
                own[k] = i
            out.append(b"".join(own))
        return out

    def encode_all(self, text: str) -> tuple[list[float], list[bytes]]:
        """Scores and ids of the n best segmentations of a text, best first."""
        total, ids, chosen = self._choose(text)
        return [total - x for x, _ in chosen], self._joined(ids, chosen)

    def digest(self, text: str) -> tuple[list[float], list[int], list[int], bool]:
        """Scores, counts and crc32 of the n best, and whether all decode to the text.

        The best is decoded whole, the others where they differ: they spell what it spells if those segments do.
        """
        total, ids, chosen = self._choose(text)
        all_ids = self._joined(ids, chosen)
        spell = lambda raw: b"".join([self.texts[i] for i in memoryview(raw).cast("I")])
        same = all([spell(i) == spell(ids[k]) for _, took in chosen[1:] for k, i in took if i is not ids[k]])
        return [total - x for x, _ in chosen], [len(i) // 4 for i in all_ids], [zlib.crc32(i) for i in all_ids], same and self.decode(memoryview(all_ids[0]).cast("I")) == text

    def encode(self, text: str) -> tuple[list[float], bytes]:
        scores, ids = self.encode_all(text)
        return scores, ids[0]

    def decode(self, ids) -> str:
        text = self._spell(ids)
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[tuple[str, int], PieceModel] = {}


def model(path: str, n: int = N_BEST) -> PieceModel:
    if (path, n) not in _MODELS:
        _MODELS[path, n] = PieceModel(path, n)
    return _MODELS[path, n]


_NBEST = pa.struct([("ids", pa.list_(pa.list_(pa.int32()))), ("scores", pa.list_(pa.float64()))])


def _offsets(lengths) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))


def nbest_column(path: str, n: int = N_BEST, text: str = "text") -> Column:
    """Struct of a text's n best segmentations: ids of each, best first, and their scores."""

    @F.arrow_udf("struct<ids:array<array<int>>,scores:array<double>>")
    def nbest(t: pa.Array) -> pa.Array:
        m = model(path, n)
        scores, ids = [], []
        for x in t:
            a, b = m.encode_all(x.as_py())
            scores.append(a)
            ids.append(b)
        flat = [i for b in ids for i in b]
        values = pa.Array.from_buffers(pa.int32(), sum(map(len, flat)) // 4, [None, pa.py_buffer(b"".join(flat))])
        each = pa.ListArray.from_arrays(_offsets([len(i) // 4 for i in flat]), values)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(_offsets([len(b) for b in ids]), each), pa.array(scores, pa.list_(pa.float64()))], fields=list(_NBEST))

    return nbest(to_text(text))


def decode_column(path: str, ids: str = "ids") -> Column:
    """The text that each segmentation of an array of arrays of ids spells."""

    @F.arrow_udf("array<string>")
    def decode(rows: pa.Array) -> pa.Array:
        m = model(path)
        each = rows.flatten()
        spelt = pa.array(m.texts, pa.large_binary()).take(each.flatten())
        at = np.frombuffer(spelt.buffers()[1], np.int64)
        data = spelt.buffers()[2].to_pybytes() if len(spelt) else b""
        ends = at[np.cumsum([0, *pc.list_value_length(each).fill_null(0).to_pylist()])].tolist()
        out = [data[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:])]
        out = [x[1:] if x.startswith(" ") else x for x in out]
        return pa.ListArray.from_arrays(_offsets(pc.list_value_length(rows).fill_null(0).to_numpy()), pa.array(out, pa.string()))

    return decode(F.col(ids))


def nbest_digest_column(path: str, n: int = N_BEST, text: str = "text") -> Column:
    """Struct of scores, n_pieces and ids_crc32 of a text's n best segmentations (ids as little-endian 32-bit words), and
    restored: whether each decodes to the text itself. The same as digest_column and
    decode_column of nbest_column, without the ids' way through the JVM."""

    @F.arrow_udf("struct<scores:array<double>,n_pieces:array<long>,ids_crc32:array<long>,restored:boolean>")
    def digest(t: pa.Array) -> pa.Array:
        m = model(path, n)
        cols: tuple = ([], [], [], [])
        for x in t:
            for c, v in zip(cols, m.digest(x.as_py())):
                c.append(v)
        kinds = (pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["scores", "n_pieces", "ids_crc32", "restored"])

    return digest(to_text(text))


def digest_column(ids: str = "ids") -> Column:
    """Of each segmentation the number of ids and the crc32 of the ids as little-endian 32-bit words."""

    @F.arrow_udf("struct<n_pieces:array<long>,ids_crc32:array<long>>")
    def digest(rows: pa.Array) -> pa.Array:
        each = [[i.values.to_numpy().astype("<u4") for i in r.values] for r in rows]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([[len(i) for i in r] for r in each], kind), pa.array([[zlib.crc32(i) for i in r] for r in each], kind)], names=["n_pieces", "ids_crc32"])

    return digest(F.col(ids))


def segment(docs: DataFrame, path: str, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, ids and scores of the n best, best first; and the columns to keep."""
    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, nbest_column(path, n, text).alias("r")).select("doc_id", *keep, "r.*")
