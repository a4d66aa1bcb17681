"""Exact top-k search in Hamming space by incremental multi-index hashing.

Vectors become binary codes (a bit per component: is it positive). A block of codes is
indexed once per 16-bit segment. A query probes segments in turn at radius 0, 1, 2, ...; after segment s at
radius r every code within distance ``m * r + s`` has been met, so the search
ends once the k-th verified distance is at most that. Ties are broken by the smaller id.

Rows with one code are searched as one. Codes are cut into blocks of bounded size; the codes asked for, in batches, visit
each block, whose index is built once; the k best of every block are merged per code.

Null vectors have no code and are neither found nor searched for. Vectors may differ in length: missing components, nulls and
NaN count as not positive. Rows with a null id are left out. Repeated rows are found each, queries that repeat are answered each.
An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tune

SEGMENT = 16
BLOCK_ROWS = 1 << 16
QUERY_ROWS = 1 << 10


def _masks(width: int) -> list[np.ndarray]:
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), r)] or [0], np.int64) for r in range(width + 1)]


_MASKS: list[np.ndarray] = []


class MultiIndex:
    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        """codes: rows x words of 64 bits."""
        global _MASKS
        _MASKS = _MASKS or _masks(SEGMENT)
        self.codes, self.ids = codes, ids
        self.parts = np.ascontiguousarray(codes).view(np.uint16).astype(np.int64)
        self.order, self.starts = [], []
        for s in range(self.parts.shape[1]):
            self.order.append(np.argsort(self.parts[:, s], kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(self.parts[:, s], minlength=1 << SEGMENT))]))

    def probe(self, s: int, value: int, r: int) -> np.ndarray:
        v = _MASKS[r] ^ value
        a, n = self.starts[s][v], self.starts[s][v + 1] - self.starts[s][v]
        keep = n > 0
        a, n = a[keep], n[keep]
        if not len(n):
            return np.zeros(0, np.int64)
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.order[s][at]

    def search(self, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest as (distance, id), nearest first."""
        return [(d, int(self.ids[i])) for d, i in self.nearest(code, k)]

    def nearest(self, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest as (distance, place in the index), nearest first, then by id."""
        k = min(k, len(self.ids))
        if k == 0:
            return []
        seen = np.zeros(len(self.ids), bool)
        parts = np.ascontiguousarray(code).view(np.uint16).astype(np.int64)
        m = len(parts)
        found, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        kth = 1 << 30
        for r in range(SEGMENT + 1):
            for s in range(m):
                c = self.probe(s, int(parts[s]), r)
                c = c[~seen[c]]
                if len(c):
                    seen[c] = True
                    d = np.bitwise_count(self.codes[c] ^ code).sum(1).astype(np.int64)
                    found.append(c)
                    dist.append(d)
                    alld = np.concatenate(dist)
                    dist = [alld]
                    if len(alld) >= k:
                        kth = int(np.partition(alld, k - 1)[k - 1])
                if kth <= m * r + s:
                    break
            else:
                continue
            break
        f, d = np.concatenate(found), np.concatenate(dist)
        near = d <= np.partition(d, k - 1)[k - 1]
        f, d = f[near], d[near]
        top = np.lexsort((self.ids[f], d))[:k]
        return [(int(d[i]), int(f[i])) for i in top]


def binary_code(vector: str, dims: int):
    """dims: of the longest vector; a longer one is an error."""
    words = max(1, -(-dims // 64))

    @F.arrow_udf("binary")
    def code(v: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(v), 0), np.int64)
        if len(n) and n.max() > dims:
            raise ValueError(f"a vector has {n.max()} components, more than {dims}")
        bits = np.zeros((len(v), words * 64), bool)
        row = np.repeat(np.arange(len(v)), n)
        bits[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(pc.fill_null(pc.greater(v.flatten(), 0), False))
        raw = np.packbits(bits, axis=1, bitorder="little").tobytes()
        return pa.array([raw[8 * words * i : 8 * words * (i + 1)] if ok else None for i, ok in enumerate(v.is_valid().to_pylist())], pa.binary())

    return code(F.col(vector))


def top_k(rows: DataFrame, queries: DataFrame, k: int, dims: int | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, found_id, distance: the k rows nearest to each query (a query that is a row finds itself).

    dims: components of the longest vector; None: looked up in the data.
    """
    tune(rows.sparkSession)
    if dims is None:
        both = rows.select(F.size(vector).alias("n")).union(queries.select(F.size(vector).alias("n")))
        dims = max(0, both.agg(F.max("n")).first()[0] or 0)

    def coded(d: DataFrame) -> DataFrame:
        c = d.select(F.col(row_id).cast("long").alias("id"), binary_code(vector, dims).alias("code"))
        return materialise(c.filter("id IS NOT NULL AND code IS NOT NULL"))

    # Of rows with one code only the k smallest ids can be among the k nearest; the limit acts before the shuffle, so
    # that a code many rows share is no burden. A code is asked for once.
    own = Window.partitionBy("code").orderBy("id")
    least = coded(rows).withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k)
    codes = materialise(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = coded(queries)
    n = max(1, -(-codes.count() // BLOCK_ROWS))
    data = codes.select("code", F.col("ids")[0].alias("id"), F.pmod(F.xxhash64("code"), F.lit(n)).cast("int").alias("block"))
    wanted = materialise(asked.select("code").distinct())
    data = data.groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("code").alias("codes")).withColumn("part", F.lit(-1))
    # Each query visits each block, in batches; a block's index is built once and its queries follow it.
    batch = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(max(1, -(-wanted.count() // QUERY_ROWS)))).cast("int")
    wanted = wanted.groupBy(batch.alias("part")).agg(F.collect_list("code").alias("codes"))
    wanted = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.array().cast("array<long>").alias("ids"), "codes", "part")
    work = data.unionByName(wanted).repartition(n, "block").sortWithinPartitions("block", "part")

    def search(batches):
        index = at = own = None
        for b in batches:
            for i in range(b.num_rows):
                block, part = b.column("block")[i].as_py(), b.column("part")[i].as_py()
                cell = b.column("codes")[i].values
                codes = np.frombuffer(b"".join(cell.to_pylist()), np.uint64).reshape(len(cell), -1)
                if part < 0:
                    index, at, own = MultiIndex(codes, np.asarray(b.column("ids")[i].values)), block, cell
                elif block == at:
                    got = [(j, f, d) for j, c in enumerate(codes) for d, f in index.nearest(c, k)]
                    j, f, d = (pa.array(x, pa.int64()) for x in (zip(*got) if got else ((), (), ())))
                    yield pa.RecordBatch.from_arrays([cell.take(j), own.take(f), pa.array(index.ids).take(f), d], names=["code", "found", "id", "distance"])

    near = work.select("block", "part", "ids", "codes").mapInArrow(search, "code binary, found binary, id long, distance long")
    best = Window.partitionBy("code").orderBy("distance", "id")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    # Back from codes to their rows, then from the codes asked for to the queries.
    near = near.join(codes.select(F.col("code").alias("found"), F.col("ids").alias("of")), "found").select("code", "distance", F.explode("of").alias("found_id"))
    best = Window.partitionBy("code").orderBy("distance", "found_id")
    near = near.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    answers = near.groupBy("code").agg(F.collect_list(F.struct("rank", "found_id", "distance")).alias("a"))
    return asked.join(answers, "code").select(F.col("id").alias("query_id"), F.explode("a").alias("a")).select("query_id", "a.*")
