"""Approximate nearest neighbours by cosine distance: an inverted file of cells.

Centroids come from a bounded sample of the rows (``SAMPLE`` rows, the first by a hash of their key); every row is then
put into the cell of its nearest centroid, in one pass of matrix products over Arrow batches. A search reads the cells
nearest to the query and takes the exact top k of their rows. How many cells that is, is measured when the index is
built: the fewest with which sampled queries find ``RECALL`` of their exact neighbours in the sample. The exact search
(``functions.vector.near``) stays the default of queries.

Rows without a vector, or with one of another length, are in no cell and never found, as in the exact search. An empty table gives an
index that finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector

SAMPLE, QUERIES, RECALL = 20_000, 200, 0.97


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n == 0, 1, n)).astype(np.float32)


def centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit rows."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c = np.where(full[:, None], _unit(total), c)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int = 10) -> int:
    """The fewest cells whose rows hold RECALL of the k nearest of rows of the sample."""
    q = x[np.linspace(0, len(x) - 1, min(QUERIES, len(x))).astype(int)]
    k = min(k, len(x))
    near = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    rank = np.empty((len(q), len(c)), int)
    np.put_along_axis(rank, np.argsort(-(q @ c.T), axis=1), np.arange(len(c))[None, :], axis=1)
    own = (x @ c.T).argmax(1)
    seen = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(seen[min(len(seen) - 1, int(np.ceil(RECALL * len(seen))))]) + 1


class VectorIndex:
    """rows: the table with column ``__cell``. Save it partitioned by ``__cell``, so that a search reads its cells only."""

    def __init__(self, df: DataFrame, field: str, key: str = "_id", cells: int | None = None):
        self.field, self.key = field, key
        size = F.size(field)
        some = df.filter(F.col(field).isNotNull() & (size > 0)).select(F.col(field).cast("array<float>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).toPandas()["v"]
        dims = max((len(v) for v in some), default=0)
        x = _unit(np.array([v for v in some if len(v) == dims and not np.isnan(v).any()], np.float32).reshape(-1, dims)) if dims else np.zeros((0, 0), np.float32)
        cells = cells or max(1, int(4 * np.sqrt(len(x)) ** 0.9))
        self.centroids = centroids(x, cells) if len(x) else x
        self.probes = probes_needed(x, self.centroids) if len(x) else 0
        c = self.centroids

        @F.arrow_udf("int")
        def cell(v: pa.Array) -> pa.Array:
            n = np.asarray(pc.fill_null(pc.list_value_length(v), -1))
            out = np.full(len(v), -1, np.int32)
            ok = n == (c.shape[1] if len(c) else -2)
            if ok.any():
                rows = np.nan_to_num(np.asarray(v.filter(pa.array(ok)).flatten(), np.float32).reshape(-1, c.shape[1]))
                out[ok] = (rows @ c.T).argmax(1)
            return pa.array(out, mask=out < 0)

        self.rows = df.withColumn("__cell", cell(F.col(field).cast("array<float>")))

    def cells_of(self, q, probes: int | None = None) -> list[int]:
        if not len(self.centroids):
            return []
        near = np.argsort(-(_unit(np.array([q], np.float32)) @ self.centroids.T)[0])
        return near[: probes or self.probes].tolist()

    def search(self, q, k: int, probes: int | None = None) -> DataFrame:
        """The k nearest among the rows of the nearest cells, nearest first."""
        return vector.near(self.rows.filter(F.col("__cell").isin(self.cells_of(q, probes))), self.field, q, k, self.key).drop("__cell")
