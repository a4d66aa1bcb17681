"""Distances between an array column and a literal vector.

Each is one matrix product per Arrow batch: unrolled into generated terms it took the JVM longer to
compile and to run (top 10 of 2,000 rows of 64 components: 3.2 s, as lambdas 0.5 s, so 0.3 s; of 40,000: 8.3, 1.5 and 1.5 s).

A null vector, one shorter than the literal or with a null among the components that count has no distance (null);
components beyond the literal's are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measured(c: Column, q, measure) -> Column:
    """measure: of a matrix of rows and the literal, a number for each row."""
    q = np.array([float(x) for x in q], np.float64)

    @F.arrow_udf("double")
    def distance(v: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(v), -1), np.int64)
        ok = n >= len(q)
        flat = v.flatten()
        values = np.asarray(flat.cast(pa.float64()), np.float64)
        starts = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
        at = starts[ok][:, None] + np.arange(len(q))
        if flat.null_count:
            whole = np.asarray(flat.is_valid())[at].all(1)
            ok[np.flatnonzero(ok)[~whole]] = False
            at = at[whole]
        out = np.zeros(len(v))
        out[ok] = measure(values[at], q)
        return pa.array(out, mask=~ok)

    return distance(c)


def dot(c: Column, q) -> Column:
    return _measured(c, q, lambda x, y: x @ y)


def l2(c: Column, q) -> Column:
    """Squared Euclidean distance."""
    return _measured(c, q, lambda x, y: ((x - y) ** 2).sum(1))


def l1(c: Column, q) -> Column:
    return _measured(c, q, lambda x, y: np.abs(x - y).sum(1))


def cosine_distance(c: Column, q) -> Column:
    """1 - similarity, the similarity kept within [-1, 1]; 1 if either is a zero vector."""

    def measure(x, y):
        norms = np.sqrt((x * x).sum(1) * (y @ y))
        return 1 - np.clip(np.divide(x @ y, norms, out=np.zeros(len(x)), where=norms > 0), -1, 1)

    return _measured(c, q, measure)


DISTANCE = {"<=>": cosine_distance, "<->": l2, "<#>": dot, "<+>": l1}


def near(df: DataFrame, field: str, q, k: int, key: str = "_key") -> DataFrame:
    """The k rows nearest by cosine distance; rows without a vector drop out. A top-k, not a full sort."""
    d = cosine_distance(F.col(field), q)
    return df.filter(F.col(field).isNotNull()).orderBy(d.asc(), F.col(key).asc()).limit(k)
