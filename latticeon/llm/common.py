"""Helpers shared by the text operators.

Conventions of every operator in this package:

* it reads only the columns it is told about, so further columns, whatever
  their names, pass through untouched or are not looked at;
* a null text counts as empty; a null id is a value like any other;
* each whole text is processed, whatever its length;
* state that workers keep between batches (word caches) is bounded and never
  changes a result.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: bounds a worker's memory where texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: some documents are thousands of times longer than the median."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    reachable(spark)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    That serves a checkout that all machines see; otherwise ship it with --py-files.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where none is set in a local session (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="latticeon-")
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Compute df once, in the shared folder: survives the loss of executors and cuts the lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/ckpt-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def to_text(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def byte_groups(batch, column: int, size: int = 4 << 20):
    """The batch in slices of about so many bytes of a text column, at least a row each: bounds memory where texts are long."""
    import numpy as np
    import pyarrow.compute as pc

    start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)) // size
    at = 0
    for stop in [*(np.flatnonzero(np.diff(start)) + 1).tolist(), batch.num_rows]:
        if stop > at:
            yield batch.slice(at, stop - at)
        at = stop


class BoundedCache(dict):
    """A dict that computes missing values and forgets its older half when full. Very long keys aren't kept."""

    LONGEST = 256

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.compute(key)
        if len(self) >= self.limit:
            self.trim()
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        """Entries stand in insertion order; the first half goes."""
        from itertools import islice

        for k in list(islice(self, len(self) // 2)):
            del self[k]


_FORGET: dict = {}
_NOW = ""


def keeps(name: str, forget) -> None:
    """Registers how an operator empties the caches that it keeps between a worker's tasks."""
    _FORGET[name] = forget


def enter(name: str) -> None:
    """Called where an operator begins in a worker: the caches of the others are emptied."""
    global _NOW
    if _NOW != name:
        for other, forget in _FORGET.items():
            if other != name:
                forget()
        _NOW = name
