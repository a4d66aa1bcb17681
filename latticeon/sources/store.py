"""Saved versions: a directory of Parquet tables per version and a pointer to the current one."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..model import Graph


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> dict | None:
    fs, Path = _fs(spark, path)
    versions = [int(s.getPath().getName()[1:-5]) for s in fs.globStatus(Path(f"{path}/v*.json")) or []]
    if not versions:
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/v{max(versions)}.json").collect())
    return json.loads(text) | {"version": max(versions)}


def save(graph: Graph, path: str, schemas: dict, indexes: list) -> int:
    """Write a new version beside the old ones; its description appears last, in one rename."""
    spark = graph.spark
    old = current(spark, path)
    v = (old["version"] if old else 0) + 1
    for name, df in graph.collections.items():
        df.write.mode("overwrite").parquet(f"{path}/v{v}/nodes/{name}")
    graph.edges.write.mode("overwrite").parquet(f"{path}/v{v}/edges")
    fs, Path = _fs(spark, path)
    out = fs.create(Path(f"{path}/.v{v}.tmp"), True)
    out.write(bytearray(json.dumps({"collections": sorted(graph.collections), "schemas": schemas, "indexes": indexes}).encode()))
    out.close()
    fs.rename(Path(f"{path}/.v{v}.tmp"), Path(f"{path}/v{v}.json"))
    return v


def load(spark: SparkSession, path: str):
    """(graph, schemas, indexes) of the current version, or None."""
    d = current(spark, path)
    if d is None:
        return None
    root = f"{path}/v{d['version']}"
    g = Graph(spark, {n: spark.read.parquet(f"{root}/nodes/{n}") for n in d["collections"]}, spark.read.parquet(f"{root}/edges"))
    return g, d["schemas"], d["indexes"]
