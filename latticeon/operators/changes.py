"""Changes to a graph: each returns a new version, planned lazily."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EDGE_SCHEMA, Graph


def now_ms() -> int:
    return int(time.time() * 1000)


def spark_type(values) -> str:
    vs = [v for v in values if v is not None]
    if not vs:
        return "string"
    if all(isinstance(v, bool) for v in vs):
        return "boolean"
    if all(isinstance(v, int) and not isinstance(v, bool) for v in vs):
        return "bigint"
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vs):
        return "double"
    if all(isinstance(v, list) for v in vs):
        flat = [x for v in vs for x in v]
        return "array<float>" if flat and all(isinstance(x, (int, float)) for x in flat) else "array<string>"
    return "string"


def plain(v):
    return json.dumps(v) if isinstance(v, dict) else v


def upsert_rows(graph: Graph, name: str, rows: list[dict], types: dict[str, str]) -> Graph:
    """Literal rows: the last of a key wins; a row replaces its predecessor but for _created_unix."""
    last: dict[str, dict] = {}
    for r in rows:
        r = {k: plain(v) for k, v in r.items()}
        key = r.pop("_key", None)
        if key is None:
            key = str(uuid.uuid4())
        last.pop(key, None)
        last[key] = r
    fields = list(dict.fromkeys(k for r in last.values() for k in r))
    schema = {k: types.get(k) or spark_type([r.get(k) for r in last.values()]) for k in fields}

    def fit(v, t):
        if v is None:
            return None
        if t == "double":
            return float(v)
        if t == "array<float>":
            return [float(x) for x in v]
        return v if t != "string" or isinstance(v, str) else json.dumps(v)

    data = [(name, k, f"{name}/{k}", now_ms(), now_ms(), *[fit(r.get(f), schema[f]) for f in fields]) for k, r in last.items()]
    sql = "_collection string, _key string, _id string, _created_unix long, _updated_unix long" + "".join(f", `{f}` {schema[f]}" for f in fields)
    return upsert(graph, name, graph.spark.createDataFrame(data, sql))


def upsert(graph: Graph, name: str, new: DataFrame) -> Graph:
    old = graph.collections.get(name)
    if old is None:
        return graph.with_collection(name, new)
    if "_created_unix" in old.columns and "_created_unix" in new.columns:
        was = old.select("_key", F.col("_created_unix").alias("__was"))
        new = new.join(was, "_key", "left").withColumn("_created_unix", F.coalesce("__was", "_created_unix")).drop("__was")
    for f in new.schema.fields:
        if f.name in old.columns and old.schema[f.name].dataType != f.dataType:
            new = new.withColumn(f.name, F.col(f"`{f.name}`").cast(old.schema[f.name].dataType))
    kept = old.join(new.select("_key"), "_key", "left_anti")
    return graph.with_collection(name, kept.unionByName(new, allowMissingColumns=True))


def update(graph: Graph, name: str, values: dict, where: Column) -> Graph:
    df = graph.collection(name)
    for k, v in values.items():
        v = plain(v)
        lit = F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")
        old = F.col(f"`{k}`") if k in df.columns else F.lit(None)
        if k in df.columns and v is not None:
            lit = lit.cast(df.schema[k].dataType)
        df = df.withColumn("__new_" + k, F.when(where, lit).otherwise(old))
    if "_updated_unix" in df.columns:
        df = df.withColumn("_updated_unix", F.when(where, F.lit(now_ms())).otherwise(F.col("_updated_unix")))
    for k in values:
        df = df.drop(k).withColumnRenamed("__new_" + k, k)
    return graph.with_collection(name, df)


def _without_edges_of(graph: Graph, gone: DataFrame) -> Graph:
    ids = gone.select("_id")
    e = graph.edges.join(ids.withColumnRenamed("_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("_id", "dst"), "dst", "left_anti")
    return graph.with_edges(e.select("src", "dst", "type", "strength", "meta"))


def delete(graph: Graph, name: str, where: Column | None) -> Graph:
    """Deletes nodes and all edges at them."""
    df = graph.collection(name)
    gone = df if where is None else df.filter(where)
    out = _without_edges_of(graph, gone)
    return out.with_collection(name, df.limit(0) if where is None else df.filter(~where))


def drop_collection(graph: Graph, name: str) -> Graph:
    return _without_edges_of(graph, graph.collection(name)).with_collection(name, None)


def link(graph: Graph, edges: list[tuple]) -> Graph:
    """(src, dst, type, strength, meta dict or None) each."""
    rows = [(s, d, t, float(w), json.dumps(m) if m else None) for s, d, t, w, m in edges]
    return graph.with_edges(graph.edges.unionByName(graph.spark.createDataFrame(rows, EDGE_SCHEMA)))


def unlink(graph: Graph, edges: list[tuple]) -> Graph:
    """(src, dst, type) each: all parallel edges go."""
    e = graph.edges
    for s, d, t in edges:
        e = e.filter(~((F.col("src") == s) & (F.col("dst") == d) & ((F.col("type") == t) if t else F.lit(True))))
    return graph.with_edges(e)


def link_all(graph: Graph, starts: DataFrame, target: str, kind: str, strength: float = 1.0, meta: dict | None = None) -> Graph:
    new = starts.select(F.col("_id").alias("src"), F.lit(target).alias("dst"), F.lit(kind).alias("type"), F.lit(strength).cast("float").alias("strength"), F.lit(json.dumps(meta) if meta else None).cast("string").alias("meta"))
    return graph.with_edges(graph.edges.unionByName(new))


def add_column(graph: Graph, name: str, field: str, kind: str) -> Graph:
    df = graph.collection(name)
    return graph if field in df.columns else graph.with_collection(name, df.withColumn(field, F.lit(None).cast(kind)))


def drop_column(graph: Graph, name: str, field: str) -> Graph:
    return graph.with_collection(name, graph.collection(name).drop(field))


def rename_column(graph: Graph, name: str, old: str, new: str) -> Graph:
    return graph.with_collection(name, graph.collection(name).withColumnRenamed(old, new))


def rename_collection(graph: Graph, old: str, new: str) -> Graph:
    """Keys and ids stay as they are."""
    df = graph.collection(old).withColumn("_collection", F.lit(new))
    return graph.with_collection(old, None).with_collection(new, df)


def infer_type(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INTEGER"
    if isinstance(t, T.NumericType):
        return "REAL"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "TIMESTAMPTZ"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return "VECTOR"
    return "TEXT" if isinstance(t, T.StringType) else "JSON"
