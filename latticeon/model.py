"""The data model: collections of nodes and one table of directed, typed, weighted edges, all DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM_FIELDS = ("_collection", "_id", "_key", "_created_unix", "_updated_unix")
EDGE_SCHEMA = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("type", T.StringType()), T.StructField("strength", T.FloatType()), T.StructField("meta", T.StringType())])
#: Declared column types and what they become.
TYPES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double", "TIMESTAMPTZ": "timestamp", "GEO": "string", "VECTOR": "array<float>", "JSON": "string", "BOOLEAN": "boolean"}


@dataclass(frozen=True)
class Graph:
    """An immutable version of the data; changes make a new one."""

    spark: SparkSession
    collections: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None

    def __post_init__(self):
        if self.edges is None:
            object.__setattr__(self, "edges", self.spark.createDataFrame([], EDGE_SCHEMA))

    def collection(self, name: str) -> DataFrame:
        if name not in self.collections:
            # Collections need no declaration: an unknown one is empty.
            return self.spark.createDataFrame([], "_collection string, _key string, _id string")
        return self.collections[name]

    def all(self) -> DataFrame:
        """Every node of every collection; fields of one name need compatible types."""
        parts = [self.collections[n] for n in sorted(self.collections)]
        if not parts:
            return self.collection("")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(forget_keys, parts)) if len(parts) > 1 else parts[0]

    def at(self, slugs: list[str]) -> DataFrame:
        """The nodes of these ids. Only the collections that they name are read, if all of them are known."""
        names = sorted({s.split("/")[0] for s in slugs})
        if not names or not set(names) <= set(self.collections):
            df = self.all()
            return df.filter(has_id(df, slugs))
        parts = [self.collections[n] for n in names]
        parts = [df.filter(has_id(df, slugs)) for df in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(forget_keys, parts))

    def ids(self) -> DataFrame:
        """_id, _key and _collection of all nodes: no other column is read."""
        parts = [self.collections[n].select("_id", "_key", "_collection") for n in sorted(self.collections)]
        return reduce(DataFrame.union, parts) if parts else self.collection("")

    def with_collection(self, name: str, df: DataFrame | None) -> Graph:
        rest = {k: v for k, v in self.collections.items() if k != name}
        return replace(self, collections=rest if df is None else rest | {name: forget_keys(df)})

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)


def as_collection(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as the nodes of a collection: _collection, _key (of column key) and _id in front.

    Where the key is a whole number, _key and _id carry its column's name, so that a
    lookup is planned on that column and reaches the scan.
    """
    k = F.col(key).cast("string")
    rest = [c for c in df.columns if c not in SYSTEM_FIELDS]
    whole = isinstance(df.schema[key].dataType, T.IntegralType) and key in rest
    meta = lambda prefix: {"metadata": {NATIVE: key, "prefix": prefix}} if whole else {}
    return df.select(F.lit(name).alias("_collection"), k.alias("_key", **meta("")), F.concat(F.lit(name + "/"), k).alias("_id", **meta(name + "/")), *rest)


#: Metadata of a column that spells another one: that one's name, and what stands in front.
NATIVE = "spells"


def forget_keys(df: DataFrame) -> DataFrame:
    """After a change, or within a union, the spelt column is no longer sure to hold the key."""
    for f in df.schema.fields:
        if NATIVE in (f.metadata or {}):
            df = df.withMetadata(f.name, {})
    return df


def spelt(f: T.StructField, columns, texts) -> tuple[str, list[int]] | None:
    """For a column that spells whole numbers: the column of the numbers, and those that the texts spell."""
    name, prefix = (f.metadata or {}).get(NATIVE), (f.metadata or {}).get("prefix", "")
    if name is None or name not in columns or not all(isinstance(t, str) for t in texts):
        return None
    found = []
    for t in texts:
        n = t.removeprefix(prefix)
        if t.startswith(prefix) and re.fullmatch("-?[0-9]{1,18}", n) and str(int(n)) == n:
            found.append(int(n))
    return name, found


def has_id(df: DataFrame, slugs, field: str = "_id"):
    """A filter on _id (or _key), on the native key where there is one."""
    slugs = list(slugs)
    native = spelt(df.schema[field], df.columns, slugs)
    if native is None:
        return F.col(field).isin(slugs) if slugs else F.lit(False)
    return F.col(f"`{native[0]}`").isin(native[1]) if native[1] else F.lit(False)


def as_edges(df: DataFrame, src, dst, kind: str, strength=None, meta=None) -> DataFrame:
    one = F.lit(1.0) if strength is None else strength
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), one.cast("float").alias("strength"), (F.lit(None) if meta is None else meta).cast("string").alias("meta"))
