"""The star-schema tables as a multi-model database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, as_collection, as_edges

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}


def place_lat(k):
    return F.lit(-37.6) - (k % 600) * 0.001


def place_lon(k):
    return F.lit(144.5) + (k % 1000) * 0.001


def point_geojson(lon, lat):
    return F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = _read(spark, sf_dir, name)
    if name == "conversations":
        df = df.withColumn("__key", F.concat_ws("-", "conv_id", "turn"))
        return as_collection(df, name, "__key").drop("__key")
    if name == "customer":
        k = F.col("c_custkey")
        df = df.withColumn("geometry", point_geojson(place_lon(k), place_lat(k)))
    if name == "supplier":
        # A square of 0.02 degrees around a place.
        k = F.col("s_suppkey")
        x, y = place_lon(k * 7), place_lat(k * 5)
        corner = lambda dx, dy: F.concat(F.lit("["), (x + dx).cast("string"), F.lit(","), (y + dy).cast("string"), F.lit("]"))
        ring = F.concat_ws(",", corner(-0.01, -0.01), corner(0.01, -0.01), corner(0.01, 0.01), corner(-0.01, 0.01), corner(-0.01, -0.01))
        df = df.withColumn("geometry", F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))
    return as_collection(df, name, KEYS[name])


def edges(spark: SparkSession, sf_dir: str, kinds) -> DataFrame:
    """Edges of the named kinds; only the tables they come from are read."""
    slug = lambda name, key: F.concat(F.lit(name + "/"), F.col(key).cast("string"))
    read = lambda name: _read(spark, sf_dir, name)

    def ring():
        c = read("customer").select("c_custkey")
        n = c.agg(F.count("*").alias("n"))
        steps = F.explode(F.array(*[F.lit(s) for s in (7, 13, 31)]))
        r = c.crossJoin(F.broadcast(n)).withColumn("s", steps)
        return as_edges(r.withColumn("to", F.pmod(F.col("c_custkey") + F.col("s"), F.col("n"))), slug("customer", "c_custkey"), slug("customer", "to"), "near", F.col("s") / 31.0)

    makers = {
        "placed": lambda: as_edges(read("orders"), slug("customer", "o_custkey"), slug("orders", "o_orderkey"), "placed"),
        "contains": lambda: as_edges(read("lineitem"), slug("orders", "l_orderkey"), slug("part", "l_partkey"), "contains", F.col("l_quantity")),
        "supplied_by": lambda: as_edges(read("lineitem"), slug("orders", "l_orderkey"), slug("supplier", "l_suppkey"), "supplied_by"),
        "supplies": lambda: as_edges(read("lineitem").select("l_suppkey", "l_partkey").distinct(), slug("supplier", "l_suppkey"), slug("part", "l_partkey"), "supplies"),
        "customer_in": lambda: as_edges(read("customer"), slug("customer", "c_custkey"), slug("nation", "c_nationkey"), "in_nation"),
        "supplier_in": lambda: as_edges(read("supplier"), slug("supplier", "s_suppkey"), slug("nation", "s_nationkey"), "in_nation"),
        "in_region": lambda: as_edges(read("nation"), slug("nation", "n_nationkey"), slug("region", "n_regionkey"), "in_region"),
        "near": ring,
        "child_of": lambda: as_edges(read("part").filter("p_partkey > 0").withColumn("up", F.floor((F.col("p_partkey") - 1) / 2)), slug("part", "p_partkey"), slug("part", "up"), "child_of"),
        "line": lambda: as_edges(read("part").withColumn("to", F.col("p_partkey") + 1), slug("part", "p_partkey"), slug("part", "to"), "line"),
        "next": lambda: as_edges(read("conversations"), F.concat(F.lit("conversations/"), F.concat_ws("-", "conv_id", "turn")), F.concat(F.lit("conversations/"), F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1)), "next"),
    }
    return reduce(DataFrame.unionByName, [makers[k]() for k in kinds])


def graph(spark: SparkSession, sf_dir: str, names=(), kinds=()) -> Graph:
    g = Graph(spark, {n: collection(spark, sf_dir, n) for n in names})
    return g.with_edges(edges(spark, sf_dir, kinds)) if kinds else g
