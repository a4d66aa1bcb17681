"""Traversal as joins over the edge table.

Set-valued operators take and return node tables with the columns _id, _key and
_collection. Traversal reads the edge columns it needs; node attributes are joined at the end.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph

_DEEP = 3
#: Levels of a search that are kept apart before they are merged with the older ones.
_RECENT = 8


def shared_folder(spark) -> str:
    """The folder that all executors share: spark.checkpoint.dir. One of this machine serves a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="latticeon-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_folder(df.sparkSession)}/ckpt-{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def typed(edges: DataFrame, kind: str | None = None, min_strength: float | None = None) -> DataFrame:
    e = edges if kind is None else edges.filter(F.col("type") == kind)
    return e if min_strength is None else e.filter(F.col("strength") >= min_strength)


def _oriented(edges: DataFrame, backward: bool) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges.select("src", "dst")


def hop(graph: Graph, starts: DataFrame, kind: str | None = None, backward: bool = False, min_strength: float | None = None) -> DataFrame:
    """Distinct existing neighbours of starts; min_strength applies to the edge that is followed."""
    e = _oriented(typed(graph.edges, kind, min_strength), backward)
    ends = e.join(starts.select(F.col("_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("_id")).distinct()
    return graph.ids().join(ends, "_id", "left_semi")


def hops(graph: Graph, starts: DataFrame, n: int, kind: str | None = None, low: int = 0, backward: bool = False) -> DataFrame:
    """Breadth first up to depth n, each node at its first depth; depths from low. low=0 includes the starts.

    With low >= 1 a start may be reached again over a cycle. Each level is one join and one anti-join.
    """
    e = _oriented(typed(graph.edges, kind), backward)
    frontier = starts.select("_id").distinct()
    seen = frontier.select("_id", F.lit(0).alias("depth")) if low == 0 else None
    for depth in range(1, n + 1):
        ends = e.join(frontier.select(F.col("_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("_id")).distinct()
        frontier = ends if seen is None else ends.join(seen, "_id", "left_anti")
        if depth % _DEEP == 0:
            frontier = cut_lineage(frontier)
        level = frontier.select("_id", F.lit(depth).alias("depth"))
        seen = level if seen is None else seen.union(level)
        if depth % _DEEP == 0:
            seen = cut_lineage(seen)
    reached = (seen if seen is not None else frontier.select("_id", F.lit(0).alias("depth"))).filter(F.col("depth") >= low)
    return graph.ids().join(reached, "_id")


def leaves(graph: Graph, nodes: DataFrame) -> DataFrame:
    return nodes.join(graph.edges.select(F.col("src").alias("_id")), "_id", "left_anti")


def roots(graph: Graph, nodes: DataFrame) -> DataFrame:
    return nodes.join(graph.edges.select(F.col("dst").alias("_id")), "_id", "left_anti")


def walk_counts(graph: Graph, starts: DataFrame, legs) -> DataFrame:
    """Number of walks from starts to each end (_id, walks), without a row per walk.

    legs: (type, low, high, backward) each. Between hops the frontier is summed per node, so
    the work follows edges and nodes, not paths.
    """
    known = graph.ids().select(F.col("_id").alias("dst"))
    front = starts.groupBy("_id").agg(F.count("*").alias("walks"))
    for kind, low, high, backward in legs:
        e = _oriented(typed(graph.edges, kind), backward)
        total = front if low == 0 else None
        for depth in range(1, high + 1):
            step = e.join(front.withColumnRenamed("_id", "src"), "src").groupBy("dst").agg(F.sum("walks").alias("walks"))
            front = step.join(known, "dst", "left_semi").withColumnRenamed("dst", "_id")
            if depth >= low:
                total = front if total is None else total.unionByName(front)
        front = total if low == high else total.groupBy("_id").agg(F.sum("walks").alias("walks"))
    return front


def expand(graph: Graph, rows: DataFrame, at: Column, edge: str, kind: str | None, low: int = 1, high: int = 1, backward: bool = False, keep_edge: bool = False, carry: bool = False) -> DataFrame:
    """One row per walk of low..high edges from node `at` of each row; the end's id is column __end.

    keep_edge adds the followed edge as struct column `edge` (of single hops);
    carry extends the running arrays __keys and __strengths of the path.
    """
    e = typed(graph.edges, kind)
    e = e.select(F.col("dst" if backward else "src").alias("__from"), F.col("src" if backward else "dst").alias("__to"), *(["type", "strength", "meta"] if keep_edge else ["strength"] if carry and high == 1 else []))
    out, front = [], rows.withColumn("__at", at)
    for depth in range(1, high + 1):
        nxt = front.join(e, F.col("__at") == F.col("__from"))
        if keep_edge:
            nxt = nxt.withColumn(edge, F.struct(F.col("type"), F.col("strength"), F.col("meta")))
        if carry:
            gain = F.col("strength").cast("double") if high == 1 else F.lit(1.0)
            if high == 1 or depth == 1:
                nxt = nxt.withColumn("__strengths", F.concat("__strengths", F.array(gain)))
            if high == 1:
                nxt = nxt.withColumn("__keys", F.concat("__keys", F.array("__to")))
        nxt = nxt.withColumn("__at", F.col("__to")).drop("__from", "__to", "type", "strength", "meta")
        if depth >= low:
            out.append(nxt)
        front = nxt
    if low == 0:
        out.append(rows.withColumn("__at", at).select(*out[0].columns) if not (keep_edge or carry) else rows.withColumn("__at", at))
    got = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    if carry and high > 1:
        got = got.withColumn("__keys", F.concat("__keys", F.array("__at")))
    return got.withColumnRenamed("__at", "__end")


@contextmanager
def _fixed_partitions(spark):
    """Without adaptive execution: a checkpoint then keeps how it is partitioned and sorted, and joins on that key move none of it."""
    key = "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set(key, was)


def shortest_path(graph: Graph, start: str, end: str):
    """Node ids and edges of a shortest directed path, or None. Ties go to the smaller predecessor.

    Edges and ids are partitioned and sorted by key once. Then it is breadth first, until the end is met or no new node is: a merge
    join per level, which shuffles new ends only and broadcasts nothing. One row per level reaches the driver, to see whether the end is met; then
    the path is walked back, a lookup in a level per node.
    """
    spark = graph.spark
    if graph.ids().filter(F.col("_id").isin(start, end)).select("_id").distinct().count() < len({start, end}):
        return None
    if start == end:
        return [start], []
    with _fixed_partitions(spark) as n:
        keyed = lambda df, key: cut_lineage(df.repartition(n, key).sortWithinPartitions(key))
        e, ids = keyed(graph.edges.select("src", "dst"), "src"), keyed(graph.ids().select("_id"), "_id")
        frontier = cut_lineage(spark.range(1).select(F.lit(start).alias("_id")))
        levels, old, recent = [], [], [frontier]
        while True:
            ends = e.join(frontier.select(F.col("_id").alias("src")).hint("merge"), "src").groupBy("dst").agg(F.min("src").alias("parent"))
            # Cut here: else the optimizer moves the semi- and anti-joins below the aggregate, onto all edges. Ends that are not new or no nodes may count as seen.
            ends = cut_lineage(ends.select(F.col("dst").alias("_id"), "parent"))
            frontier = ends.join(ids.hint("merge"), "_id", "left_semi")
            for seen in [reduce(DataFrame.union, recent), *old]:
                frontier = frontier.join(seen.hint("merge"), "_id", "left_anti")
            met = frontier.agg(F.max(F.col("_id") == end)).first()[0]
            if met is None:
                return None
            levels.append(ends)
            if met:
                break
            if len(recent) == _RECENT:
                old, recent = [keyed(reduce(DataFrame.union, [*old, *recent]), "_id")], []
            recent.append(ends.select("_id"))
        path = [end]
        for level in reversed(levels):
            path.append(level.filter(F.col("_id") == path[-1]).select("parent").collect()[0][0])  # one row: a level has an end once
    path.reverse()
    pairs = list(zip(path, path[1:]))
    wanted = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, src string, dst string")
    best = graph.edges.join(F.broadcast(wanted), ["src", "dst"]).groupBy("i", "src", "dst").agg(F.min(F.struct("type", "strength")).alias("x"))  # the hops of one path
    found = sorted(best.collect())
    return path, [{"from": r["src"], "to": r["dst"], "type": r["x"]["type"], "strength": float(r["x"]["strength"])} for r in found]


# ── listing edges ────────────────────────────────────────────────────────────


def edges_from(graph: Graph, slug: str) -> DataFrame:
    return graph.edges.filter(F.col("src") == slug)


def edges_to(graph: Graph, slug: str) -> DataFrame:
    return graph.edges.filter(F.col("dst") == slug)


def edges_between(graph: Graph, a: str, b: str) -> DataFrame:
    return graph.edges.filter((F.col("src") == a) & (F.col("dst") == b))


def edges_from_collection(graph: Graph, name: str) -> DataFrame:
    return graph.edges.join(graph.collection(name).select(F.col("_id").alias("src")), "src", "left_semi").select("src", "dst", "type", "strength", "meta")


def edge_types_from(graph: Graph, slug: str) -> DataFrame:
    return edges_from(graph, slug).select("type").distinct().orderBy("type")


def edge_types_from_collection(graph: Graph, name: str) -> DataFrame:
    return edges_from_collection(graph, name).select("type").distinct().orderBy("type")


def edge_schema(graph: Graph) -> DataFrame:
    """from_collection, type, to_collection, count of edges between existing nodes."""
    side = lambda end, name: graph.ids().select(F.col("_id").alias(end), F.col("_collection").alias(name))
    e = graph.edges.select("src", "dst", "type").groupBy("src", "dst", "type").agg(F.count("*").alias("n"))
    both = e.join(side("src", "from_collection"), "src").join(side("dst", "to_collection"), "dst")
    return both.groupBy("from_collection", "type", "to_collection").agg(F.sum("n").alias("count")).orderBy("from_collection", "type", "to_collection")


def edge_collect(graph: Graph, starts: DataFrame, kind: str | None = None) -> DataFrame:
    """Neighbours of starts with one edge each: the one from the smallest source."""
    e = typed(graph.edges, kind).join(starts.select(F.col("_id").alias("src")), "src", "left_semi")
    one = e.groupBy("dst").agg(F.min(F.struct("src", "type", "strength", "meta")).alias("edge"))
    return graph.ids().join(one.withColumnRenamed("dst", "_id"), "_id")
