"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import DB
from .functions import geo, text, vector
from .operators import graph as G
from .sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def db(spark, d: str, names=(), kinds=()) -> DB:
    return DB(spark, graph=tables.graph(spark, d, names, kinds))


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def text_query(name: str, names, kinds, statement: str, sql: str, rounded: dict[str, int] | None = None, params=None):
    def run(spark, d):
        df = db(spark, d, names, kinds).query(statement, params(spark, d) if callable(params) else params)
        for c, n in (rounded or {}).items():
            df = df.withColumn(c, F.round(c, n))
        return df

    add(name, sql)(run)


def simple(name: str, table: str, statement: str, sql: str, rounded=None, params=None):
    text_query(name, (table,), (), statement, sql, rounded, params)


# ── scans, projection ──
simple("scan_collection", "customer", "SELECT _key, c_name, c_acctbal FROM customer", "SELECT cast(c_custkey AS VARCHAR) AS _key, c_name, c_acctbal FROM customer")
simple("point_lookup", "orders", "SELECT _key, o_totalprice FROM orders WHERE _key = '42'", "SELECT cast(o_orderkey AS VARCHAR) AS _key, o_totalprice FROM orders WHERE o_orderkey = 42")
simple("parameters", "orders", "SELECT _key, o_totalprice FROM orders WHERE o_orderpriority = $1 AND o_totalprice > $2 ORDER BY o_totalprice DESC LIMIT $3", "SELECT cast(o_orderkey AS VARCHAR) AS _key, o_totalprice FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 7", params=lambda s, d: [s.read.parquet(f"{d}/orders.parquet").agg(F.min("o_orderpriority")).first()[0], 1000, 7])
simple("select_distinct", "customer", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
simple("json_path_text", "events", "SELECT _key, props->>'k' AS k FROM events WHERE props->'k' > 50", "SELECT cast(event_id AS VARCHAR) AS _key, json_extract_string(props, '$.k') AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50")
simple("json_path_obj", "events", "SELECT _key, props->'k' AS k FROM events WHERE event_type = 'click'", "SELECT cast(event_id AS VARCHAR) AS _key, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click'")


@add("scan_all_counts", "SELECT _collection, count(*) AS n FROM (SELECT 'customer' AS _collection FROM customer UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'part' FROM part) GROUP BY 1")
def scan_all_counts(spark, d):
    return db(spark, d, ("customer", "supplier", "part")).query("SELECT _collection, COUNT(*) AS n FROM ALL GROUP BY _collection")


@add("many_lookup", "SELECT 'part/' || p_partkey AS _id, p_name FROM part WHERE p_partkey IN (5, 3, 11) UNION ALL SELECT 'customer/' || c_custkey, NULL FROM customer WHERE c_custkey = 7")
def many_lookup(spark, d):
    return db(spark, d, ("part", "customer")).many(["part/5", "customer/7", "part/3", "part/11", "part/none"]).select("_id", "p_name").frame


@add("edges_from", "SELECT 'customer/' || o_custkey AS src, 'orders/' || o_orderkey AS dst, 'placed' AS type FROM orders WHERE o_custkey = 7")
def edges_from(spark, d):
    return db(spark, d, (), ("placed",)).edges_from("customer/7").select("src", "dst", "type")


@add("edges_to", "SELECT 'orders/' || l_orderkey AS src, cast(l_quantity AS DOUBLE) AS strength FROM lineitem WHERE l_partkey = 9")
def edges_to(spark, d):
    return db(spark, d, (), ("contains",)).edges_to("part/9").select("src", F.col("strength").cast("double").alias("strength"))


_SCHEMA_SQL = """SELECT 'customer' AS from_collection, 'in_nation' AS type, 'nation' AS to_collection, count(*) AS count FROM customer
UNION ALL SELECT 'customer', 'placed', 'orders', count(*) FROM orders UNION ALL SELECT 'nation', 'in_region', 'region', count(*) FROM nation
UNION ALL SELECT 'supplier', 'in_nation', 'nation', count(*) FROM supplier"""
_SCHEMA = (("customer", "orders", "nation", "region", "supplier"), ("placed", "customer_in", "supplier_in", "in_region"))


@add("edge_schema", _SCHEMA_SQL)
def edge_schema(spark, d):
    return db(spark, d, *_SCHEMA).edge_schema()


@add("show_edges", f"SELECT * FROM ({_SCHEMA_SQL}) WHERE from_collection = 'customer'")
def show_edges(spark, d):
    return db(spark, d, *_SCHEMA).query("SHOW EDGES FROM customer")


@add("show_tables", "SELECT 'nation' AS name, count(*) AS count FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def show_tables(spark, d):
    return db(spark, d, ("nation", "part")).query("SHOW TABLES").select("name", "count")


# ── filters ──
_C = "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer WHERE "
_FILTERS = {
    "eq": ("c_mktsegment = 'BUILDING'", "c_mktsegment = 'BUILDING'"),
    "eq_wrong_kind": ("c_name = 5", "false"),
    "neq_null_safe": ("c_mktsegment != 'BUILDING' AND nothing != 3", "c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    "range": ("c_acctbal > 1000 AND c_acctbal <= 5000.5", "c_acctbal > 1000 AND c_acctbal <= 5000.5"),
    "range_of_text": ("c_name > 'A'", "false"),
    "between": ("c_acctbal BETWEEN -100 AND 900", "c_acctbal BETWEEN -100 AND 900"),
    "in": ("c_nationkey IN (1, 3, 5)", "c_nationkey IN (1, 3, 5)"),
    "not_in": ("c_nationkey NOT IN (1, 3, 5) AND nothing NOT IN (2)", "c_nationkey NOT IN (1, 3, 5)"),
    "any_list": ("c_nationkey = ANY([2, 4])", "c_nationkey IN (2, 4)"),
    "like": ("c_name LIKE '%omer%7%'", "regexp_matches(c_name, 'omer.*7')"),
    "like_underscore": ("c_name LIKE 'r_0'", "contains(c_name, 'r_0')"),
    "ilike": ("c_mktsegment ILIKE '%BUILD%'", "contains(lower(c_mktsegment), 'build')"),
    "is_null": ("nothing IS NULL AND c_name IS NOT NULL", "c_name IS NOT NULL"),
    "not_group": ("NOT (c_acctbal > 0 AND c_nationkey = 3)", "NOT (c_acctbal > 0 AND c_nationkey = 3)"),
    "not_keeps_missing": ("NOT (nothing > 5)", "true"),
    "or_and_precedence": ("c_nationkey = 1 OR c_nationkey = 2 AND c_acctbal < 0", "c_nationkey = 1 OR (c_nationkey = 2 AND c_acctbal < 0)"),
}
for _n, (_where, _sql) in _FILTERS.items():
    simple("filter_" + _n, "customer", f"SELECT _key FROM customer WHERE {_where}", _C + _sql)
simple("filter_any_param", "customer", "SELECT _key FROM customer WHERE c_nationkey = ANY($1)", _C + "c_nationkey IN (6, 8)", params=[[6, 8]])
simple("filter_date_part", "orders", "SELECT _key FROM orders WHERE YEAR(o_orderdate) = 1995 AND MONTH(o_orderdate) >= 6", "SELECT cast(o_orderkey AS VARCHAR) AS _key FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) >= 6")


@add("filter_array_contains", "SELECT cast(o_custkey AS VARCHAR) AS _key FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'P')")
def filter_array_contains(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("_key")).agg(F.collect_set("o_orderstatus").alias("states"))
    g = db(spark, d)
    g.graph = g.graph.with_collection("c", o.select("_key", F.concat(F.lit("c/"), "_key").alias("_id"), F.lit("c").alias("_collection"), "states"))
    return g.query("SELECT _key FROM c WHERE states @> ['F', 'P']")


# ── order ──
simple("order_multi", "customer", "SELECT _key, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC LIMIT 25", "SELECT cast(c_custkey AS VARCHAR) AS _key, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, 'customer/' || c_custkey LIMIT 25")
simple("limit_offset", "customer", "SELECT _key FROM customer ORDER BY c_acctbal DESC LIMIT 10 OFFSET 5", "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer ORDER BY c_acctbal DESC, 'customer/' || c_custkey LIMIT 10 OFFSET 5")
simple("order_json_path", "events", "SELECT _key FROM events ORDER BY props->>'k' DESC LIMIT 20", "SELECT cast(event_id AS VARCHAR) AS _key FROM events ORDER BY json_extract_string(props, '$.k') DESC, 'events/' || event_id LIMIT 20")
simple("order_score_expr", "part", "SELECT _key, p_retailprice * 0.5 + p_size * 10 AS score FROM part ORDER BY score LIMIT 15", "SELECT cast(p_partkey AS VARCHAR) AS _key, round(p_retailprice * 0.5 + p_size * 10, 6) AS score FROM part ORDER BY p_retailprice * 0.5 + p_size * 10 DESC, 'part/' || p_partkey LIMIT 15", {"score": 6})

_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_DOT = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
_COS = f"1 - {_DOT} / ({_NORM.format('embedding')} * {_NORM.format('q')})"


def query_vector(spark, d):
    return [[float(x) for x in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id = 0").first()["embedding"]]]


for _n, _op, _d in (("cosine", "<=>", _COS), ("l2", "<->", "list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]) ** 2))"), ("dot", "<#>", f"-({_DOT})"), ("l1", "<+>", "list_sum(list_transform(list_zip(embedding, q), lambda x: abs(x[1]::DOUBLE - x[2])))")):
    simple(f"order_vector_{_n}", "embeddings", f"SELECT _key FROM embeddings ORDER BY embedding {_op} $1 ASC LIMIT 10", f"SELECT cast(vec_id AS VARCHAR) AS _key FROM embeddings, {_Q} ORDER BY round({_d}, 9), 'embeddings/' || vec_id LIMIT 10", params=query_vector)

# ── aggregation ──
simple("agg_count_star", "orders", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
simple("agg_sum_avg", "orders", "SELECT SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean, SUM(nothing) AS none FROM orders", "SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, 0.0::DOUBLE AS none FROM orders", {"total": 2, "mean": 4})
simple("agg_min_max", "part", "SELECT MIN(p_size) AS lo, MAX(p_retailprice) AS hi, COUNT(p_name) AS named FROM part", "SELECT min(p_size)::DOUBLE AS lo, max(p_retailprice) AS hi, count(p_name) AS named FROM part")
simple("group_by_multi", "customer", "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n, AVG(c_acctbal) AS mean FROM customer GROUP BY c_nationkey, c_mktsegment", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL", {"mean": 4})
simple("group_having", "customer", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 60 AND MAX(c_acctbal) > 9000", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60 AND max(c_acctbal) > 9000")
simple("group_order_limit", "orders", "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC LIMIT 10", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10", {"total": 2})
simple("group_by_alias_expr", "orders", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY y", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
simple("agg_count_distinct", "orders", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", "SELECT count(DISTINCT o_custkey) AS n FROM orders")

# ── scalars ──
simple("str_funcs", "part", "SELECT _key, LENGTH(p_name) AS n, LOWER(p_brand) AS lo, UPPER(p_name) AS up, TRIM(p_type) AS t FROM part", "SELECT cast(p_partkey AS VARCHAR) AS _key, length(p_name)::INTEGER AS n, lower(p_brand) AS lo, upper(p_name) AS up, trim(p_type) AS t FROM part")
simple("substring_replace_concat", "part", "SELECT _key, SUBSTRING(p_name, 2, 4) AS s, REPLACE(p_name, 'a', 'oo') AS r, CONCAT(p_name, '!') AS c FROM part", "SELECT cast(p_partkey AS VARCHAR) AS _key, substring(p_name, 2, 4) AS s, replace(p_name, 'a', 'oo') AS r, p_name || '!' AS c FROM part")
simple("date_parts", "events", "SELECT _key, YEAR(ts) AS y, QUARTER(ts) AS q, MONTH(ts) AS m, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s, DOW(ts) AS w FROM events", "SELECT cast(event_id AS VARCHAR) AS _key, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS w FROM events")
simple("date_trunc", "events", "SELECT _key, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('month', ts) AS m FROM events", "SELECT cast(event_id AS VARCHAR) AS _key, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS h, strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%SZ') AS m FROM events")
simple("case_when", "part", "SELECT _key, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS c FROM part", "SELECT cast(p_partkey AS VARCHAR) AS _key, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS c FROM part")
simple("safe_div", "part", "SELECT _key, p_retailprice / (p_size - 1) + nothing AS x FROM part", "SELECT cast(p_partkey AS VARCHAR) AS _key, round(CASE WHEN p_size = 1 THEN 0.0 ELSE p_retailprice / (p_size - 1) END, 6) AS x FROM part", {"x": 6})
simple("age_days_fixed_now", "labels", "SELECT _key, AGE_DAYS(doc_id, 8640000) AS days, AGE_HOURS(doc_id, 8640000) AS hours FROM labels", "SELECT cast(doc_id AS VARCHAR) AS _key, trunc((8640000 - doc_id) / 86400)::BIGINT AS days, trunc((8640000 - doc_id) / 3600)::BIGINT AS hours FROM labels")

# ── joins ──
text_query("multi_from_cross", ("region", "nation"), ("in_region",), "SELECT a.r_name AS region, n.n_name AS nation, b.r_name AS own FROM region AS a, MATCH (n:nation)-[:in_region]->(b:region)", "SELECT a.r_name AS region, n_name AS nation, b.r_name AS own FROM region a, nation JOIN region b ON n_regionkey = b.r_regionkey")
text_query("match_semi_end_filter", ("customer", "nation"), ("customer_in",), "MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 9900 AND n.n_regionkey = 1 RETURN n", "SELECT 'nation' AS _collection, cast(n_nationkey AS VARCHAR) AS _key, 'nation/' || n_nationkey AS _id, n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
text_query("with_rowref_join", ("customer", "orders", "supplier"), ("placed",), "MATCH (c:customer WHERE c_acctbal > 5000)-[:placed]->(o:orders) WITH c.c_nationkey AS k, SUM(o.o_totalprice) AS spent MATCH (s:supplier WHERE s_nationkey = k) RETURN k AS nation, spent AS spent, s._key AS supplier", "SELECT k AS nation, round(spent, 2) AS spent, cast(s_suppkey AS VARCHAR) AS supplier FROM (SELECT c_nationkey AS k, sum(o_totalprice) AS spent FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1) JOIN supplier ON s_nationkey = k", {"spent": 2})


@add("set_union", "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 3")
def set_union(spark, d):
    c = db(spark, d, ("customer",)).collection("customer")
    return c.where_gt("c_acctbal", 9000).union(c.where_eq("c_nationkey", 3)).select("_key").frame


@add("set_intersect", "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 3")
def set_intersect(spark, d):
    c = db(spark, d, ("customer",)).collection("customer")
    return c.where_gt("c_acctbal", 5000).intersect(c.where_eq("c_nationkey", 3)).select("_key").frame


@add("set_subtract_anti", "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 3")
def set_subtract(spark, d):
    c = db(spark, d, ("customer",)).collection("customer")
    return c.where_gt("c_acctbal", 5000).subtract(c.where_eq("c_nationkey", 3)).select("_key").frame


# ── graph: sets ──
_IDS = "SELECT DISTINCT '{0}/' || {1} AS _id "


@add("hop_forward", _IDS.format("orders", "o_orderkey") + "FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5")
def hop_forward(spark, d):
    g = tables.graph(spark, d, ("customer", "orders"), ("placed",))
    return G.hop(g, g.collection("customer").filter("c_nationkey = 5"), "placed").select("_id")


@add("hop_backward", _IDS.format("orders", "l_orderkey") + "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1")
def hop_backward(spark, d):
    g = tables.graph(spark, d, ("part", "orders"), ("contains",))
    return G.hop(g, g.collection("part").filter("p_size = 1"), "contains", backward=True).select("_id")


@add("min_strength", _IDS.format("part", "l_partkey") + "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 30")
def min_strength(spark, d):
    g = tables.graph(spark, d, ("part", "orders"), ("contains",))
    return G.hop(g, g.collection("orders"), "contains", min_strength=30.0).select("_id")


_RING = "ring AS (SELECT c_custkey AS a, (c_custkey + s) % (SELECT count(*) FROM customer) AS b FROM customer, (VALUES (7), (13), (31)) t(s))"
_BFS = "WITH RECURSIVE " + _RING + ", walk AS (SELECT 0::BIGINT AS v, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN ring ON a = v WHERE depth < 5), first AS (SELECT v, min(depth) AS depth FROM walk {0} GROUP BY v) SELECT 'customer/' || v AS _id, depth FROM first {1}"


@add("bfs_hops", _BFS.format("", ""))
def bfs_hops(spark, d):
    g = tables.graph(spark, d, ("customer",), ("near",))
    return G.hops(g, g.collection("customer").filter("c_custkey = 0"), 5).select("_id", "depth")


@add("bfs_typed_depth", _BFS.format("WHERE depth > 0", "WHERE depth BETWEEN 3 AND 5"))
def bfs_typed_depth(spark, d):
    g = tables.graph(spark, d, ("customer",), ("near",))
    return G.hops(g, g.collection("customer").filter("c_custkey = 0"), 5, "near", low=3).select("_id", "depth")


@add("root_cause_chain", "WITH RECURSIVE up AS (SELECT 200::BIGINT AS v, 0 AS depth UNION ALL SELECT (v - 1) // 2, depth + 1 FROM up WHERE v > 0 AND depth < 12) SELECT 'part/' || v AS _id, depth FROM up")
def root_cause_chain(spark, d):
    g = tables.graph(spark, d, ("part",), ("child_of",))
    return G.hops(g, g.collection("part").filter("p_partkey = 200"), 12, "child_of").select("_id", "depth")


@add("leaves", "SELECT 'customer/' || c_custkey AS _id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def leaves(spark, d):
    g = tables.graph(spark, d, ("customer",), ("placed",))
    return G.leaves(g, g.collection("customer")).select("_id")


@add("roots", "SELECT 'part/' || p_partkey AS _id FROM part WHERE p_partkey NOT IN (SELECT (p_partkey - 1) // 2 FROM part WHERE p_partkey > 0)")
def roots(spark, d):
    g = tables.graph(spark, d, ("part",), ("child_of",))
    return G.roots(g, g.collection("part")).select("_id")


@add("match_union", "SELECT DISTINCT 'nation/' || k AS _id FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9990 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def match_union(spark, d):
    return db(spark, d, ("customer", "supplier", "nation"), ("customer_in", "supplier_in")).query("MATCH (c:customer)-[:in_nation]->(n:nation) WHERE c.c_acctbal > 9990 RETURN n UNION MATCH (s:supplier)-[:in_nation]->(n:nation) WHERE s.s_acctbal > 9000 RETURN n").select("_id")


@add("edge_collect", "SELECT 'nation/' || c_nationkey AS _id, min('customer/' || c_custkey) AS src FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
def edge_collect(spark, d):
    c = db(spark, d, ("customer", "nation"), ("customer_in",)).collection("customer").where_gt("c_acctbal", 9000)
    return c.edge_collect("in_nation").select("_id", F.col("edge.src").alias("src"))


# ── graph: paths ──
text_query("path_group_sum", ("nation", "customer", "orders"), ("placed", "customer_in"), "SELECT n.n_name AS nation, COUNT(*) AS orders, SUM(o.o_totalprice) AS total FROM MATCH (n:nation)<-[:in_nation]-(c:customer)-[:placed]->(o:orders) GROUP BY n.n_name ORDER BY nation", "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1", {"total": 2})
text_query("path_two_hop_sum", ("customer", "orders", "part"), ("placed", "contains"), "SELECT c.c_mktsegment AS segment, SUM(r.strength * p.p_retailprice) AS value FROM MATCH (c:customer)-[:placed]->(o:orders)-[r:contains]->(p:part) WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment", "SELECT c_mktsegment AS segment, round(sum(l_quantity * p_retailprice), 2) AS value FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1", {"value": 2})
text_query("walk_var_depth", ("part",), ("child_of",), "SELECT b._key AS k, COUNT(*) AS n FROM MATCH (a:part)-[:child_of*1..3]->(b:part) WHERE a.p_size = 7 GROUP BY b._key", "WITH RECURSIVE w AS (SELECT p_partkey AS v, 0 AS d FROM part WHERE p_size = 7 UNION ALL SELECT (v - 1) // 2, d + 1 FROM w WHERE v > 0 AND d < 3) SELECT cast(v AS VARCHAR) AS k, count(*) AS n FROM w WHERE d > 0 GROUP BY 1")


@add("walk_counts_frontier", "WITH RECURSIVE " + _RING + ", w AS (SELECT c_custkey AS v, 0 AS d FROM customer WHERE c_nationkey = 2 UNION ALL SELECT b, d + 1 FROM w JOIN ring ON a = v WHERE d < 4) SELECT 'customer/' || v AS _id, count(*) AS walks FROM w WHERE d >= 2 GROUP BY 1")
def walk_counts_frontier(spark, d):
    g = tables.graph(spark, d, ("customer",), ("near",))
    return G.walk_counts(g, g.collection("customer").filter("c_nationkey = 2"), [("near", 2, 4, False)])


text_query("edge_intrinsics", ("customer",), ("near",), "SELECT a._key AS start, c._key AS dest, r2._depth AS depth, PATH_PRODUCT(r2._path_strength) AS p_product, PATH_SUM(r2._path_strength) AS p_sum, PATH_AVG(r2._path_strength) AS p_avg, PATH_MIN(r2._path_strength) AS p_min, PATH_MAX(r2._path_strength) AS p_max, r2._avg_strength AS mean, r2._min_strength AS lo, r2._max_strength AS hi, PATH_FIRST(r2._path_keys) AS first, PATH_LAST(r2._path_keys) AS last, JSON_ARRAY_LENGTH(r2._path_keys) AS n FROM MATCH (a:customer)-[r:near]->(b:customer)-[r2:near]->(c:customer)", "WITH e AS (SELECT c_custkey AS a, (c_custkey + s) % (SELECT count(*) FROM customer) AS b, (s / 31.0)::FLOAT::DOUBLE AS w FROM customer, (VALUES (7), (13), (31)) t(s)) SELECT cast(x.a AS VARCHAR) AS start, cast(y.b AS VARCHAR) AS dest, 2::BIGINT AS depth, round(x.w * y.w, 6) AS p_product, round(x.w + y.w, 6) AS p_sum, round((x.w + y.w) / 2, 6) AS p_avg, round(least(x.w, y.w), 6) AS p_min, round(greatest(x.w, y.w), 6) AS p_max, round((x.w + y.w) / 2, 6) AS mean, round(least(x.w, y.w), 6) AS lo, round(greatest(x.w, y.w), 6) AS hi, 'customer/' || x.a AS first, 'customer/' || y.b AS last, 3::BIGINT AS n FROM e x JOIN e y ON x.b = y.a", {c: 6 for c in ("p_product", "p_sum", "p_avg", "p_min", "p_max", "mean", "lo", "hi")})
text_query("with_two_stage", ("customer", "orders", "nation"), ("placed", "customer_in"), "MATCH (c:customer)-[:placed]->(o:orders) WITH c, SUM(o.o_totalprice) AS spent MATCH (c)-[:in_nation]->(n:nation) RETURN n.n_name AS nation, MAX(spent) AS top, COUNT(*) AS buyers GROUP BY n.n_name", "SELECT n_name AS nation, round(max(spent), 2) AS top, count(*) AS buyers FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", {"top": 2})
text_query("match_group_multi", ("customer", "orders"), ("placed",), "MATCH (c:customer)-[:placed]->(o:orders) RETURN c.c_nationkey AS nation, o.o_orderstatus AS status, COUNT(*) AS n GROUP BY c.c_nationkey, o.o_orderstatus", "SELECT c_nationkey AS nation, o_orderstatus AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
text_query("match_no_hop", ("customer",), (), "MATCH (c:customer WHERE c_acctbal >= 9990) RETURN c.c_name AS name, c.c_acctbal AS balance", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 9990")

text_query("shortest_hops", ("conversations",), ("next",), "SELECT a.role AS start_role, r.length AS hops, PATH_LAST(r._path_keys) AS last FROM MATCH SHORTEST (a)-[r*]->(b) WHERE a._key = 'conversations/0-0' AND b._key = 'conversations/0-1'", "SELECT role AS start_role, 1::BIGINT AS hops, 'conversations/0-1' AS last FROM conversations WHERE conv_id = 0 AND turn = 0 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 0 AND turn = 1)")
text_query("shortest_ring", ("customer",), ("near",), "SELECT r.length AS hops FROM MATCH SHORTEST (a:customer)-[r*]->(b:customer) WHERE a._key = '0' AND b._key = '57'", "WITH RECURSIVE " + _RING + ", walk AS (SELECT 0::BIGINT AS v, 0 AS d UNION SELECT b, d + 1 FROM walk JOIN ring ON a = v WHERE d < 8) SELECT min(d)::BIGINT AS hops FROM walk WHERE v = 57 HAVING count(*) > 0")
text_query("shortest_predicates", ("customer",), ("near",), "SELECT r.length AS hops FROM MATCH SHORTEST (a:customer)-[r*]->(b:customer) WHERE a._key = '0' AND b._key = '14' AND ALL(n IN nodes(r) WHERE n.c_acctbal > -2000) AND NONE(n IN nodes(r) WHERE n.c_name = 'x')", "SELECT 2::BIGINT AS hops FROM customer WHERE c_custkey IN (0, 7, 14) HAVING count(*) = 3 AND bool_and(c_acctbal > -2000)")

# ── text ──
def _bm25_sql(field: str, query: str, src: str = "documents", where: str = "true") -> str:
    terms = text.query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN greatest(0, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    return f"(WITH tok AS (SELECT *, list_filter(regexp_extract_all(lower({field}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda x: strlen(x) >= 3) AS t FROM {src}), c AS (SELECT *, len(t) AS dl, {tf} FROM tok), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c) SELECT *, {part} AS bm25 FROM c, s WHERE {where})"


_B = "thing reat"
simple("bm25_topk", "documents", f"SELECT _key, BM25(text, '{_B}') AS score FROM documents ORDER BY BM25(text, '{_B}') DESC LIMIT 20", f"SELECT cast(doc_id AS VARCHAR) AS _key, round(bm25, 6) AS score FROM {_bm25_sql('text', _B)} ORDER BY round(bm25, 9) DESC, 'documents/' || doc_id LIMIT 20", {"score": 6})
simple("bm25_filter", "documents", f"SELECT _key FROM documents WHERE BM25(text, '{_B}') > 0.5", f"SELECT cast(doc_id AS VARCHAR) AS _key FROM {_bm25_sql('text', _B)} WHERE bm25 > 0.5")
simple("bm25_dual_field_score", "documents", f"SELECT _key, BM25(text, '{_B}') * 0.7 + BM25(source, 'src3') * 0.3 AS score FROM documents", f"SELECT cast(a.doc_id AS VARCHAR) AS _key, round(a.bm25 * 0.7 + b.bm25 * 0.3, 6) AS score FROM {_bm25_sql('text', _B)} a JOIN {_bm25_sql('source', 'src3')} b USING (doc_id)", {"score": 6})


def _search_db(spark, d):
    g = db(spark, d, ("documents",))
    g.execute("CREATE INDEX ON documents USING search (source, text)")
    return g


_TOK = "list_filter(regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda x: strlen(x) >= 3)"


@add("search_and", f"SELECT cast(doc_id AS VARCHAR) AS _key FROM documents WHERE list_contains({_TOK.format('text')}, 'thing') AND list_contains({_TOK.format('source')}, 'src3')")
def search_and(spark, d):
    return _search_db(spark, d).query("SELECT _key FROM documents WHERE SEARCH('thing src3')")


@add("search_typo", f"WITH t AS (SELECT doc_id, list_concat({_TOK.format('source')}, {_TOK.format('text')}) AS t FROM documents) SELECT cast(doc_id AS VARCHAR) AS _key FROM t WHERE len(list_filter(t, lambda x: levenshtein(x, 'licenzed') <= 1)) > 0 AND NOT EXISTS (SELECT 1 FROM t WHERE list_contains(t, 'licenzed'))")
def search_typo(spark, d):
    return _search_db(spark, d).query("SELECT _key FROM documents WHERE SEARCH('licenzed')")


@add("search_score_rank", f"SELECT cast(doc_id AS VARCHAR) AS _key, 1e12 + 1e9 + 1e6 + CASE WHEN list_contains(a, 'licensed') THEN 1e3 ELSE 0 END + CASE WHEN len(a) = 1 OR len(b) = 1 THEN 1.0 WHEN least(CASE WHEN len(a) > 0 THEN len(a) ELSE 1000000 END, CASE WHEN len(b) > 0 THEN len(b) ELSE 1000000 END) > 1 THEN 1.0 / least(CASE WHEN len(a) > 0 THEN len(a) ELSE 1000000 END, len(b)) ELSE 0 END AS score FROM (SELECT doc_id, {_TOK.format('source')} AS a, {_TOK.format('text')} AS b FROM documents) WHERE list_contains(b, 'licensed') OR list_contains(a, 'licensed')")
def search_score_rank(spark, d):
    return _search_db(spark, d).query("SELECT _key, SEARCH_SCORE('licensed') AS score FROM documents WHERE SEARCH('licensed')")


# ── vectors ──
simple("vector_near", "embeddings", "SELECT _key FROM embeddings WHERE VECTOR_NEAR(embedding, $1, 10)", f"SELECT cast(vec_id AS VARCHAR) AS _key FROM embeddings, {_Q} ORDER BY {_COS}, 'embeddings/' || vec_id LIMIT 10", params=query_vector)
simple("vector_near_prefilter", "embeddings", "SELECT _key FROM embeddings WHERE label = 3 AND VECTOR_NEAR(embedding, $1, 8)", f"SELECT cast(vec_id AS VARCHAR) AS _key FROM embeddings, {_Q} WHERE label = 3 ORDER BY {_COS}, 'embeddings/' || vec_id LIMIT 8", params=query_vector)
simple("vector_near_postfilter", "embeddings", "SELECT _key FROM embeddings WHERE VECTOR_NEAR(embedding, $1, 40) AND label = 3", f"SELECT cast(vec_id AS VARCHAR) AS _key FROM (SELECT * FROM embeddings, {_Q} ORDER BY {_COS}, 'embeddings/' || vec_id LIMIT 40) WHERE label = 3", params=query_vector)
simple("hybrid_vector_score", "embeddings", "SELECT _key, VECTOR_COSINE(embedding, $1) * 0.8 + label * 0.02 AS score FROM embeddings ORDER BY score DESC LIMIT 12", f"SELECT cast(vec_id AS VARCHAR) AS _key, round((1 - ({_COS})) * 0.8 + label * 0.02, 6) AS score FROM embeddings, {_Q} ORDER BY (1 - ({_COS})) * 0.8 + label * 0.02 DESC, 'embeddings/' || vec_id LIMIT 12", {"score": 6}, query_vector)

# ── space ──
_LAT, _LON = "(-37.6 - (c_custkey % 600) * 0.001)", "(144.5 + (c_custkey % 1000) * 0.001)"
_PLACE = "144.8 -37.85"
_KM = f"2 * 6371.0 * asin(least(1, sqrt(sin(radians(-37.85 - {_LAT}) / 2) ** 2 + cos(radians({_LAT})) * cos(radians(-37.85)) * sin(radians(144.8 - {_LON}) / 2) ** 2)))"
simple("st_dwithin", "customer", f"SELECT _key FROM customer WHERE ST_DWithin(geometry, POINT({_PLACE}), 12.5)", f"{_C} {_KM} <= 12.5")
simple("st_distance_filter", "customer", f"SELECT _key FROM customer WHERE ST_Distance(geometry, geometry, POINT({_PLACE}), 9)", f"{_C} {_KM} < 9")
simple("order_distance_km", "customer", f"SELECT _key, ST_DISTANCE_KM(geometry, POINT({_PLACE})) AS km FROM customer ORDER BY -ST_DISTANCE_KM(geometry, POINT({_PLACE})) DESC LIMIT 9", f"SELECT cast(c_custkey AS VARCHAR) AS _key, round({_KM}, 6) AS km FROM customer ORDER BY round({_KM}, 9), 'customer/' || c_custkey LIMIT 9", {"km": 6})
_BOX = "POLYGON((144.6 -37.95, 144.9 -37.95, 144.9 -37.7, 144.6 -37.7, 144.6 -37.95))"
simple("st_within_polygon", "customer", f"SELECT _key FROM customer WHERE ST_Within(geometry, {_BOX})", f"{_C} {_LAT} >= -37.95 AND {_LAT} < -37.7 AND {_LON} >= 144.6 AND {_LON} < 144.9")
_SX, _SY = "(144.5 + ((s_suppkey * 7) % 1000) * 0.001)", "(-37.6 - ((s_suppkey * 5) % 600) * 0.001)"
_S = "SELECT cast(s_suppkey AS VARCHAR) AS _key FROM supplier WHERE "
simple("st_contains_point", "supplier", "SELECT _key FROM supplier WHERE ST_Contains(geometry, POINT(144.6033 -37.6733))", f"{_S} abs({_SX} - 144.6033) < 0.01 AND abs({_SY} + 37.6733) < 0.01")
simple("st_contains_polygon", "supplier", "SELECT _key FROM supplier WHERE ST_Contains(geometry, POLYGON((144.6013 -37.6733, 144.6053 -37.6733, 144.6033 -37.6703)))", f"{_S} {_SX} - 0.01 < 144.6013 AND {_SX} + 0.01 > 144.6053 AND {_SY} - 0.01 < -37.6733 AND {_SY} + 0.01 > -37.6703")
simple("st_intersects", "supplier", "SELECT _key FROM supplier WHERE ST_Intersects(geometry, POLYGON((144.6003 -37.6803, 144.7003 -37.6803, 144.7003 -37.6403, 144.6003 -37.6403)))", f"{_S} {_SX} + 0.01 > 144.6003 AND {_SX} - 0.01 < 144.7003 AND {_SY} + 0.01 > -37.6803 AND {_SY} - 0.01 < -37.6403")
simple("st_area", "supplier", "SELECT _key, ST_Area(geometry) AS km2 FROM supplier WHERE ST_Area(geometry, geometry, 3.5)", f"SELECT cast(s_suppkey AS VARCHAR) AS _key, round(0.0004 * 111.0 * 111.0 * cos(radians({_SY} - 0.002)), 4) AS km2 FROM supplier", {"km2": 4})


@add("st_centroid", f"SELECT cast(c_custkey AS VARCHAR) AS _key, round({_LON}, 6) AS lon FROM customer")
def st_centroid(spark, d):
    df = db(spark, d, ("customer",)).query("SELECT _key, ST_Centroid(geometry)->'coordinates'->>0 AS lon FROM customer")
    return df.withColumn("lon", F.round(F.col("lon").cast("double"), 6))


@add("st_length", "SELECT 's' || k AS _key, round(2 * 6371.0 * asin(sqrt(sin(radians(0.01 * k) / 2) ** 2)), 6) AS km FROM range(1, 6) t(k) WHERE 2 * 6371.0 * asin(sqrt(sin(radians(0.01 * k) / 2) ** 2)) > 2")
def st_length(spark, d):
    lines = spark.range(1, 6).select(F.lit("line").alias("_collection"), F.concat(F.lit("s"), "id").alias("_key"), F.concat(F.lit("line/s"), "id").alias("_id"), F.concat(F.lit('{"type":"LineString","coordinates":[[10,0],[10,'), (F.col("id") * 0.01).cast("string"), F.lit("]]}")).alias("geometry"))
    g = db(spark, d)
    g.graph = g.graph.with_collection("line", lines)
    return g.query("SELECT _key, ST_Length(geometry) AS km FROM line WHERE ST_Length(geometry, 2)").withColumn("km", F.round("km", 6))


@add("hybrid_spatial_graph", f"SELECT DISTINCT 'orders/' || o_orderkey AS _id FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_KM} <= 5 AND o_totalprice > 20000")
def hybrid_spatial_graph(spark, d):
    g = db(spark, d, ("customer", "orders"), ("placed",))
    return g.collection("customer").st_dwithin(-37.85, 144.8, 5).forward("placed").where_gt("o_totalprice", 20000).select("_id").frame


@add("hybrid_vector_filter_group", f"SELECT label, count(*) AS n FROM (SELECT * FROM embeddings, {_Q} ORDER BY {_COS}, 'embeddings/' || vec_id LIMIT 50) GROUP BY label")
def hybrid_vector_filter_group(spark, d):
    e = tables.graph(spark, d, ("embeddings",)).collection("embeddings")
    return vector.near(e, "embedding", query_vector(spark, d)[0], 50, "_id").groupBy("label").agg(F.count("*").alias("n"))


@add("spatial_cells", f"SELECT floor((-37600 - c_custkey % 600) / 50.0)::BIGINT AS cell_lat, floor((144500 + c_custkey % 1000) / 50.0)::BIGINT AS cell_lon, count(*) AS n FROM customer GROUP BY ALL")
def spatial_cells(spark, d):
    c = tables.graph(spark, d, ("customer",)).collection("customer")
    return c.select(*geo.cell(F.col("geometry"), 0.05)).groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"))


# ── changes ──
@add("upsert_result", "SELECT cast(r_regionkey AS VARCHAR) AS _key, CASE WHEN r_regionkey = 1 THEN 'CHANGED' ELSE r_name END AS r_name FROM region UNION ALL SELECT '99', 'NEW'")
def upsert_result(spark, d):
    g = db(spark, d, ("region",))
    g.execute("INSERT INTO region (_key, r_name) VALUES ('1', 'CHANGED'), ('99', 'NEW')")
    return g.query("SELECT _key, r_name FROM region")


@add("update_result", "SELECT cast(c_custkey AS VARCHAR) AS _key, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_result(spark, d):
    g = db(spark, d, ("customer",))
    g.execute("UPDATE customer SET c_mktsegment = 'DEBT' WHERE c_acctbal < 0")
    return g.query("SELECT _key, c_mktsegment FROM customer")


@add("delete_cascade_edges", "SELECT 'customer/' || o_custkey AS src, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY 1")
def delete_cascade_edges(spark, d):
    g = db(spark, d, ("customer", "orders"), ("placed",))
    g.execute("DELETE FROM customer WHERE c_acctbal < 0")
    return g.graph.edges.groupBy("src").agg(F.count("*").alias("n"))


@add("edge_delete", "SELECT count(*) AS n FROM nation WHERE n_nationkey <> 3")
def edge_delete(spark, d):
    g = db(spark, d, ("nation", "region"), ("in_region",))
    to = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey = 3").first()["n_regionkey"]
    g.execute(f"DELETE ('nation/3')-[:in_region]->('region/{to}')")
    return g.graph.edges.agg(F.count("*").alias("n"))


@add("match_insert_edges", "SELECT 'customer/' || c_custkey AS src, 'nation/0' AS dst, 'likes' AS type FROM customer WHERE c_acctbal > 9900")
def match_insert_edges(spark, d):
    g = db(spark, d, ("customer", "nation"))
    g.execute("MATCH (c:customer) WHERE c.c_acctbal > 9900 INSERT (c)-[:likes {strength: 2}]->('nation/0')")
    return g.graph.edges.select("src", "dst", "type")


@add("alter_rename_column", "SELECT cast(r_regionkey AS VARCHAR) AS _key, r_name AS label FROM region")
def alter_rename_column(spark, d):
    g = db(spark, d, ("region",))
    g.execute("ALTER TABLE region RENAME COLUMN r_name TO label")
    return g.query("SELECT _key, label FROM region")


@add("transaction_rollback", "SELECT count(*) AS count FROM region")
def transaction_rollback(spark, d):
    g = db(spark, d, ("region",))
    g.execute("BEGIN")
    g.execute("DELETE FROM region")
    g.execute("ROLLBACK")
    return g.query("SELECT COUNT(*) FROM region")


@add("load_frames", "SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'part_of' AS type, n_nationkey::DOUBLE AS strength FROM nation")
def load_frames(spark, d):
    g = DB(spark)
    n = spark.read.parquet(f"{d}/nation.parquet")
    g.df.load_nodes(n, "nation", "n_nationkey", {"n_name": "name"})
    g.df.load_edges(n, "n_nationkey", "n_regionkey", edge_type="part_of", source_collection="nation", target_collection="region", weight_col="n_nationkey")
    return g.graph.edges.select("src", "dst", "type", F.col("strength").cast("double").alias("strength"))


@add("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from .streaming.events import windowed

    return windowed(spark.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 4))


# ── further forms ──
simple("select_star", "nation", "SELECT * FROM nation", "SELECT 'nation' AS _collection, cast(n_nationkey AS VARCHAR) AS _key, 'nation/' || n_nationkey AS _id, * FROM nation")
simple("filter_now", "events", "SELECT COUNT(*) AS n FROM events WHERE user_id < NOW()", "SELECT count(*) AS n FROM events WHERE user_id < epoch_ms(now())")
simple("filter_null_literal", "customer", "SELECT _key FROM customer WHERE nothing = null AND c_name != null", _C + "c_name IS NOT NULL")
simple("filter_in_null", "customer", "SELECT _key FROM customer WHERE NOT (c_acctbal NOT IN (1, null)) OR c_nationkey = ANY([7])", _C + "c_acctbal IS NULL OR c_acctbal = 1 OR c_nationkey = 7")
simple("agg_first_value", "customer", "SELECT _collection, COUNT(*) AS n, SUM(c_nationkey) AS s FROM customer", "SELECT 'customer' AS _collection, count(*) AS n, sum(c_nationkey)::DOUBLE AS s FROM customer")
simple("group_star", "nation", "SELECT * FROM nation GROUP BY n_nationkey", "SELECT 'nation' AS _collection, cast(n_nationkey AS VARCHAR) AS _key, 'nation/' || n_nationkey AS _id, * FROM nation")
simple("now_and_uuid4", "region", "SELECT _key, LENGTH(NOW()) AS n, LENGTH(UUIDV4()) AS u FROM region", "SELECT cast(r_regionkey AS VARCHAR) AS _key, 20::INTEGER AS n, 36::INTEGER AS u FROM region")
simple("uuid5", "region", "SELECT _key, UUIDV5('6ba7b810-9dad-11d1-80b4-00c04fd430c8', r_name) AS u, UUIDV5('none', _key) AS v FROM region", "SELECT r AS _key, u, v FROM (VALUES " + ", ".join(f"('{i}', '{_uuid.uuid5(_uuid.NAMESPACE_DNS, n)}', '{_uuid.uuid5(_uuid.NAMESPACE_DNS, str(i))}')" for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))) + ") t(r, u, v)")
simple("trims", "part", "SELECT _key, LTRIM(CONCAT('  ', p_name, ' ')) AS l, RTRIM(CONCAT(' ', p_name, '  ')) AS r FROM part", "SELECT cast(p_partkey AS VARCHAR) AS _key, p_name || ' ' AS l, ' ' || p_name AS r FROM part")
simple("age_of_date_text", "orders", "SELECT _key, AGE_DAYS(SUBSTRING(DATE_TRUNC('day', o_orderdate), 1, 10), 1000000000) AS days FROM orders", "SELECT cast(o_orderkey AS VARCHAR) AS _key, trunc((1000000000 - epoch(date_trunc('day', o_orderdate))) / 86400)::BIGINT AS days FROM orders")
simple("vector_functions", "embeddings", "SELECT _key, VECTOR_L2(embedding, $1) AS l2, VECTOR_DOT(embedding, $1) AS dot, VECTOR_L1(embedding, $1) AS l1 FROM embeddings", f"SELECT cast(vec_id AS VARCHAR) AS _key, round(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]) ** 2)), 6) AS l2, round({_DOT}, 6) AS dot, round(list_sum(list_transform(list_zip(embedding, q), lambda x: abs(x[1]::DOUBLE - x[2]))), 6) AS l1 FROM embeddings, {_Q}", {"l2": 6, "dot": 6, "l1": 6}, query_vector)
text_query("match_now", ("nation",), (), "MATCH (n:nation) RETURN n._key AS k, NOW() * 0 AS zero", "SELECT cast(n_nationkey AS VARCHAR) AS k, 0.0::DOUBLE AS zero FROM nation")
text_query("match_array_length", ("embeddings",), (), "MATCH (e:embeddings) RETURN e._key AS k, JSON_ARRAY_LENGTH(e.embedding) AS n", "SELECT cast(vec_id AS VARCHAR) AS k, len(embedding)::BIGINT AS n FROM embeddings")
text_query("match_per_path", ("customer", "orders"), ("placed",), "SELECT c._key AS c, COUNT(*) AS n, SUM(o.o_totalprice) AS total FROM MATCH (c:customer)-[:placed]->(o:orders)", "SELECT cast(c_custkey AS VARCHAR) AS c, 1::BIGINT AS n, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey")
text_query("match_count_all", ("customer", "orders"), ("placed",), "SELECT COUNT(*) AS n FROM MATCH (c:customer)-[:placed]->(o:orders)", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey")
text_query("match_order_limit", ("customer", "orders"), ("placed",), "SELECT c._key AS c, SUM(o.o_totalprice) AS total FROM MATCH (c:customer)-[:placed]->(o:orders) GROUP BY c._key ORDER BY total DESC LIMIT 12", "SELECT cast(o_custkey AS VARCHAR) AS c, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 12", {"total": 2})
text_query("match_reverse_anchor", ("customer", "nation"), ("customer_in",), "SELECT c._key AS c, c.c_acctbal AS balance FROM MATCH (c:customer)-[:in_nation]->(n:nation) WHERE n._key = '3'", "SELECT cast(c_custkey AS VARCHAR) AS c, c_acctbal AS balance FROM customer WHERE c_nationkey = 3")
text_query("match_inline_props", ("customer", "nation"), ("customer_in",), "SELECT n.n_name AS nation, COUNT(*) AS n FROM MATCH (c:customer {c_mktsegment: 'BUILDING'})-[:in_nation]->(n:nation) GROUP BY n.n_name", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
text_query("stage_total", ("customer", "orders", "region"), ("placed",), "MATCH (c:customer)-[:placed]->(o:orders) WITH SUM(o.o_totalprice) AS total, COUNT(*) AS n MATCH (r:region) RETURN r.r_name AS region, total AS total, n AS n", "SELECT r_name AS region, round(sum(o_totalprice), 1) AS total, count(*) AS n FROM region, orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", {"total": 1})
text_query("shortest_long", ("part",), ("line",), "SELECT r.length AS hops, PATH_LAST(r._path_keys) AS last FROM MATCH SHORTEST (a:part)-[r*]->(b:part) WHERE a._key = '0' AND b._key = '70'", "SELECT 70::BIGINT AS hops, 'part/70' AS last FROM part HAVING count(*) > 70")


@add("st_asgeojson", "SELECT cast(n_nationkey AS VARCHAR) AS _key, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']}' AS g FROM nation")
def st_asgeojson(spark, d):
    g = db(spark, d, ("nation",))
    c = g.graph.collection("nation").withColumn("geometry", tables.point_geojson(F.col("n_nationkey"), F.col("n_regionkey")))
    g.graph = g.graph.with_collection("nation", c)
    return g.query("SELECT _key, ST_AsGeoJSON(geometry) AS g FROM nation")


@add("filter_boolean", "SELECT cast(c_custkey AS VARCHAR) AS _key FROM customer WHERE c_acctbal > 0")
def filter_boolean(spark, d):
    g = db(spark, d, ("customer",))
    g.graph = g.graph.with_collection("customer", g.graph.collection("customer").withColumn("rich", F.col("c_acctbal") > 0))
    return g.query("SELECT _key FROM customer WHERE rich = true AND rich != false")


@add("counters", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges, true AS has, false AS has_not, n_name AS name, 3.0::DOUBLE AS lat, 2.0::DOUBLE AS lon FROM nation WHERE n_nationkey = 3")
def counters(spark, d):
    g = db(spark, d, ("nation", "region"), ("in_region",))
    g.execute("UPDATE nation SET place = ST_GeomFromGeoJSON('{\"type\":\"Point\",\"coordinates\":[2,3]}') WHERE _key = '3'")
    lat, lon = g.centroid("nation/3", "place")
    row = (g.node_count(), g.edge_count(), g.contains("nation/3"), g.contains("nation/x"), g.get("nation/3")["n_name"], lat, lon)
    return spark.createDataFrame([row], "nodes long, edges long, has boolean, has_not boolean, name string, lat double, lon double")


@add("load_nodes", "SELECT cast(n_nationkey AS VARCHAR) AS _key, n_name AS name, n_regionkey AS region FROM nation")
def load_nodes(spark, d):
    g = DB(spark)
    g.df.load_nodes(spark.read.parquet(f"{d}/nation.parquet").toPandas(), "nation", "n_nationkey", {"n_name": "name", "n_regionkey": "region"})
    return g.query("SELECT _key, name, region FROM nation").withColumn("region", F.col("region").cast("int"))


@add("query_to_pandas", "SELECT cast(r_regionkey AS VARCHAR) AS _key, r_name FROM region")
def query_to_pandas(spark, d):
    return spark.createDataFrame(db(spark, d, ("region",)).df.query("SELECT _key, r_name FROM region"), "_key string, r_name string")


@add("create_collection", "SELECT * FROM (VALUES ('_key', 'TEXT', true), ('name', 'TEXT', false), ('born', 'INTEGER', false), ('place', 'GEO', false)) t(field, type, primary_key)")
def create_collection(spark, d):
    g = DB(spark)
    g.df.create_collection("people", {"name": "TEXT", "born": "INTEGER", "place": "GEO"}, hash_index=["name"], range_index=["born"], spatial_index=["place"])
    return g.query("SHOW people")


@add("insert_edges", "SELECT * FROM (VALUES ('nation/1', 'nation/2', 'likes', 2.5::DOUBLE, '1999'), ('nation/2', 'nation/3', 'likes', 1.0::DOUBLE, NULL)) t(src, dst, type, strength, since)")
def insert_edges(spark, d):
    g = db(spark, d, ("nation",))
    g.execute("INSERT ('nation/1')-[:likes {strength: 2.5, since: 1999}]->('nation/2'), ('nation/2')-[:likes]->('nation/3')")
    return g.graph.edges.select("src", "dst", "type", F.col("strength").cast("double").alias("strength"), F.get_json_object("meta", "$.since").alias("since"))


@add("insert_geometry", "SELECT '9' AS _key, 'here' AS r_name")
def insert_geometry(spark, d):
    g = db(spark, d, ("region",))
    g.execute("INSERT INTO region (_key, r_name, geometry) VALUES ('9', 'here', ST_GeomFromGeoJSON('{\"type\":\"Point\",\"coordinates\":[1,2]}'))")
    return g.query("SELECT _key, r_name FROM region WHERE ST_DWithin(geometry, POINT(1 2), 1)")


@add("create_drop_table", "SELECT 'region' AS name, count(*) AS count FROM region UNION ALL SELECT 'kept', 2")
def create_drop_table(spark, d):
    g = db(spark, d, ("region",))
    g.execute("CREATE TABLE kept (name TEXT, n INTEGER)")
    g.execute("CREATE TABLE gone (name TEXT)")
    g.execute("INSERT INTO kept (_key, name, n) VALUES ('a', 'A', 1), ('b', 'B', 2)")
    g.execute("INSERT INTO gone (_key, name) VALUES ('x', 'X')")
    g.execute("DROP TABLE gone")
    g.execute("DROP TABLE IF EXISTS never")
    return g.query("SHOW TABLES").select("name", "count")


@add("alter_forms", "SELECT cast(n_nationkey AS VARCHAR) AS _key, n_name AS label, CASE WHEN n_nationkey = 3 THEN 1.5 END::DOUBLE AS extra FROM nation")
def alter_forms(spark, d):
    g = db(spark, d, ("nation",))
    for change in ("ADD COLUMN extra REAL", "RENAME COLUMN n_name TO label", "DROP COLUMN n_regionkey", "DROP COLUMN IF EXISTS never", "ALTER COLUMN label TYPE TEXT", "RENAME TO land"):
        g.execute("ALTER TABLE nation " + change)
    g.execute("UPDATE land SET extra = 1.5 WHERE _key = '3'")
    return g.query("SELECT * FROM land").select("_key", "label", "extra")


@add("ilike_index", "SELECT cast(doc_id AS VARCHAR) AS _key FROM documents WHERE contains(lower(text), 'license')")
def ilike_index(spark, d):
    """By trigrams: candidates from the postings, verified on the text."""
    g = db(spark, d, ("documents",))
    g.execute("CREATE INDEX ON documents USING gin (text)")
    return g.ilike("documents", "text", "%LICENSE%").select("_key")


@add("reindex_drop_index", "SELECT cast(p_partkey AS VARCHAR) AS _key FROM part WHERE contains(lower(p_name), 'a')")
def reindex_drop_index(spark, d):
    g = db(spark, d, ("part",))
    g.execute("CREATE INDEX ON part USING gin (p_name)")
    g.execute("REINDEX ON part USING gin (p_name)")
    g.execute("DROP INDEX ON part USING gin (p_name)")
    return g.ilike("part", "p_name", "%a%").select("_key")


@add("ann_search")
def ann_search(spark, d):
    """The ten nearest by the inverted file; its recall is measured in the tests."""
    g = db(spark, d, ("embeddings",))
    g.execute("CREATE INDEX ON embeddings USING hnsw (embedding)")
    return g.vector_search("embeddings", "embedding", query_vector(spark, d)[0], 10).select("_key")


@add("put_get_vector", "SELECT cast(vec_id AS VARCHAR) AS _key, CASE WHEN vec_id = 5 THEN 3 ELSE len(embedding) END::BIGINT AS n FROM embeddings")
def put_get_vector(spark, d):
    g = db(spark, d, ("embeddings",))
    g.put_vector("embeddings/5", "embedding", [0.5, 1.0, -2.0])
    assert g.get_vector("embeddings/5", "embedding") == [0.5, 1.0, -2.0]
    return g.query("SELECT _key, JSON_ARRAY_LENGTH(embedding) AS n FROM embeddings")


@add("bm25_search", f"SELECT 'documents/' || doc_id AS _id, round(bm25, 6) AS score FROM {_bm25_sql('text', _B)} WHERE bm25 > 0 ORDER BY round(bm25, 9) DESC, 1 LIMIT 15")
def bm25_search(spark, d):
    return db(spark, d, ("documents",)).bm25_search("text", _B, 15, "documents").withColumn("score", F.round("score", 6))


@add("bm25_after_changes", "SELECT cast(doc_id AS VARCHAR) AS _key, round(bm25, 6) AS score FROM " + _bm25_sql("text", _B, "(SELECT * FROM documents WHERE lang IS DISTINCT FROM 'de')"))
def bm25_after_changes(spark, d):
    g = db(spark, d, ("documents",))
    g.execute("DELETE FROM documents WHERE lang = 'de'")
    return g.query(f"SELECT _key, BM25(text, '{_B}') AS score FROM documents").withColumn("score", F.round("score", 6))


@add("api_transaction", "SELECT cast(r_regionkey AS VARCHAR) AS _key, r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT '7', 'NEW'")
def api_transaction(spark, d):
    g = db(spark, d, ("region",))
    t = g.transaction()
    t.put("region/7", {"r_name": "NEW"})
    t.remove("region/1")
    t.link("region/7", "region/0", "near", 2.0)
    t.commit()
    t.put("region/8", {"r_name": "never"})
    t.rollback()
    return g.query("SELECT _key, r_name FROM region")


@add("low_level_changes", "SELECT 'region/2' AS src, 'region/4' AS dst, 3.0::DOUBLE AS strength, 'x' AS note")
def low_level_changes(spark, d):
    g = db(spark, d, ("region",))
    g.put("region/2", '{"r_name": "changed"}')
    g.link_meta("region/2", "region/4", "near", 3.0, {"note": "x"})
    g.link("region/2", "region/0", "near")
    g.unlink("region/2", "region/0", "near")
    assert g.get("region/2")["r_name"] == "changed"
    return g.edges_from("region/2").select("src", "dst", F.col("strength").cast("double").alias("strength"), F.get_json_object("meta", "$.note").alias("note"))


@add("save_and_reopen", "SELECT cast(n_nationkey AS VARCHAR) AS _key, n_name, n_regionkey FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT '77', 'NEW', 1")
def save_and_reopen(spark, d):
    """Two versions in the shared folder: a reader that was opened on the first refreshes to the second."""
    g = db(spark, d, ("nation",))
    g.path = f"{G.shared_folder(spark)}/db-{_uuid.uuid4().hex}"
    g.compact()
    reader = DB(spark, g.path)
    g.execute("DELETE FROM nation WHERE _key = '4'")
    g.execute("INSERT INTO nation (_key, n_nationkey, n_name, n_regionkey) VALUES ('77', 77, 'NEW', 1)")
    g.compact()
    assert reader.contains("nation/4") and reader.refresh()
    return reader.query("SELECT _key, n_name, n_regionkey FROM nation")


@add("explain_analyze", "SELECT true AS scans, true AS timed")
def explain_analyze(spark, d):
    t = db(spark, d, ("region",)).explain("SELECT _key FROM region WHERE r_regionkey > 1", analyze=True)
    return spark.createDataFrame([("Scan parquet" in t, "rows: 3" in t and "time_ms" in t)], "scans boolean, timed boolean")


@add("edge_listing", "SELECT 'all' AS what, count(*) AS n FROM nation UNION ALL SELECT 'between', count(*) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'types', 1 UNION ALL SELECT 'types of one', 1")
def edge_listing(spark, d):
    g = db(spark, d, ("nation", "region"), ("in_region",))
    to = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey = 3").first()["n_regionkey"]
    parts = {"all": g.edges_from_collection("nation"), "between": g.edges_between("nation/3", f"region/{to}"), "types": g.edge_types_from_collection("nation"), "types of one": g.edge_types_from("nation/3")}
    out = [df.agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k, df in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


_TWO = ("licensed", "thing")
_BUCKETS = "list_transform(list_filter(range(0, len(t)), lambda i: t[i + 1] = '{0}'), lambda i: i // 8)"


@add("search_score_two_terms", f"""WITH w AS (SELECT doc_id, {_TOK.format('source')} AS a, {_TOK.format('text')} AS b FROM documents), x AS (SELECT *, list_concat(a, b) AS t FROM w),
y AS (SELECT *, {_BUCKETS.format(_TWO[0])} AS p, {_BUCKETS.format(_TWO[1])} AS q FROM x WHERE list_contains(t, '{_TWO[0]}') AND list_contains(t, '{_TWO[1]}')),
z AS (SELECT *, list_min(list_transform(p, lambda u: list_min(list_transform(q, lambda v: abs(u - v))))) AS gap, list_has_any(a, ['{_TWO[0]}', '{_TWO[1]}']) AS early, len(a) AS la, len(b) AS lb FROM y)
SELECT cast(doc_id AS VARCHAR) AS _key, round(1e12 + 1e9 + 1e6 / (1 + gap) + CASE WHEN early THEN 1e3 ELSE 0 END + CASE WHEN la = 2 OR lb = 2 THEN 1.0 WHEN least(CASE WHEN la > 0 THEN la ELSE 1000000 END, CASE WHEN lb > 0 THEN lb ELSE 1000000 END) < 2 THEN 0 ELSE 2.0 / least(CASE WHEN la > 0 THEN la ELSE 1000000 END, CASE WHEN lb > 0 THEN lb ELSE 1000000 END) END, 3) AS score FROM z""")
def search_score_two_terms(spark, d):
    q = " ".join(_TWO)
    return _search_db(spark, d).query(f"SELECT _key, SEARCH_SCORE('{q}') AS score FROM documents WHERE SEARCH('{q}')").withColumn("score", F.round("score", 3))


@add("spatial_join", f"SELECT cast(c_custkey AS VARCHAR) AS customer, cast(s_suppkey AS VARCHAR) AS supplier FROM (SELECT c_custkey, -37600 - c_custkey % 600 AS y, 144500 + c_custkey % 1000 AS x FROM customer) JOIN (SELECT s_suppkey, -37600 - (s_suppkey * 5) % 600 AS sy, 144500 + (s_suppkey * 7) % 1000 AS sx FROM supplier) ON abs(x - sx) < 9.5 AND abs(y - sy) < 9.5")
def spatial_join(spark, d):
    """Customers within the squares around suppliers, joined on grid cells: squares of 19 thousandths, so that no customer is on a border."""
    g = tables.graph(spark, d, ("customer", "supplier"))
    k = F.col("s_suppkey")
    ring = lambda dx, dy: F.concat(F.lit("["), F.round(tables.place_lon(k * 7) + dx, 4).cast("string"), F.lit(","), F.round(tables.place_lat(k * 5) + dy, 4).cast("string"), F.lit("]"))
    h = 0.0095
    square = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", ring(-h, -h), ring(h, -h), ring(h, h), ring(-h, h), ring(-h, -h)), F.lit("]]}"))
    areas = g.collection("supplier").withColumn("geometry", square)
    return geo.join_containing(g.collection("customer"), areas).select(F.col("p._key").alias("customer"), F.col("a._key").alias("supplier"))


@add("streaming_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_windows(spark, d):
    """The same windows as a stream over the file, state and watermark included."""
    from .streaming.events import windowed_stream

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return windowed_stream(spark, schema, d, "events.parquet", f"windows_{_uuid.uuid4().hex}").withColumn("total", F.round("total", 4))


def entry(spark, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Orders and their value per nation, over customer and order paths."""
    return QUERIES["path_group_sum"](spark, d)
