"""DB: one entry to queries, changes, introspection, loading and saving; NodeSet: the fluent builder."""

from __future__ import annotations

import io
import json
import time
import uuid
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import geo, predicates, text, vector
from .model import SYSTEM_FIELDS, TYPES, Graph, has_id
from .operators import changes as C
from .operators import graph as G
from .operators import sets
from .operators.ann import VectorIndex
from .plans.binder import Binder, Compiler, Scope
from .plans.errors import QueryError
from .plans.parser import parse_query
from .plans.statements import ShowParser, StatementParser
from .sources import frames, store


class DB:
    def __init__(self, spark: SparkSession, path: str | None = None, graph: Graph | None = None):
        self.spark, self.path = spark, path
        self.graph = graph or Graph(spark)
        self.schemas: dict[str, list[dict]] = {}
        self.indexes: list[dict] = []
        self._saved: tuple | None = None
        self._built: dict[tuple[str, str], tuple] = {}
        if path and (got := store.load(spark, path)):
            self.graph, self.schemas, self.indexes = got
        self.df = Frames(self)

    # ── reading ──
    def _search_fields(self) -> dict[str, list[str]]:
        return {i["on"]: i["fields"] for i in self.indexes if i["using"] == "search"}

    def query(self, sql: str, params=None, collapse: bool = False) -> DataFrame:
        """collapse: see Binder."""
        if sql.strip()[:4].upper() == "SHOW":
            return self.show(sql)
        return Binder(self.graph, self._search_fields(), collapse).bind(parse_query(sql, params))

    def explain(self, sql: str, params=None, analyze: bool = False) -> str:
        df = self.query(sql, params)
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        if analyze:
            t = time.time()
            n = df.count()
            out.write(f"rows: {n}, time_ms: {1000 * (time.time() - t):.1f}\n")
        return out.getvalue()

    def collection(self, name: str) -> NodeSet:
        return NodeSet(self, self.graph.collection(name))

    def all(self) -> NodeSet:
        return NodeSet(self, self.graph.all())

    def one(self, slug: str) -> NodeSet:
        return NodeSet(self, self._at([slug]))

    def many(self, slugs) -> NodeSet:
        """Those that exist, in the given order."""
        order = self.spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(slugs))], "_id string, __i int")
        return NodeSet(self, self._at(list(slugs)).join(F.broadcast(order), "_id").orderBy("__i").drop("__i"))

    def _at(self, slugs: list[str]) -> DataFrame:
        return self.graph.at(list(slugs))

    def get(self, slug: str) -> dict | None:
        r = self._at([slug]).first()
        return None if r is None else r.asDict(recursive=True)

    def contains(self, slug: str) -> bool:
        return not self._at([slug]).isEmpty()

    def node_count(self) -> int:
        return self.graph.ids().count()

    def edge_count(self) -> int:
        return self.graph.edges.count()

    def get_vector(self, slug: str, field: str):
        r = self._at([slug]).select(field).first()
        return None if r is None else r[0]

    def centroid(self, slug: str, field: str = "geometry"):
        r = self._at([slug]).select(geo.centroid(F.col(field)).alias("c")).first()
        return None if r is None or r["c"] is None else (r["c"]["lat"], r["c"]["lon"])

    def bm25_search(self, field: str, query: str, k: int, collection: str) -> DataFrame:
        df = text.with_bm25(self.graph.collection(collection), field, query, "score")
        return df.filter("score > 0").orderBy(F.desc("score"), "_id").limit(k).select("_id", "score")

    def ilike(self, collection: str, field: str, pattern: str) -> DataFrame:
        """By a trigram index (gin or gist) where one is declared, otherwise by a scan."""
        df = self.graph.collection(collection)
        if not self._indexed(collection, field, ("gin", "gist")):
            return text.trigram_candidates(df, field, pattern)
        index = self._derived(collection, field, lambda: text.trigram_index(df, field))
        return text.verify_ilike(df, field, pattern, text.index_candidates(index, pattern))

    def text_index_candidates(self, collection: str, field: str, pattern: str) -> DataFrame:
        """_id of the rows that may match, by trigrams alone."""
        df = self.graph.collection(collection)
        found = text.index_candidates(self._derived(collection, field, lambda: text.trigram_index(df, field)), pattern)
        return df.select("_id") if found is None else found

    def vector_search(self, collection: str, field: str, q, k: int, probes: int | None = None) -> DataFrame:
        """Approximate where an index (hnsw) is declared: built from the collection as it is now; otherwise exact."""
        df = self.graph.collection(collection)
        if not self._indexed(collection, field, ("hnsw",)):
            return vector.near(df, field, q, k, "_id")
        return self._derived(collection, field, lambda: VectorIndex(df, field)).search(q, k, probes)

    def _indexed(self, collection: str, field: str, kinds) -> bool:
        return any(i["on"] == collection and i["using"] in kinds and field in i["fields"] for i in self.indexes)

    def _derived(self, collection: str, field: str, build):
        """Of the collection as it is: a change makes another, whose index is built anew."""
        df = self.graph.collection(collection)
        got = self._built.get((collection, field))
        if got is None or got[0] is not df:
            got = self._built[collection, field] = (df, build())
        return got[1]

    def edges_from(self, slug: str) -> DataFrame:
        return G.edges_from(self.graph, slug)

    def edges_to(self, slug: str) -> DataFrame:
        return G.edges_to(self.graph, slug)

    def edges_between(self, a: str, b: str) -> DataFrame:
        return G.edges_between(self.graph, a, b)

    def edges_from_collection(self, name: str) -> DataFrame:
        return G.edges_from_collection(self.graph, name)

    def edge_types_from(self, slug: str) -> DataFrame:
        return G.edge_types_from(self.graph, slug)

    def edge_types_from_collection(self, name: str) -> DataFrame:
        return G.edge_types_from_collection(self.graph, name)

    def edge_schema(self) -> DataFrame:
        return G.edge_schema(self.graph)

    # ── introspection ──
    def show(self, sql: str) -> DataFrame:
        what, a, b = ShowParser(sql).show()
        if what == "tables":
            names = sorted(self.graph.collections)
            if not names:
                return self.spark.createDataFrame([], "name string, count long, size_bytes long")
            per = [self.graph.collections[n].agg(F.lit(n).alias("name"), F.count("*").alias("count"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).cast("long").alias("size_bytes")) for n in names]
            out = per[0]
            for p in per[1:]:
                out = out.union(p)
            return out.orderBy("name")
        if what == "edges":
            e = G.edge_schema(self.graph)
            return e.filter((F.lit(a is None) | (F.col("from_collection") == F.lit(a))) & (F.lit(b is None) | (F.col("to_collection") == F.lit(b))))
        if what == "create":
            fields = ", ".join(f"{f['name']} {f['type']}" + " PRIMARY KEY" * bool(f.get("primary")) for f in self._fields(a))
            return self.spark.createDataFrame([(f"CREATE TABLE {a} ({fields})",)], "sql string")
        return self.spark.createDataFrame([(f["name"], f["type"], bool(f.get("primary"))) for f in self._fields(a)], "field string, type string, primary_key boolean")

    def _fields(self, name: str) -> list[dict]:
        if name in self.schemas:
            return self.schemas[name]
        return [{"name": f.name, "type": C.infer_type(f.dataType), "primary": f.name == "_key"} for f in self.graph.collection(name).schema.fields if f.name not in SYSTEM_FIELDS or f.name == "_key"]

    # ── changes ──
    def execute(self, sql: str, params=None) -> int:
        """Runs a statement; returns the number of rows or statements it concerns."""
        kind, s = StatementParser(sql, params).statement()
        return getattr(self, "_do_" + kind)(**s)

    def _do_begin(self):
        if self._saved is not None:
            raise QueryError("a transaction is open")
        self._saved = (self.graph, dict(self.schemas), list(self.indexes))
        return 0

    def _do_commit(self):
        if self._saved is None:
            raise QueryError("no transaction is open")
        self._saved = None
        return 0

    def _do_rollback(self):
        if self._saved is None:
            raise QueryError("no transaction is open")
        self.graph, self.schemas, self.indexes = self._saved
        self._saved = None
        return 0

    def _types(self, name: str) -> dict[str, str]:
        return {f["name"]: TYPES[f["type"]] for f in self.schemas.get(name, [])}

    def _validate(self, name: str, row: dict):
        ok = {"TEXT": lambda v: isinstance(v, str), "INTEGER": predicates.is_number, "REAL": predicates.is_number, "TIMESTAMPTZ": lambda v: isinstance(v, str) or predicates.is_number(v), "GEO": lambda v: isinstance(v, (dict, list, str)), "VECTOR": lambda v: isinstance(v, list) and all(map(predicates.is_number, v)), "JSON": lambda v: True}
        for f in self.schemas.get(name, []):
            v = row.get(f["name"])
            if v is not None and not ok[f["type"]](v):
                raise QueryError(f"{f['name']} must be {f['type']}")

    def _literal(self, v):
        """Literal calls of VALUES and SET; strings that are JSON objects stay JSON text."""
        if hasattr(v, "args"):
            if v.name == "ST_GEOMFROMGEOJSON":
                g = json.loads(v.args[0].value)
                if "type" not in g or ("coordinates" not in g and "geometries" not in g):
                    raise QueryError("no GeoJSON geometry")
                return v.args[0].value
            return self._default(v.name, [a.value for a in v.args])
        return v

    @staticmethod
    def _default(name: str, args: list):
        if name == "UUIDV4":
            return str(uuid.uuid4())
        if name == "UUIDV5":
            try:
                ns = uuid.UUID(args[0])
            except ValueError:
                ns = uuid.NAMESPACE_DNS
            return str(uuid.uuid5(ns, args[1]))
        if name == "NOW":
            return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        if name == "LIT":
            return args[0]
        raise QueryError(f"unknown default {name}")

    def _do_insert(self, name, rows):
        out = []
        for r in rows:
            r = {k: self._literal(v) for k, v in r.items()}
            for f in self.schemas.get(name, []):
                if f["name"] not in r and "default" in f:
                    r[f["name"]] = self._default(*f["default"])
            if "_key" in r and not isinstance(r["_key"], str):
                raise QueryError("_key must be a text")
            self._validate(name, r)
            out.append(r)
        # Timestamps are kept as given: a text in RFC 3339 or a number.
        types = {k: t for k, t in self._types(name).items() if k != "_key" and t != "timestamp"}
        self.graph = C.upsert_rows(self.graph, name, out, types)
        return len(rows)

    def _where(self, name: str, where):
        df = self.graph.collection(name)
        return F.lit(True) if where is None else Compiler(Scope(df, tables={name})).predicate(where)

    def _do_update(self, name, values, where):
        values = {k: self._literal(v) for k, v in values.items()}
        self._validate(name, values)
        cond = self._where(name, where)
        n = self.graph.collection(name).filter(cond).count()
        self.graph = C.update(self.graph, name, values, cond)
        return n

    def _do_delete(self, name, where):
        names = sorted(self.graph.collections) if name.upper() == "ALL" else [name]
        n = 0
        for x in names:
            cond = self._where(x, where)
            n += self.graph.collection(x).filter(cond).count()
            self.graph = C.delete(self.graph, x, None if where is None else cond)
        return n

    def _do_link(self, edges):
        rows = []
        for a, b, t, p in edges:
            p = dict(p)
            rows.append((a, b, t, p.pop("strength", 1.0), p))
        self.graph = C.link(self.graph, rows)
        return len(rows)

    def _do_unlink(self, edges):
        self.graph = C.unlink(self.graph, [(a, b, t) for a, b, t, _ in edges])
        return len(edges)

    def _do_link_all(self, node, where, type, props, target):
        b = Binder(self.graph)
        starts = b._start(node, [where] if where is not None else [])
        props = dict(props)
        n = starts.count()
        self.graph = C.link_all(self.graph, starts, target, type, float(props.pop("strength", 1.0)), props or None)
        return n

    def _do_create_table(self, name, fields, options):
        if not any(f["name"] == "_key" for f in fields):
            fields = [{"name": "_key", "type": "TEXT", "primary": True, "default": ("UUIDV4", [])}, *fields]
        self.schemas[name] = fields
        if name not in self.graph.collections:
            cols = "".join(f", `{f['name']}` {TYPES[f['type']] if f['type'] != 'TIMESTAMPTZ' else 'string'}" for f in fields if f["name"] not in SYSTEM_FIELDS)
            self.graph = self.graph.with_collection(name, self.spark.createDataFrame([], "_collection string, _key string, _id string, _created_unix long, _updated_unix long" + cols))
        kinds = {"hash": "hash", "range": "btree", "fulltext": "gin", "spatial": "spatial", "vector": "hnsw", "bm25": "bm25", "search": "search"}
        for key, value in options.items():
            if key not in kinds:
                raise QueryError(f"unknown option {key}")
            self.indexes.append({"on": name, "using": kinds[key], "fields": list(value)})
        return 0

    def _do_drop_table(self, name, if_exists):
        if name not in self.graph.collections:
            if if_exists:
                return 0
            raise QueryError(f"no table {name}")
        self.graph = C.drop_collection(self.graph, name)
        self.schemas.pop(name, None)
        self.indexes = [i for i in self.indexes if i["on"] != name]
        return 1

    def _do_create_index(self, name, using):
        self.indexes = [i for i in self.indexes if not (using[0] == "search" == i["using"] and i["on"] == name)]
        self.indexes.append({"on": name, "using": using[0], "fields": using[1]})
        return 0

    def _do_reindex(self, name, using):
        return 0  # derived data is planned from the tables, so it is never stale

    def _do_drop_index(self, name, using, if_exists):
        gone = {"on": name, "using": using[0], "fields": using[1]}
        if gone not in self.indexes and not if_exists:
            raise QueryError("no such index")
        self.indexes = [i for i in self.indexes if i != gone]
        return 0

    def _do_add_column(self, name, field, type):
        if type not in TYPES:
            raise QueryError(f"unknown type {type}")
        self.graph = C.add_column(self.graph, name, field, TYPES[type])
        if name in self.schemas:
            self.schemas[name] = [*self.schemas[name], {"name": field, "type": type}]
        return 0

    def _do_drop_column(self, name, field, if_exists):
        if field not in self.graph.collection(name).columns and not if_exists:
            raise QueryError(f"no column {field}")
        self.graph = C.drop_column(self.graph, name, field)
        if name in self.schemas:
            self.schemas[name] = [f for f in self.schemas[name] if f["name"] != field]
        return 0

    def _do_rename_column(self, name, field, to):
        self.graph = C.rename_column(self.graph, name, field, to)
        if name in self.schemas:
            self.schemas[name] = [f | {"name": to} if f["name"] == field else f for f in self.schemas[name]]
        return 0

    def _do_rename_table(self, name, to):
        self.graph = C.rename_collection(self.graph, name, to)
        if name in self.schemas:
            self.schemas[to] = self.schemas.pop(name)
        self.indexes = [i | {"on": to} if i["on"] == name else i for i in self.indexes]
        return 0

    def _do_retype(self, name, field, type):
        """Only the declaration changes; values stay as they are."""
        if type not in TYPES:
            raise QueryError(f"unknown type {type}")
        if name in self.schemas:
            self.schemas[name] = [f | {"type": type} if f["name"] == field else f for f in self.schemas[name]]
        return 0

    # ── low-level changes ──
    def put(self, slug: str, payload: dict | str) -> None:
        self.put_many([(slug, payload)])

    def put_many(self, rows) -> None:
        by: dict[str, list[dict]] = {}
        for slug, payload in rows:
            d = dict(json.loads(payload)) if isinstance(payload, str) else dict(payload)
            coll, _, key = slug.partition("/")
            by.setdefault(d.pop("_collection", coll), []).append(d | {"_key": d.get("_key", key)})
        for coll, rs in by.items():
            self._do_insert(coll, rs)

    def remove(self, slug: str) -> None:
        coll, _, key = slug.partition("/")
        self.graph = C.delete(self.graph, coll, F.col("_key") == key)

    def link(self, a: str, b: str, kind: str, strength: float = 1.0) -> None:
        self.graph = C.link(self.graph, [(a, b, kind, strength, None)])

    def link_meta(self, a: str, b: str, kind: str, strength: float, meta) -> None:
        self.graph = C.link(self.graph, [(a, b, kind, strength, json.loads(meta) if isinstance(meta, str) else meta)])

    def unlink(self, a: str, b: str, kind: str | None = None) -> None:
        self.graph = C.unlink(self.graph, [(a, b, kind)])

    def put_vector(self, slug: str, field: str, values) -> None:
        coll, _, key = slug.partition("/")
        self.graph = C.update(self.graph, coll, {field: list(values)}, F.col("_key") == key)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def compact(self) -> int:
        """Writes the present state as a new version and reads it back, which cuts the lineage."""
        if not self.path:
            raise QueryError("the database has no path")
        v = store.save(self.graph, self.path, self.schemas, self.indexes)
        self.graph, self.schemas, self.indexes = store.load(self.spark, self.path)
        return v

    sync = compact

    def refresh(self) -> bool:
        """Takes the newest saved version, if there is one."""
        got = store.load(self.spark, self.path) if self.path else None
        if got:
            self.graph, self.schemas, self.indexes = got
        return got is not None


class Transaction:
    """Collected changes, applied together by commit()."""

    def __init__(self, db: DB):
        self.db, self.ops = db, []

    def __getattr__(self, name):
        if name not in ("put", "remove", "link", "link_meta", "unlink", "put_vector"):
            raise AttributeError(name)
        return lambda *a: self.ops.append((name, a))

    def commit(self) -> int:
        before = self.db.graph
        try:
            for name, a in self.ops:
                getattr(self.db, name)(*a)
        except Exception:
            self.db.graph = before
            raise
        n, self.ops = len(self.ops), []
        return n

    def rollback(self) -> None:
        self.ops = []


class NodeSet:
    """An immutable, lazily planned set of nodes."""

    def __init__(self, db: DB, df: DataFrame, ranked_on: DataFrame | None = None):
        self.db, self.frame = db, df
        self.corpus = df if ranked_on is None else ranked_on

    def _with(self, df: DataFrame) -> NodeSet:
        return NodeSet(self.db, df, self.corpus)

    def _type(self, field: str):
        return self.frame.schema[field].dataType if field in self.frame.columns else None

    def _col(self, field: str):
        return F.col(f"`{field}`") if field in self.frame.columns else F.lit(None)

    def _cmp(self, field, op, v):
        return self._with(self.frame.filter(predicates.compare(self._col(field), op, v, self._type(field), bare=True)))

    def where_eq(self, field, v):
        if field in ("_id", "_key") and isinstance(v, str):
            return self._with(self.frame.filter(has_id(self.frame, [v], field)))
        return self._cmp(field, "=", v)

    def where_neq(self, field, v):
        return self._cmp(field, "!=", v)

    def where_gt(self, field, v):
        return self._cmp(field, ">", v)

    def where_gte(self, field, v):
        return self._cmp(field, ">=", v)

    def where_lt(self, field, v):
        return self._cmp(field, "<", v)

    def where_lte(self, field, v):
        return self._cmp(field, "<=", v)

    def where_between(self, field, low, high):
        return self._with(self.frame.filter(predicates.between(self._col(field), low, high, self._type(field), bare=True)))

    def where_in(self, field, values):
        return self._with(self.frame.filter(predicates.is_in(self._col(field), list(values), self._type(field), bare=True)))

    def where_contains(self, field, values):
        return self._with(self.frame.filter(predicates.array_contains_all(self._col(field), list(values))))

    def like(self, field, pattern):
        return self._with(self.frame.filter(predicates.like(self._col(field), pattern)))

    def ilike(self, field, pattern):
        return self._with(self.frame.filter(predicates.like(self._col(field), pattern, True)))

    def where_null(self, field):
        return self._with(self.frame.filter(self._col(field).isNull()))

    def where_not_null(self, field):
        return self._with(self.frame.filter(self._col(field).isNotNull()))

    def _nodes(self, ids: DataFrame) -> NodeSet:
        return NodeSet(self.db, self.db.graph.all().join(ids.select("_id"), "_id", "left_semi"))

    def forward(self, kind=None, min_strength=None):
        return self._nodes(G.hop(self.db.graph, self.frame, kind, False, min_strength))

    def backward(self, kind=None, min_strength=None):
        return self._nodes(G.hop(self.db.graph, self.frame, kind, True, min_strength))

    def hops(self, n):
        return self._nodes(G.hops(self.db.graph, self.frame, n))

    def hops_typed(self, kind, low, high):
        return self._nodes(G.hops(self.db.graph, self.frame, high, kind, low))

    def leaves(self):
        return self._with(G.leaves(self.db.graph, self.frame))

    def roots(self):
        return self._with(G.roots(self.db.graph, self.frame))

    def st_dwithin(self, lat, lon, km, field="geometry"):
        return self._with(self.frame.filter(geo.dwithin(F.col(field), lon, lat, km)))

    near = st_dwithin

    def st_contains_point(self, lat, lon, field="geometry"):
        return self._with(self.frame.filter(geo.contains_point(F.col(field), lon, lat)))

    @staticmethod
    def _ring(ring):
        return [(float(lon), float(lat)) for lat, lon in ring]

    def st_within(self, ring, field="geometry"):
        return self._with(self.frame.filter(geo.within(F.col(field), self._ring(ring))))

    def st_contains(self, ring, field="geometry"):
        return self._with(self.frame.filter(geo.contains_polygon(F.col(field), self._ring(ring))))

    def st_intersects(self, ring, field="geometry"):
        return self._with(self.frame.filter(geo.intersects(F.col(field), self._ring(ring))))

    def vector_near(self, field, q, k):
        return self._with(vector.near(self.frame, field, q, k, "_id"))

    def bm25_filter(self, field, query, min_score):
        """Scores are over the collection the set began with."""
        s = text.with_bm25(self.corpus, field, query, "__s").filter(F.col("__s") > min_score)
        return self._with(self.frame.join(s.select("_id"), "_id", "left_semi"))

    def union(self, other):
        return self._with(sets.union(self.frame, other.frame))

    def intersect(self, other):
        return self._with(sets.intersect(self.frame, other.frame))

    def subtract(self, other):
        return self._with(sets.subtract(self.frame, other.frame))

    def sort(self, field, ascending=True):
        return self.sort_multi([(field, ascending)])

    def sort_multi(self, columns):
        by = [self._col(f).asc_nulls_first() if up else self._col(f).desc_nulls_last() for f, up in columns]
        return self._with(self.frame.orderBy(*by, "_id"))

    def skip(self, n):
        return self._with(self.frame.offset(n))

    def take(self, n):
        return self._with(self.frame.limit(n))

    def select(self, *fields):
        return self._with(self.frame.select(*fields))

    def order_by(self, field, descending=False):
        return self.sort(field, not descending)

    limit = take

    def edge_collect(self, kind=None):
        return G.edge_collect(self.db.graph, self.frame, kind)

    def collect(self):
        return self.frame.collect()

    def count(self):
        return self.frame.count()

    def first(self):
        return self.frame.first()

    def exists(self):
        return not self.frame.isEmpty()

    def explain(self):
        self.frame.explain("formatted")


class Frames:
    """Loading from and reading into data frames."""

    def __init__(self, db: DB):
        self.db = db

    def load_nodes(self, frame, collection: str, id_col: str, mapping=None) -> int:
        new = frames.nodes_of(self.db.spark, frame, collection, id_col, mapping)
        self.db.graph = C.upsert(self.db.graph, collection, new.dropDuplicates(["_key"]))
        return new.count()

    def load_edges(self, frame, source_col: str, target_col: str, **options) -> int:
        new = frames.edges_of(self.db.spark, frame, source_col, target_col, **options)
        self.db.graph = self.db.graph.with_edges(self.db.graph.edges.unionByName(new))
        return new.count()

    def query(self, sql: str, params=None):
        return self.db.query(sql, params).toPandas()

    def create_collection(self, name: str, fields: dict[str, str], hash_index=(), range_index=(), fulltext_index=(), spatial_index=(), vector_index=(), bm25_index=()) -> None:
        options = {"hash": hash_index, "range": range_index, "fulltext": fulltext_index, "spatial": spatial_index, "vector": vector_index, "bm25": bm25_index}
        used = ", ".join(f"{k}: [{', '.join(repr(x) for x in v)}]" for k, v in options.items() if v)
        self.db.execute(f"CREATE TABLE {name} ({', '.join(f'{k} {v}' for k, v in fields.items())})" + (f" WITH ({used})" if used else ""))


__all__ = ["DB", "NodeSet", "Transaction", "T"]
