"""From the syntax tree to DataFrames. Nothing is executed here, but for shortest paths."""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, predicates, scalars, text, vector
from ..model import Graph, spelt
from ..operators import graph as G
from .ast import Between, Bin, Call, Case, Chain, In, IsNull, JsonPath, Like, ListLit, Lit, Name, Neg, Not, PathPredicate, Select, Star, Table
from .errors import GroupByViolation, QueryError

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
_INTRINSIC = {"_depth", "_path_keys", "_path_strength", "_avg_strength", "_min_strength", "_max_strength"}
_PATH = {"PATH_AVG", "PATH_SUM", "PATH_MIN", "PATH_MAX", "PATH_PRODUCT", "PATH_FIRST", "PATH_LAST"}
_RANKED = {"BM25", "SEARCH", "SEARCH_SCORE"}
_HIDDEN = {"_created_unix", "_updated_unix"}


def walk(e):
    """All nodes of an expression."""
    yield e
    if is_dataclass(e):
        for f in fields(e):
            yield from walk(getattr(e, f.name))
    elif isinstance(e, (tuple, list)):
        for x in e:
            yield from walk(x)


def conjuncts(e):
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Bin) and e.op == "AND" else [e]


def has_aggregate(e) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def is_score(e) -> bool:
    """Score expressions sort highest first unless told otherwise."""
    return isinstance(e, (Bin, Neg)) or (isinstance(e, Call) and not e.name.startswith("VECTOR<") and not e.name.startswith("VECTOR#"))


def vector_order(e) -> bool:
    return isinstance(e, Call) and e.name in ("VECTOR<=>", "VECTOR<->", "VECTOR<#>", "VECTOR<+>")


def numbers(e) -> list[float]:
    if not isinstance(e, ListLit):
        raise QueryError("a vector literal is needed")
    return [float(-x.x.value if isinstance(x, Neg) else x.value) for x in e.items]


class Scope:
    """Columns by name: of a table, or of variables that are struct columns."""

    def __init__(self, df: DataFrame, variables: set[str] = frozenset(), edges: set[str] = frozenset(), tables: set[str] = frozenset(), ranked=None, aliases=None, strict: bool = False):
        self.df, self.variables, self.edges, self.tables = df, set(variables), set(edges), set(tables)
        self.ranked, self.aliases, self.strict = ranked or {}, aliases or {}, strict
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.fields = {f.name: f for f in df.schema.fields}

    def column(self, parts: tuple[str, ...]) -> tuple[Column, T.DataType | None]:
        if len(parts) > 1 and parts[0] in self.tables:
            parts = parts[1:]
        head = parts[0]
        if head in self.edges and len(parts) > 1:
            return self._edge(head, parts[1])
        if head in self.types:
            c, t = F.col(f"`{head}`"), self.types[head]
            for p in parts[1:]:
                if isinstance(t, T.StructType) and p in t.fieldNames():
                    c, t = c[p], t[p].dataType
                elif isinstance(t, T.StringType):
                    c = predicates.json_path(c, (p,), True)
                else:
                    return F.lit(None), None
            return c, t
        if head in self.aliases and len(parts) == 1:
            return self.aliases[head], None
        return F.lit(None), None

    def native(self, e, values) -> tuple[Column, list[int]] | None:
        """For a key that spells a whole number: its column and the numbers that the values spell."""
        if not isinstance(e, Name):
            return None
        parts = e.parts[1:] if len(e.parts) > 1 and e.parts[0] in self.tables else e.parts
        got = spelt(self.fields[parts[0]], self.types, values) if len(parts) == 1 and parts[0] in self.fields else None
        return got and (F.col(f"`{got[0]}`"), got[1])

    def _edge(self, var: str, name: str):
        have = self.types[var].fieldNames() if var in self.types else []
        if name in have:
            return F.col(f"`{var}`")[name], self.types[var][name].dataType
        if "meta" in have:
            return F.get_json_object(F.col(f"`{var}`")["meta"], "$." + name), None
        return F.lit(None), None


class Compiler:
    """Expressions as columns. A predicate is true or false, never missing; as a filter (``keep``) it may be missing where it
    isn't true, which lets comparisons reach the scan and be keys of joins."""

    def __init__(self, scope: Scope):
        self.scope = scope
        self.bare = False

    def keep(self, e) -> Column:
        self.bare = True
        try:
            return self.predicate(e)
        finally:
            self.bare = False

    def _total(self, e) -> Column:
        """A predicate within another expression."""
        bare, self.bare = self.bare, False
        try:
            return self.predicate(e)
        finally:
            self.bare = bare

    def dtype(self, e):
        return self.scope.column(e.parts)[1] if isinstance(e, Name) else None

    def number(self, e) -> Column:
        """For arithmetic: what is missing or no number counts as 0."""
        if isinstance(e, Lit) and predicates.is_number(e.value):
            return F.lit(float(e.value))
        if isinstance(e, Bin) and e.op in "+-*/":
            return self.value(e)
        t = self.dtype(e)
        c = self.value(e)
        c = c.cast("double") if isinstance(t, T.NumericType) else c.cast("string").try_cast("double") if t is None or isinstance(t, T.StringType) else F.lit(None).cast("double")
        return F.coalesce(c, F.lit(0.0))

    def value(self, e) -> Column:
        if isinstance(e, Lit):
            return F.lit(e.value)
        if isinstance(e, Name):
            return self.scope.column(e.parts)[0]
        if isinstance(e, ListLit):
            return F.array(*[self.value(x) for x in e.items])
        if isinstance(e, Neg):
            return -self.number(e.x)
        if isinstance(e, JsonPath):
            return predicates.json_path(self.value(e.base), e.keys, e.text)
        if isinstance(e, Bin) and e.op in ("+", "-", "*", "/"):
            a, b = self.number(e.left), self.number(e.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: scalars.divide(a, b)}[e.op]()
        if isinstance(e, Case):
            out = None
            for cond, then in e.whens:
                c, v = self._total(cond), self.value(then)
                out = F.when(c, v) if out is None else out.when(c, v)
            return out.otherwise(self.value(e.other))
        if isinstance(e, Call):
            return self.call(e)
        return self._total(e)

    def point(self, e) -> tuple[float, float]:
        if not (isinstance(e, Call) and e.name == "POINT"):
            raise QueryError("a POINT is needed")
        return e.args

    def call(self, e: Call) -> Column:
        n, a = e.name, e.args
        if n in _RANKED:
            return F.col(self.scope.ranked[e])
        if n in scalars.SIMPLE:
            return scalars.SIMPLE[n](self.value(a[0]))
        if n == "SUBSTRING":
            return F.substring(self.value(a[0]), a[1].value, a[2].value if len(a) > 2 else 1 << 30)
        if n == "REPLACE":
            return F.replace(self.value(a[0]), self.value(a[1]), self.value(a[2]))
        if n == "CONCAT":
            return F.concat(*[F.coalesce(self.value(x).cast("string"), F.lit("")) for x in a])
        if n in scalars.DATE_PARTS:
            return scalars.date_part(n, self.value(a[0]))
        if n == "DATE_TRUNC":
            return scalars.date_trunc(a[0].value, self.value(a[1]))
        if n == "NOW":
            return F.unix_timestamp() if self.scope.variables else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if n == "UUIDV4":
            return F.expr("uuid()")
        if n == "UUIDV5":
            return scalars.uuid5(a[0].value, self.value(a[1]))
        if n in ("AGE_DAYS", "AGE_HOURS"):
            now = self.value(a[1]) if len(a) > 1 else None
            return scalars.age(self.value(a[0]), 86400 if n == "AGE_DAYS" else 3600, now)
        if n == "JSON_ARRAY_LENGTH":
            c = self.value(a[0])
            return F.size(c).cast("long") if isinstance(self.dtype(a[0]), T.ArrayType) else F.json_array_length(c).cast("long")
        if n in _PATH:
            return self.path(n, self.value(a[0]), self.dtype(a[0]))
        if n.startswith("VECTOR<"):
            return vector.DISTANCE[n[6:]](self.value(a[0]), numbers(a[1]))
        if n in ("VECTOR_COSINE", "VECTOR_L2", "VECTOR_DOT", "VECTOR_L1"):
            f = {"VECTOR_L2": vector.l2, "VECTOR_DOT": vector.dot, "VECTOR_L1": vector.l1}.get(n) or (lambda c, q: F.lit(1.0) - vector.cosine_distance(c, q))
            return F.coalesce(f(self.value(a[0]), numbers(a[1])), F.lit(0.0))
        if n == "ST_CENTROID":
            return geo.centroid_geojson(self.value(a[0]))
        if n == "ST_ASGEOJSON":
            return self.value(a[0]).cast("string")
        if n == "ST_GEOMFROMGEOJSON":
            return self.value(a[0])
        if n == "ST_DISTANCE_KM":
            return F.coalesce(geo.distance_km(self.value(a[0]), *self.point(a[1])), F.lit(1.7976931348623157e308))
        if n == "ST_LENGTH" and len(a) == 1:
            return geo.length_km(self.value(a[0]))
        if n == "ST_AREA" and len(a) == 1:
            return geo.area_km2(self.value(a[0]))
        if n.startswith("ST_") or n == "ARRAY_CONTAINS_ALL":
            return self._total(e)
        if n == "__ONE":
            return F.lit(1).cast("long")
        if n in AGGREGATES:
            raise QueryError(f"{n} is not possible here")
        raise QueryError(f"unknown function {n}")

    def path(self, n: str, c: Column, t) -> Column:
        if n in ("PATH_FIRST", "PATH_LAST"):
            return F.when(F.size(c) > 0, F.element_at(c, 1 if n == "PATH_FIRST" else -1))
        c = F.array_compact(F.transform(c, lambda x: x.cast("double")))
        fold = {"PATH_SUM": lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b), "PATH_AVG": lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x), "PATH_PRODUCT": lambda x: F.aggregate(x, F.lit(1.0), lambda a, b: a * b), "PATH_MIN": F.array_min, "PATH_MAX": F.array_max}[n]
        return F.when(F.size(c) > 0, fold(c))

    def predicate(self, e) -> Column:
        if isinstance(e, Bin) and e.op == "AND":
            return self.predicate(e.left) & self.predicate(e.right)
        if isinstance(e, Bin) and e.op == "OR":
            return self.predicate(e.left) | self.predicate(e.right)
        if isinstance(e, Not):
            return ~self._total(e.x)
        if isinstance(e, Bin):
            return self.comparison(e)
        if isinstance(e, Between):
            return self.comparison(Bin(">=", e.x, e.low)) & self.comparison(Bin("<=", e.x, e.high))
        if isinstance(e, In):
            native = self.scope.native(e.x, e.items)
            c, items, t = (native[0], native[1], None) if native else (self.value(e.x), e.items, self.dtype(e.x))
            return predicates.not_in(c, items, t) if e.negated else predicates.is_in(c, items, t, self.bare)
        if isinstance(e, Like):
            got = predicates.like(self.value(e.x), e.pattern, e.ignore_case)
            return ~got if e.negated else got
        if isinstance(e, IsNull):
            c = self.value(e.x)
            return c.isNotNull() if e.negated else c.isNull()
        if isinstance(e, Lit):
            return F.lit(bool(e.value))
        if isinstance(e, Call):
            return self.spatial(e)
        return predicates.sure(self.value(e).cast("boolean"))

    def comparison(self, e: Bin) -> Column:
        left, right = e.left, e.right
        if isinstance(left, Lit) and not isinstance(right, Lit):
            flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
            left, right, e = right, left, Bin(flip.get(e.op, e.op), right, left)
        if isinstance(left, Call) and left.name == "BM25" and e.op == ">=":
            e = Bin(">", left, right)
        c = self.value(left)
        if isinstance(right, Lit):
            t = self.dtype(left)
            native = self.scope.native(left, [right.value]) if e.op == "=" else None
            if native:
                return predicates.is_in(native[0], native[1], None, self.bare)
            if t is None and predicates.is_number(right.value) and isinstance(left, (JsonPath, Name)):
                c, t = c.cast("string").try_cast("double"), T.DoubleType()
            if self.scope.strict:
                if e.op == "!=":
                    return c.isNotNull() & predicates.compare(c, "!=", right.value, t)
                if isinstance(right.value, str) and e.op in ("<", "<=", ">", ">=") and isinstance(t, T.StringType):
                    v = F.lit(right.value)
                    got = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[e.op]
                    return got if self.bare else predicates.sure(got)
            return predicates.compare(c, e.op, right.value, t, self.bare)
        r = self.value(right)
        if isinstance(right, Call) and right.name == "NOW":
            r = F.unix_millis(F.current_timestamp())
        got = {"=": c == r, "!=": c != r, "<": c < r, "<=": c <= r, ">": c > r, ">=": c >= r}[e.op]
        return got if self.bare else predicates.sure(got)

    def spatial(self, e: Call) -> Column:
        n, a = e.name, e.args
        if n == "ARRAY_CONTAINS_ALL":
            return predicates.array_contains_all(self.value(a[0]), [x.value for x in a[1].items])
        if n == "SEARCH":
            return F.col(self.scope.ranked[e])
        if not n.startswith("ST_"):
            return predicates.sure(self.call(e).cast("boolean"))
        g = self.value(a[0])
        # The field may be given twice.
        a = a[1:] if len(a) > 1 and a[1] == a[0] else a
        if n == "ST_DWITHIN":
            return geo.dwithin(g, *self.point(a[1]), float(a[2].value))
        if n == "ST_CONTAINS":
            return geo.contains_point(g, *a[1].args) if a[1].name == "POINT" else geo.contains_polygon(g, list(a[1].args))
        if n == "ST_WITHIN":
            return geo.within(g, list(a[1].args))
        if n == "ST_INTERSECTS":
            return geo.intersects(g, list(a[1].args))
        if n == "ST_DISTANCE":
            return predicates.sure(geo.distance_km(g, *self.point(a[1])) < float(a[2].value))
        if n == "ST_LENGTH":
            return predicates.sure(geo.length_km(g) > float(a[1].value))
        if n == "ST_AREA":
            return predicates.sure(geo.area_km2(g) > float(a[1].value))
        raise QueryError(f"unknown function {n}")

    def aggregate(self, e: Call) -> Column:
        if e.name == "COUNT" and "__walks" in self.scope.types:
            return F.coalesce(F.sum("__walks"), F.lit(0))
        if e.name == "COUNT":
            if not e.args or isinstance(e.args[0], Star) or (isinstance(e.args[0], Name) and self.scope.variables and (len(e.args[0].parts) == 1 or not e.distinct)):
                return F.count(F.lit(1))
            c = self.value(e.args[0])
            return F.count_distinct(c) if e.distinct else F.count(c)
        if self.scope.variables:
            x = self.number(e.args[0])
        else:
            t = self.dtype(e.args[0])
            x = self.number(e.args[0]) if t is None and not isinstance(e.args[0], (Name, JsonPath)) else self.value(e.args[0]).cast("double") if isinstance(t, T.NumericType) else self.value(e.args[0]).cast("string").try_cast("double")
        return {"SUM": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "AVG": lambda: F.avg(x), "MIN": lambda: F.min(x), "MAX": lambda: F.max(x)}[e.name]()


def default_name(e) -> str:
    if isinstance(e, Name):
        return e.parts[-1]
    if isinstance(e, Call):
        if e.name in AGGREGATES:
            return e.name.lower()
        if e.name == "BM25":
            return f"_bm25_{e.args[0].parts[-1]}_score"
        field = next((x.parts[-1] for x in e.args if isinstance(x, Name)), None)
        return field if field and e.name in ("ST_CENTROID", "ST_ASGEOJSON") else e.name.lower()
    if isinstance(e, JsonPath):
        return e.keys[-1] if isinstance(e.keys[-1], str) else "value"
    return "expr"


def named(items) -> list[tuple[object, str]]:
    """Items with output names; a repeated default name gets a number."""
    seen: dict[str, int] = {}
    out = []
    for e, alias in items:
        n = alias or default_name(e)
        if alias is None and n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        seen.setdefault(n, 1)
        out.append((e, n))
    return out


class Binder:
    def __init__(self, graph: Graph, search_fields: dict[str, list[str]] | None = None, collapse: bool = False):
        """collapse: aggregates of a pattern without GROUP BY give one row in all, not one a path."""
        self.graph, self.collapse = graph, collapse
        self.search_fields = search_fields or {}

    def bind(self, q: Select) -> DataFrame:
        if q.match_return and not q.stages and self._returns_nodes(q):
            return self._nodes(q)
        if len(q.sources) > 1:
            return self._cross(q)
        s = q.sources[0]
        if isinstance(s, Table):
            return self._table(q, s)
        if s.shortest:
            rows, scope = self._shortest(s, q.where)
            return self._finish(q, rows, scope) if rows is not None else self._empty(q)
        counted = self._counted(q)
        rows, scope = counted if counted else self._match(q)
        if s.edges and not (q.stages or q.group or self.collapse):
            calls = [x for x in walk([e for e, _ in q.items]) if isinstance(x, Call) and x.name in AGGREGATES]
            if any(c.name != "COUNT" for c in calls):
                q = replace(q, items=[(_of_one_path(e), a or default_name(e)) for e, a in q.items])
        return self._finish(q, rows, scope)

    def _counted(self, q: Select):
        """Paths that are only counted per end node: one row an end with its number of walks, not a row a path."""
        chain: Chain = q.sources[0]
        last, first = chain.nodes[-1], chain.nodes[0]
        calls = [x for x in walk((q.items, q.having, q.order)) if isinstance(x, Call) and x.name in AGGREGATES]
        names = {x.parts[0] for x in walk((q.items, q.group)) if isinstance(x, Name)}
        plain = all(not (n.label or n.slug or n.props or n.where) for n in chain.nodes[1:-1])
        conds = conjuncts(q.where)
        own = lambda n: [e for e in conds if self._own(e, n.var)]
        if q.stages or not q.group or not chain.edges or not calls or last.var is None or not plain:
            return None
        if any(c.name != "COUNT" or not c.args or not isinstance(c.args[0], Star) for c in calls) or names != {last.var}:
            return None
        if len(own(first)) + len(own(last)) != len(conds) or first.var == last.var:
            return None
        starts = self._start(first, own(first)).select("_id")
        legs = [(e.type, e.low, e.high, e.backward) for e in chain.edges]
        walks = G.walk_counts(self.graph, starts, legs).select(F.col("_id").alias("__end"), F.col("walks").alias("__walks"))
        ends = self._attach(self._start(last, own(last)), last.var, self._used(q))
        rows = ends.join(walks, F.col("__id") == F.col("__end")).drop("__id", "__end")
        return rows, Scope(rows, variables={last.var}, strict=True)

    # ── tables ──
    def _table(self, q: Select, s: Table) -> DataFrame:
        df = self.graph.all() if s.name.upper() == "ALL" else self.graph.collection(s.name)
        df, ranked = self._rank(df, q, s.name)
        scope = Scope(df, tables={s.alias or s.name, s.name}, ranked=ranked)
        # In order: a VECTOR_NEAR takes its k rows from what earlier conditions left.
        for c in conjuncts(q.where):
            if isinstance(c, Call) and c.name == "VECTOR_NEAR":
                k = c.args[2].value
                df = vector.near(df, c.args[0].parts[-1], numbers(c.args[1]), int(k), "_id")
            else:
                df = df.filter(Compiler(scope).keep(c))
        scope.df = df
        return self._finish(q, df, scope)

    def _rank(self, df: DataFrame, q: Select, name: str):
        """Scores over the whole collection, before any filter."""
        ranked = {}
        for e in walk((q.items, q.where, q.order, q.having)):
            if isinstance(e, Call) and e.name in _RANKED and e not in ranked:
                c = f"__rank{len(ranked)}"
                if e.name == "BM25":
                    df = text.with_bm25(df, e.args[0].parts[-1], e.args[1].value, c)
                    ranked[e] = c
                else:
                    declared = self.search_fields.get(name)
                    if not declared:
                        raise QueryError(f"{name} has no search index")
                    other = Call("SEARCH" if e.name == "SEARCH_SCORE" else "SEARCH_SCORE", e.args)
                    df = text.with_search(df, declared, e.args[0].value, c)
                    hit, score = (e, other) if e.name == "SEARCH" else (other, e)
                    ranked[hit], ranked[score] = c, c + "_score"
        return df, ranked

    # ── patterns ──
    def _start(self, n, where_of) -> DataFrame:
        if n.slug is not None:
            df = self.graph.at([n.slug])
        else:
            df = self.graph.collection(n.label) if n.label else self.graph.all()
        return self._narrow(df, n, where_of)

    def _narrow(self, df: DataFrame, n, conds) -> DataFrame:
        c = Compiler(Scope(df, strict=True, tables={n.var} if n.var else set()))
        for k, v in n.props.items():
            df = df.filter(c.keep(Bin("=", Name((k,)), Lit(v))))
        for e in conjuncts(n.where) + list(conds):
            df = df.filter(c.keep(e))
        return df

    @staticmethod
    def _own(e, var: str | None) -> bool:
        """Does a condition concern this variable only?"""
        names = [x for x in walk(e) if isinstance(x, Name)]
        return var is not None and bool(names) and all(len(x.parts) > 1 and x.parts[0] == var for x in names)

    def _used(self, q: Select) -> dict[str, set[str] | None]:
        """Fields used of each variable; None: all of them."""
        out: dict[str, set | None] = {}
        for e in walk((q.items, q.where, q.group, q.having, q.order, [(i, w) for i, _, w in q.stages], [n.where for _, c, _ in q.stages for n in c.nodes])):
            if isinstance(e, Name):
                v = e.parts[0]
                if len(e.parts) == 1:
                    out.setdefault(v, set())
                elif out.get(v, set()) is not None:
                    out.setdefault(v, set()).add(e.parts[1])
        for items in [q.items]:
            for e, _ in items:
                if isinstance(e, Name) and len(e.parts) == 1:
                    out[e.parts[0]] = None
        for items, _, _ in q.stages:
            for e, _ in items:
                if isinstance(e, Name) and len(e.parts) == 1 and out.get(e.parts[0]) is not None:
                    out[e.parts[0]] |= set()
        return out

    def _attach(self, df: DataFrame, var: str, used) -> DataFrame:
        """Nodes as (__id, struct var) with the needed fields only."""
        want = None if used.get(var, set()) is None else used.get(var, set()) | {"_id", "_key"}
        cols = [c for c in df.columns if c not in _HIDDEN and (want is None or c in want)]
        return df.select(F.col("_id").alias("__id"), F.struct(*cols).alias(var))

    def _match(self, q: Select):
        used = self._used(q)
        rows, scope, rest = self._chain(q.sources[0], conjuncts(q.where), used, None, None)
        for e in rest:
            rows = rows.filter(Compiler(scope).keep(e))
        for items, chain, where in q.stages:
            rows, scope = self._stage(rows, scope, items)
            rows, scope, rest = self._chain(chain, conjuncts(where), used, rows, scope)
            for e in rest:
                rows = rows.filter(Compiler(scope).keep(e))
        scope.df = rows
        return rows, scope

    def _stage(self, rows: DataFrame, scope: Scope, items):
        """WITH: project, or group by the items that are no aggregates."""
        c = Compiler(scope)
        pairs = named(items)
        keys = [c.value(e).alias(n) for e, n in pairs if not has_aggregate(e)]
        if any(has_aggregate(e) for e, _ in items):
            out = self._grouped(rows, scope, [(e, n) for e, n in pairs if not has_aggregate(e)], [(e, n) for e, n in pairs if has_aggregate(e)])
        else:
            out = rows.select(*keys)
        kept = {n for e, n in pairs if isinstance(e, Name) and len(e.parts) == 1 and e.parts[0] in scope.variables}
        return out, Scope(out, variables=kept, strict=True)

    def _grouped(self, rows: DataFrame, scope: Scope, keys, aggs) -> DataFrame:
        c = Compiler(scope)
        hidden, exprs = [], []
        for e, n in aggs:
            body, calls = split_aggregates(e, len(hidden))
            hidden += calls
            exprs.append((body, n))
        g = rows.groupBy(*[c.value(e).alias(n) for e, n in keys]).agg(*[c.aggregate(call).alias(h) for call, h in hidden] or [F.count(F.lit(1)).alias("__n")])
        after = Compiler(Scope(g))
        return g.select(*[F.col(f"`{n}`") for _, n in keys], *[(F.col(b.parts[0]) if isinstance(b, Name) else after.value(b)).alias(n) for b, n in exprs])

    def _chain(self, chain: Chain, conds, used, rows, scope):
        """Joins for a chain of hops. Returns rows, scope and the conditions that remain."""
        n0 = chain.nodes[0]
        carry = any(e.var and (used.get(e.var) or set()) & _INTRINSIC for e in chain.edges)
        variables = set(scope.variables) if scope else set()
        edges = set(scope.edges) if scope else set()
        carried = [c for c in rows.columns] if rows is not None else []
        var = n0.var or "__n0"
        if rows is not None and var in carried:
            at = rows
            own = [e for e in conds if self._own(e, n0.var)]
        else:
            own = [e for e in conds if self._own(e, n0.var)]
            inner, outer = [], []
            for e in conjuncts(n0.where):
                names = {x.parts[0] for x in walk(e) if isinstance(x, Name)}
                (outer if rows is not None and names & set(carried) else inner).append(e)
            n0 = type(n0)(n0.var, n0.label, n0.slug, n0.props, None)
            start = self._narrow(self._start(n0, own), n0, [Bin("AND", x, x) for x in inner]) if inner else self._start(n0, own)
            node = self._attach(start, var, {**used, var: (None if used.get(var, set()) is None else (used.get(var) or set()) | {x.parts[-1] for e in outer for x in walk(e) if isinstance(x, Name)})})
            if rows is None:
                at = node.drop("__id")
            else:
                both = rows
                if outer:
                    fields_ = set(node.schema[var].dataType.fieldNames())
                    # Only for the names and types of both sides; the join itself takes the condition.
                    merged = Scope(rows.crossJoin(node.drop("__id")), variables={var}, strict=True)
                    tests = [Compiler(merged).keep(self._qualify(e, var, fields_, set(carried))) for e in outer]
                    both = rows.join(node.drop("__id"), reduce(lambda x, y: x & y, tests))
                else:
                    both = rows.crossJoin(node.drop("__id"))
                at = both
        conds = [e for e in conds if e not in own]
        variables.add(var)
        if carry:
            at = at.withColumn("__keys", F.array(F.col(var)["_id"])).withColumn("__strengths", F.array().cast("array<double>"))
        here = F.col(var)["_id"]
        for k, (edge, node) in enumerate(zip(chain.edges, chain.nodes[1:]), 1):
            name = node.var or f"__n{k}"
            evar = edge.var or f"__e{k}"
            fields_ = used.get(edge.var, set()) if edge.var else set()
            plain = bool(edge.var) and edge.high == 1 and bool((fields_ or set()) - _INTRINSIC)
            at = G.expand(self.graph, at, here, evar, edge.type, edge.low, edge.high, edge.backward, plain, carry)
            if edge.var:
                parts = []
                if plain:
                    parts += [F.col(evar)[x].alias(x) for x in ("type", "strength", "meta")]
                if carry:
                    s = F.col("__strengths")
                    parts += [F.lit(k).cast("long").alias("_depth"), F.col("__keys").alias("_path_keys"), s.alias("_path_strength"), (F.aggregate(s, F.lit(0.0), lambda a, b: a + b) / F.size(s)).alias("_avg_strength"), F.array_min(s).alias("_min_strength"), F.array_max(s).alias("_max_strength")]
                at = at.withColumn(evar, F.struct(*parts)) if parts else at
                if parts:
                    edges.add(evar)
            own = [e for e in conds if self._own(e, node.var)]
            conds = [e for e in conds if e not in own]
            needs = node.var in used or node.label or node.slug or node.props or node.where is not None or own
            target = self._start(node, own) if needs else self.graph.ids()
            at = at.join(self._attach(target, name, used), F.col("__end") == F.col("__id")).drop("__end", "__id")
            here = F.col(name)["_id"]
            variables.add(name)
        at = at.drop("__keys", "__strengths")
        return at, Scope(at, variables=variables, edges=edges, strict=True), conds

    def _qualify(self, e, var: str, fields_: set[str], carried: set[str]):
        """Bare names inside a start pattern: the node's fields, unless a carried row has them."""
        if isinstance(e, Name):
            if len(e.parts) == 1 and e.parts[0] not in carried:
                return Name((var, e.parts[0]))
            return e
        if isinstance(e, tuple):
            return tuple(self._qualify(x, var, fields_, carried) for x in e)
        if is_dataclass(e):
            return type(e)(*[self._qualify(getattr(e, f.name), var, fields_, carried) for f in fields(e)])
        return e

    @staticmethod
    def _returns_nodes(q: Select) -> bool:
        return bool(q.items) and all(a is None and isinstance(e, Name) and len(e.parts) == 1 for e, a in q.items) and not q.group

    def _nodes(self, q: Select) -> DataFrame:
        """MATCH ... RETURN b: the distinct end nodes, with all their fields."""
        chain: Chain = q.sources[0]
        last = chain.nodes[-1]
        conds = conjuncts(q.where)
        strengths = {}
        for e in conds:
            if isinstance(e, Bin) and e.op == ">=" and isinstance(e.left, Name) and len(e.left.parts) == 2 and e.left.parts[1] == "strength":
                strengths[e.left.parts[0]] = e.right.value
        conds = [e for e in conds if not (isinstance(e, Bin) and isinstance(e.left, Name) and e.left.parts[0] in strengths)]
        own = lambda n: [e for e in conds if self._own(e, n.var)]
        at = self._start(chain.nodes[0], own(chain.nodes[0])).select("_id", "_key", "_collection")
        for edge, node in zip(chain.edges, chain.nodes[1:]):
            if edge.high == 1 and edge.low == 1:
                at = G.hop(self.graph, at, edge.type, edge.backward, strengths.get(edge.var))
            else:
                at = G.hops(self.graph, at, edge.high, edge.type, 0 if edge.type is None else edge.low, edge.backward).drop("depth")
            if node is not last and (node.label or node.slug or node.props or node.where is not None or own(node)):
                at = at.join(self._start(node, own(node)).select("_id"), "_id", "left_semi")
        out = self._start(last, own(last))
        if chain.edges:
            out = out.join(at.select("_id"), "_id", "left_semi")
        for other in q.union:
            out = out.unionByName(self._nodes(other), allowMissingColumns=True).dropDuplicates(["_id"])
        out = out.drop(*_HIDDEN)
        scope = Scope(out, tables={last.var} if last.var else set())
        return self._sorted(q, out, scope, out.columns)

    def _shortest(self, chain: Chain, where):
        a, b = chain.nodes[0], chain.nodes[-1]
        path_var = chain.edges[0].var or "__r"
        slugs, preds = {}, []
        for e in conjuncts(where):
            if isinstance(e, PathPredicate):
                preds.append(e)
            elif isinstance(e, Bin) and e.op == "=" and isinstance(e.left, Name) and e.left.parts[-1] in ("_key", "_id"):
                node = a if e.left.parts[0] == a.var else b
                v = e.right.value
                slugs[e.left.parts[0]] = v if "/" in v or not node.label else f"{node.label}/{v}"
            else:
                raise QueryError("a shortest path takes keys of its ends and path predicates")
        ends = [n.slug or slugs.get(n.var) for n in (a, b)]
        if None in ends:
            raise QueryError("both ends of a shortest path need a key")
        got = G.shortest_path(self.graph, *ends)
        if got is None:
            return None, None
        nodes, edges = got
        spark = self.graph.spark
        strength = 1.0
        for e in edges:
            strength *= e["strength"]
        row = spark.createDataFrame([((len(edges), nodes, edges, nodes, strength),)], f"`{path_var}` struct<length:long,nodes:array<string>,edges:array<struct<`from`:string,`to`:string,type:string,strength:double>>,_path_keys:array<string>,_path_strength:double>")
        for n, slug in zip((a, b), ends):
            if n.var and n.var not in row.columns:
                found = self.graph.at([slug]).drop(*_HIDDEN)
                row = row.crossJoin(found.select(F.struct("*").alias(n.var)))
        for p in preds:
            members = self.graph.at(nodes)  # the nodes of one path
            cond = Compiler(Scope(members, tables={p.var}, strict=True)).predicate(p.cond)
            hits = members.agg(F.sum(cond.cast("int")).alias("__h"))
            n = F.coalesce(F.col("__h"), F.lit(0))
            test = {"ANY": n > 0, "ALL": n == len(set(nodes)), "NONE": n == 0, "SINGLE": n == 1}[p.kind]
            row = row.crossJoin(F.broadcast(hits)).filter(test).drop("__h")
        return row, Scope(row, variables={v for v in (a.var, b.var, path_var) if v}, strict=True)

    def _empty(self, q: Select) -> DataFrame:
        return self.graph.spark.createDataFrame([], ", ".join(f"`{n}` string" for _, n in named(q.items)))

    def _cross(self, q: Select) -> DataFrame:
        """Independent sources, every combination: the feature asks for the product."""
        rows, variables, edges = None, set(), set()
        used = self._used(q)
        rest = conjuncts(q.where)
        for k, s in enumerate(q.sources):
            if isinstance(s, Table):
                v = s.alias or s.name
                part = self._attach(self.graph.collection(s.name), v, used).drop("__id")
                variables.add(v)
            elif s.shortest:
                part, scope = self._shortest(s, None)
                if part is None:
                    return self._empty(q)
                variables |= scope.variables
            else:
                own = {n.var for n in s.nodes} | {e.var for e in s.edges}
                mine = [e for e in rest if {x.parts[0] for x in walk(e) if isinstance(x, Name)} <= own]
                rest = [e for e in rest if e not in mine]
                part, scope, left = self._chain(s, mine, used, None, None)
                for e in left:
                    part = part.filter(Compiler(scope).keep(e))
                variables |= scope.variables
                edges |= scope.edges
                part = part.drop(*[c for c in part.columns if c.startswith("__")])
            rows = part if rows is None else rows.crossJoin(part)
        scope = Scope(rows, variables=variables, edges=edges, strict=True)
        for e in rest:
            rows = rows.filter(Compiler(scope).keep(e))
        return self._finish(q, rows, scope)

    # ── SELECT list, grouping, order ──
    def _finish(self, q: Select, rows: DataFrame, scope: Scope) -> DataFrame:
        items = []
        for e, a in q.items:
            if isinstance(e, Star):
                items += [(Name((c,)), c) for c in rows.columns if not c.startswith("__") and c not in _HIDDEN]
            else:
                items.append((e, a))
        pairs = named(items)
        aliases = {n: e for e, n in pairs}
        grouped = bool(q.group) or any(has_aggregate(e) for e, _ in pairs)
        if not grouped:
            c = Compiler(scope)
            for e, n in pairs:
                if n not in scope.types:
                    scope.aliases[n] = c.value(e)
            return self._sorted(q, rows, scope, None, pairs)
        group = [aliases.get(g.parts[0], g) if isinstance(g, Name) and len(g.parts) == 1 and g.parts[0] not in scope.types else g for g in q.group]
        keys, aggs = [], []
        for e, n in pairs:
            if has_aggregate(e):
                aggs.append((e, n))
            elif any(e == g or (isinstance(e, Name) and isinstance(g, Name) and e.parts[-1] == g.parts[-1] and (len(e.parts) == 1 or len(g.parts) == 1)) for g in group):
                keys.append((e, n))
            elif q.group and not (items and isinstance(q.items[0][0], Star)):
                raise GroupByViolation(f"{n} must be grouped by or aggregated")
            else:
                aggs.append((Call("__FIRST", (e,)), n))
        extra = [(g, f"__g{i}") for i, g in enumerate(group) if not any(e == g for e, _ in keys)]
        # Aggregates that only HAVING or ORDER BY name.
        also = []
        for e in walk((q.having, q.order)):
            if isinstance(e, Call) and e.name in AGGREGATES and not any(e == x for x, _ in aggs) and not any(e == x for x, _ in also):
                also.append((e, f"__a{len(also)}"))
        firsts = [(e, n) for e, n in aggs if isinstance(e, Call) and e.name == "__FIRST"]
        real = [(e, n) for e, n in aggs if (e, n) not in firsts]
        c = Compiler(scope)
        hidden, bodies = [], []
        for e, n in real + also:
            body, calls = split_aggregates(e, len(hidden))
            hidden += calls
            bodies.append((body, n))
        columns = [c.aggregate(call).alias(h) for call, h in hidden] + [F.first(c.value(e.args[0]), ignorenulls=True).alias(n) for e, n in firsts]
        g = rows.groupBy(*[c.value(e).alias(n) for e, n in keys + extra]).agg(*(columns or [F.count(F.lit(1)).alias("__n")]))
        after = Compiler(Scope(g))
        out = g.select(*[F.col(f"`{n}`") for _, n in keys + extra], *[(F.col(b.parts[0]) if isinstance(b, Name) else after.value(b)).alias(n) for b, n in bodies], *[F.col(f"`{n}`") for _, n in firsts])
        names = {e: n for e, n in keys + real + also + extra}
        sub = lambda e: substitute(e, names)
        if q.having is not None:
            out = out.filter(Compiler(Scope(out)).keep(sub(q.having)))
        q2 = Select([], [], q.distinct, order=[(sub(e), a) for e, a in q.order], limit=q.limit, offset=q.offset)
        return self._sorted(q2, out, Scope(out), [n for _, n in pairs])

    def _sorted(self, q: Select, rows: DataFrame, scope: Scope, columns, pairs=None) -> DataFrame:
        c = Compiler(scope)
        project = (lambda d: d.select(*[c.value(e).alias(n) for e, n in pairs])) if pairs is not None else (lambda d: d.select(*[F.col(f"`{n}`") for n in columns]))
        if q.distinct:
            rows = project(rows).distinct()
            scope = Scope(rows)
            c, pairs, columns = Compiler(scope), None, rows.columns
            project = lambda d: d
        if q.order or q.limit is not None or q.offset:
            by = []
            for e, asc in q.order:
                if vector_order(e):
                    d = c.value(e)
                    d = -d if e.name == "VECTOR<#>" else d
                    by.append(d.desc_nulls_last() if asc is False else d.asc_nulls_last())
                    continue
                target = e
                if pairs is not None and isinstance(e, Name) and len(e.parts) == 1 and e.parts[0] not in scope.types:
                    target = dict((n, x) for x, n in pairs).get(e.parts[0], e)
                up = asc if asc is not None else not is_score(target)
                v = c.value(e)
                by.append(v.asc_nulls_first() if up else v.desc_nulls_last())
            # Ties by key, so that results are the same every time.
            ties = [k for k in ("_id",) if k in scope.types] or [n for n in (columns or []) if not n.startswith("__")] if not scope.variables else [f"{v}._id" for v in sorted(scope.variables) if v in scope.types and "_id" in getattr(scope.types[v], "names", [])]
            by += [F.col(k if "." in k else f"`{k}`") for k in ties]
            if by:
                rows = rows.orderBy(*by)
            if q.offset:
                rows = rows.offset(q.offset)
            if q.limit is not None:
                rows = rows.limit(q.limit)
        return project(rows)


def _of_one_path(e):
    """Aggregates over a single path."""
    if isinstance(e, Call) and e.name in AGGREGATES:
        return Call("__ONE", ()) if e.name == "COUNT" else Bin("+", e.args[0], Lit(0.0))
    if isinstance(e, tuple):
        return tuple(map(_of_one_path, e))
    if is_dataclass(e):
        return type(e)(*[_of_one_path(getattr(e, f.name)) for f in fields(e)])
    return e


def split_aggregates(e, first: int):
    """e with each aggregate replaced by a name, and the aggregates with those names."""
    calls: list[tuple[Call, str]] = []

    def go(x):
        if isinstance(x, Call) and x.name in AGGREGATES:
            n = f"__h{first + len(calls)}"
            calls.append((x, n))
            return Name((n,))
        if isinstance(x, tuple):
            return tuple(go(y) for y in x)
        if is_dataclass(x):
            return type(x)(*[go(getattr(x, f.name)) for f in fields(x)])
        return x

    return go(e), calls


def substitute(e, names: dict):
    try:
        if e in names:
            return Name((names[e],))
    except TypeError:
        pass
    if isinstance(e, tuple):
        return tuple(substitute(x, names) for x in e)
    if is_dataclass(e):
        return type(e)(*[substitute(getattr(e, f.name), names) for f in fields(e)])
    return e


def bind_all(graph: Graph, q: Select, search_fields=None) -> DataFrame:
    return Binder(graph, search_fields).bind(q)

