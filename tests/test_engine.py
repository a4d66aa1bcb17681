"""Scenarios on tiny graphs, by feature."""

from collections import Counter

import pandas as pd
import pytest

from latticeon.api import DB
from latticeon.functions import geo
from latticeon.plans.errors import GroupByViolation, ParamOutOfRange, ParamTypeMismatch, QueryError


@pytest.fixture(scope="module")
def music(spark):
    db = DB(spark)
    db.execute("INSERT INTO artist (_key, name) VALUES ('a', 'Radiohead')")
    db.execute("INSERT INTO genre (_key, name) VALUES ('alt', 'Alternative'), ('art', 'Art Rock')")
    db.execute("INSERT INTO city (_key, name) VALUES ('ox', 'Oxford')")
    db.execute("INSERT ('artist/a')-[:has_genre {strength: 10, since: 1992}]->('genre/alt'), ('artist/a')-[:has_genre {strength: 5}]->('genre/art')")
    db.execute("INSERT ('artist/a')-[:origin]->('city/ox'), ('artist/a')-[:has_genre]->('genre/missing')")
    return db


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_hops(music):
    assert values(music.query("MATCH (a:artist)-[:has_genre]->(g:genre) RETURN g"), "name") == [("Alternative",), ("Art Rock",)]
    assert values(music.query("MATCH (g:genre)<-[:has_genre]-(a) RETURN a"), "_id") == [("artist/a",)]
    assert values(music.query("MATCH (a)-[r:has_genre]->(g) WHERE r.strength >= 7 RETURN g"), "_id") == [("genre/alt",)]
    assert values(music.query("MATCH (a:artist {name: 'Radiohead'})-[:origin]->(c) RETURN c"), "name") == [("Oxford",)]
    assert values(music.query("MATCH (a:artist) WHERE a.name ILIKE '%radio%' RETURN a"), "_key") == [("a",)]
    assert values(music.one("artist/a").forward("has_genre").select("_id").frame, "_id") == [("genre/alt",), ("genre/art",)]
    assert music.collection("genre").backward("has_genre").count() == 1
    assert music.collection("city").roots().count() == 0 and music.collection("city").leaves().count() == 1


def test_edge_properties(music):
    got = music.query("SELECT g._key AS g, r.strength AS s, r.since AS since FROM MATCH (a:artist)-[r:has_genre]->(g:genre) ORDER BY s DESC").collect()
    assert [(r["g"], r["s"], r["since"]) for r in got] == [("alt", 10.0, "1992"), ("art", 5.0, None)]


def test_weighted_sum_and_stages(spark):
    db = DB(spark)
    db.execute("INSERT INTO students (_key, name) VALUES ('s', 'Ann')")
    db.execute("INSERT INTO answers (_key, score) VALUES ('1', 1.0), ('2', 0.8), ('3', 0.5)")
    db.execute("INSERT INTO questions (_key, weight, clo) VALUES ('1', 1.0, 'c2'), ('2', 0.6, 'c1'), ('3', 0.4, 'c1')")
    db.execute("INSERT INTO clos (_key, w) VALUES ('c1', 0.5), ('c2', 0.5)")
    for k in "123":
        db.execute(f"INSERT ('students/s')-[:answered]->('answers/{k}'), ('answers/{k}')-[:for]->('questions/{k}')")
    q = "SELECT q.clo AS clo, SUM(a.score * q.weight) AS total FROM MATCH (s:students)-[:answered]->(a)-[:for]->(q) WHERE s._key = 's' GROUP BY q.clo ORDER BY clo"
    assert [(r["clo"], round(r["total"], 6)) for r in db.query(q).collect()] == [("c1", 0.68), ("c2", 1.0)]
    staged = "MATCH (s:students)-[:answered]->(a)-[:for]->(q) WITH q.clo AS clo, SUM(a.score * q.weight) AS t MATCH (c:clos WHERE _key = clo) RETURN SUM(t * c.w) AS score"
    assert round(db.query(staged).first()["score"], 6) == 0.84
    with pytest.raises(GroupByViolation):
        db.query("SELECT q.clo AS c, a.score AS s, COUNT(*) AS n FROM MATCH (a:answers)-[:for]->(q) GROUP BY q.clo")


def test_two_valued_logic(spark):
    db = DB(spark)
    db.execute("INSERT INTO c (_key, x, name) VALUES ('1', 7, 'abc'), ('2', NULL, 'b_d'), ('3', 3, NULL)")
    keys = lambda w: "".join(k for k, in values(db.query(f"SELECT _key FROM c WHERE {w}"), "_key"))
    assert keys("x > 5") == "1" and keys("NOT (x > 5)") == "23" and keys("x != 7") == "23"
    assert keys("x NOT IN (3)") == "12" and keys("x IS NULL") == "2" and keys("name > 'a'") == ""
    assert keys("x = '7'") == "" and keys("x BETWEEN 3 AND 7") == "13" and keys("x = 3 OR x = 7 AND name = 'no'") == "3"
    assert keys("name LIKE 'b_d'") == "2" and keys("name LIKE 'b'") == "12" and keys("name ILIKE '%A%C'") == "1"
    assert db.query("SELECT SUM(nothing) AS s, AVG(nothing) AS a, COUNT(name) AS n FROM c").first().asDict() == {"s": 0.0, "a": None, "n": 2}


def test_parameters(spark):
    db = DB(spark)
    db.execute("INSERT INTO c (_key, x) VALUES ($1, $2), ('b', 2)", ["a", 1])
    assert values(db.query("SELECT _key FROM c WHERE x = ANY($1) LIMIT $2", [[1, 5], 10]), "_key") == [("a",)]
    with pytest.raises(ParamOutOfRange):
        db.query("SELECT _key FROM c WHERE x = $3", [1])
    with pytest.raises(ParamTypeMismatch):
        db.query("SELECT _key FROM c LIMIT $1", ["x"])
    for bad in ("SELECT _key FROM c WHERE x = $0", "SELECT _key FROM c LIMIT 3 nonsense", "SELECT * FROM a JOIN b", "SELECT FOO(x) FROM c"):
        with pytest.raises(QueryError):
            db.query(bad, [1])


def test_paths(spark):
    db = DB(spark)
    people = ["coby", "garp", "luffy", "sabo", "ace"]
    db.execute("INSERT INTO p (_key, rank) VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(people)))
    for a, b in [("coby", "garp"), ("coby", "luffy"), ("garp", "luffy"), ("luffy", "sabo"), ("luffy", "ace"), ("sabo", "ace"), ("ace", "coby")]:
        db.link(f"p/{a}", f"p/{b}", "knows", 0.5)
    q = "SELECT a._key AS a, r.length AS n, r._path_keys AS k, r._path_strength AS s FROM MATCH SHORTEST (a)-[r*]->(b) WHERE a._key = 'p/coby' AND b._key = 'p/sabo'"
    r = db.query(q).first()
    assert (r["a"], r["n"], r["k"], r["s"]) == ("coby", 2, ["p/coby", "p/luffy", "p/sabo"], 0.25)
    assert db.query(q + " AND ALL(n IN nodes(r) WHERE n.rank >= 1)").count() == 0
    assert db.query(q + " AND SINGLE(n IN nodes(r) WHERE n.rank = 2)").count() == 1
    assert db.query(q.replace("p/sabo", "p/nobody")).count() == 0
    assert db.query(q.replace("p/sabo", "p/coby")).first()["n"] == 0
    walks = db.query("SELECT b._key AS b, COUNT(*) AS n FROM MATCH ('p/coby')-[:knows*1..2]->(b) GROUP BY b._key")
    assert values(walks, "b", "n") == [("ace", 1), ("garp", 1), ("luffy", 2), ("sabo", 1)]
    two = db.query("SELECT c._key AS c, r2._depth AS d, PATH_PRODUCT(r2._path_strength) AS p, PATH_LAST(r2._path_keys) AS l FROM MATCH ('p/coby')-[r:knows]->(b)-[r2:knows]->(c) WHERE c._key = 'sabo'").first()
    assert two.asDict() == {"c": "sabo", "d": 2, "p": 0.25, "l": "p/sabo"}
    assert db.one("p/coby").hops(1).count() == 3 and db.one("p/coby").hops_typed("knows", 2, 2).count() == 2


def test_shortest_path_of_any_length(spark):
    db, far = DB(spark), 66
    db.df.load_nodes(pd.DataFrame({"k": [str(i) for i in range(far + 1)]}), "p", "k")
    db.df.load_edges(pd.DataFrame({"s": [str(i) for i in range(far)], "t": [str(i + 1) for i in range(far)]}), "s", "t", edge_type="e", source_collection="p", target_collection="p")
    q = "SELECT r.length AS n, r._path_keys AS k FROM MATCH SHORTEST (a)-[r*]->(b) WHERE a._key = 'p/{}' AND b._key = 'p/{}'"
    r = db.query(q.format(0, far)).first()
    assert (r["n"], r["k"]) == (far, [f"p/{i}" for i in range(far + 1)])


def test_space(spark):
    db = DB(spark)
    point = lambda x, y: '{"type":"Point","coordinates":[%s,%s]}' % (x, y)
    box = lambda a, b, c, d: '{"type":"Polygon","coordinates":[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]}' % (a, c, b, c, b, d, a, d, a, c)
    db.execute(f"INSERT INTO places (_key, geometry) VALUES ('central', '{point(144.9631, -37.8102)}'), ('flinders', '{point(144.9671, -37.8183)}'), ('exhibition', '{point(144.9717, -37.8047)}'), ('geelong', '{point(144.3617, -38.1499)}')")
    db.execute(f"INSERT INTO zones (_key, geometry) VALUES ('cbd', '{box(144.95, 144.98, -37.83, -37.80)}'), ('fitzroy', '{box(144.97, 145.0, -37.81, -37.79)}')")
    db.execute("""INSERT INTO routes (_key, geometry) VALUES ('tram', '{"type":"LineString","coordinates":[[144.95,-37.81],[144.96,-37.81],[144.97,-37.81],[144.98,-37.81]]}')""")
    k = lambda sql: [x for x, in values(db.query(sql), "_key")]
    assert k("SELECT _key FROM places WHERE ST_DWithin(geometry, POINT(144.9671 -37.8183), 2)") == ["central", "exhibition", "flinders"]
    assert k("SELECT _key FROM zones WHERE ST_Contains(geometry, POINT(144.9671 -37.8183))") == ["cbd"]
    cbd = "POLYGON((144.95 -37.83, 144.98 -37.83, 144.98 -37.80, 144.95 -37.80))"
    assert k(f"SELECT _key FROM places WHERE ST_Within(geometry, {cbd})") == ["central", "exhibition", "flinders"]
    assert k(f"SELECT _key FROM zones WHERE ST_Intersects(geometry, {cbd})") == ["cbd", "fitzroy"]
    assert k(f"SELECT _key FROM routes WHERE ST_Intersects(geometry, {cbd})") == ["tram"]
    assert k("SELECT _key FROM routes WHERE ST_Length(geometry, geometry, 2)") == ["tram"]
    assert k("SELECT _key FROM zones WHERE ST_Contains(geometry, POLYGON((144.96 -37.82, 144.97 -37.82, 144.97 -37.81)))") == ["cbd"]
    first = db.query("SELECT _key FROM places ORDER BY -ST_DISTANCE_KM(geometry, POINT(144.3617 -38.1499)) DESC LIMIT 1").first()
    assert first["_key"] == "geelong" and db.centroid("zones/cbd") == pytest.approx((-37.818, 144.962))
    assert geo.EARTH_KM == 6371.0


def test_cells_count_all_customers(spark, tmp_path):
    from latticeon.queries import QUERIES

    spark.range(3000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["cell_lat"], r["cell_lon"]): r["n"] for r in QUERIES["spatial_cells"](spark, str(tmp_path)).collect()}
    assert got == Counter(((-37_600 - k % 600) // 50, (144_500 + k % 1000) // 50) for k in range(3000))


def test_text(spark):
    db = DB(spark)
    db.execute("INSERT INTO docs (_key, title, body) VALUES ('1', 'rust language', 'systems programming'), ('2', 'python', 'scripting language here'), ('3', 'cooking', 'pasta recipes'), ('4', 'travel', 'places'), ('5', 'music', 'songs')")
    assert db.query("SELECT _key FROM docs WHERE BM25(title, 'rust') > 0.1").first()["_key"] == "1"
    top = db.query("SELECT _key, BM25(title, 'rust') * 0.7 + BM25(body, 'recipes') * 0.3 AS s FROM docs ORDER BY s DESC LIMIT 2").collect()
    assert [r["_key"] for r in top] == ["1", "3"]
    assert db.bm25_search("body", "recipes", 3, "docs").count() == 1
    db.execute("CREATE INDEX ON docs USING search (title, body)")
    assert values(db.query("SELECT _key FROM docs WHERE SEARCH('language')"), "_key") == [("1",), ("2",)]
    assert values(db.query("SELECT _key FROM docs WHERE SEARCH('languege')"), "_key") == [("1",), ("2",)]
    r = {x["_key"]: x["s"] for x in db.query("SELECT _key, SEARCH_SCORE('language') AS s FROM docs WHERE SEARCH('language')").collect()}
    assert r["1"] > r["2"]


def test_vectors(spark):
    db = DB(spark)
    db.execute("CREATE TABLE notes (_key TEXT PRIMARY KEY, vec VECTOR, tag TEXT)")
    db.execute("INSERT INTO notes (_key, vec, tag) VALUES " + ", ".join(f"('{i}', [{i}.0, {9 - i}.0, 0.0], '{'even' if i % 2 == 0 else 'odd'}')" for i in range(10)))
    assert [r["_key"] for r in db.query("SELECT _key FROM notes ORDER BY vec <=> [1.0, 0.0, 0.0] LIMIT 3").collect()] == ["9", "8", "7"]
    assert values(db.query("SELECT _key FROM notes WHERE tag = 'even' AND VECTOR_NEAR(vec, [1, 0, 0], 2)"), "_key") == [("6",), ("8",)]
    assert values(db.query("SELECT _key FROM notes WHERE VECTOR_NEAR(vec, [1, 0, 0], 2) AND tag = 'even'"), "_key") == [("8",)]
    assert db.get_vector("notes/3", "vec") == [3.0, 6.0, 0.0]
    with pytest.raises(QueryError):
        db.execute("INSERT INTO notes (_key, vec) VALUES ('x', 'no vector')")


def test_changes(spark, tmp_path):
    db = DB(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE t (name TEXT, n INTEGER, id TEXT DEFAULT UUIDV5('dns', 'x')) WITH (range: ['n'])")
    assert db.execute("INSERT INTO t (_key, name, n) VALUES ('a', 'x', 1), ('b', 'y', 2)") == 2
    created = db.get("t/a")["_created_unix"]
    db.execute("INSERT INTO t (_key, name, n) VALUES ('a', 'z', 3)")
    assert db.get("t/a")["name"] == "z" and db.get("t/a")["_created_unix"] == created and db.node_count() == 2
    assert len(db.get("t/a")["id"]) == 36
    db.link("t/a", "t/b", "e")
    assert db.execute("UPDATE t SET name = 'q' WHERE n >= 3") == 1 and db.get("t/a")["name"] == "q"
    db.execute("BEGIN")
    db.execute("DELETE FROM t WHERE n = 2")
    assert db.edge_count() == 0
    db.execute("ROLLBACK")
    assert db.edge_count() == 1
    db.execute("ALTER TABLE t ADD COLUMN extra REAL")
    db.execute("ALTER TABLE t RENAME COLUMN name TO label")
    db.compact()
    again = DB(spark, str(tmp_path / "db"))
    assert again.get("t/a")["label"] == "q" and again.edge_count() == 1
    assert {r["field"] for r in again.query("SHOW t").collect()} >= {"_key", "label", "n", "extra"}
    again.execute("ALTER TABLE t RENAME TO u")
    assert again.query("SHOW TABLES").first()["name"] == "u"
    again.execute("DROP TABLE u")
    assert again.node_count() == 0 and again.edge_count() == 0
    with pytest.raises(QueryError):
        again.execute("DROP TABLE u")
    tx = db.transaction()
    tx.put("t/z", {"label": "new", "n": 9})
    tx.link("t/z", "t/a", "e", 2.0)
    assert tx.commit() == 2 and db.contains("t/z") and db.edges_from("t/z").count() == 1
    db.unlink("t/z", "t/a", "e")
    db.remove("t/z")
    assert not db.contains("t/z")


def test_frames(spark):
    db = DB(spark)
    db.df.load_nodes(pd.DataFrame({"pid": ["a", "b"], "full": ["A", None], "x": [1.5, float("nan")]}), "p", "pid", {"pid": "_key", "full": "name"})
    db.df.load_edges(pd.DataFrame({"s": ["a"], "t": ["p/b"], "w": [3.0]}), "s", "t", edge_type="e", source_collection="p", target_collection="p", weight_col="w")
    assert db.edges_between("p/a", "p/b").first()["strength"] == 3.0
    got = db.df.query("SELECT _key, name, x FROM p ORDER BY _key")
    assert got["name"].tolist()[0] == "A" and got["x"].isna().tolist() == [False, True]
    db.df.create_collection("q", {"_key": "TEXT PRIMARY KEY", "v": "VECTOR"}, vector_index=["v"])
    assert db.indexes[-1] == {"on": "q", "using": "hnsw", "fields": ["v"]}
    assert "rows: 2" in db.explain("SELECT _key FROM p", analyze=True)


def test_dates(spark):
    db = DB(spark)
    db.execute("INSERT INTO posts (_key, at) VALUES ('1', '2024-07-15T14:30:45Z'), ('2', 'no date')")
    r = db.query("SELECT _key, YEAR(at) AS y, MONTH(at) AS m, DOW(at) AS w, QUARTER(at) AS q, DATE_TRUNC('month', at) AS t FROM posts ORDER BY _key").collect()
    assert tuple(r[0])[1:] == (2024, 7, 1, 3, "2024-07-01T00:00:00Z") and r[1]["y"] == 0
    assert values(db.query("SELECT _key FROM posts WHERE YEAR(at) = 2024"), "_key") == [("1",)]


def test_entry_survives_without_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("latticeon", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "latticeon" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 90, out.stderr


# ── plans ──
def plan_of(df, spark):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_reach_the_scan(spark, tmp_path):
    from latticeon.model import Graph, as_collection

    spark.createDataFrame([(i, f"n{i}", i * 1.5, i % 3) for i in range(50)] + [(99, None, None, None)], "id long, name string, bal double, k int").write.parquet(str(tmp_path / "t"))
    db = DB(spark, graph=Graph(spark, {"t": as_collection(spark.read.parquet(str(tmp_path / "t")), "t", "id")}))
    for where, pushed in (("name = 'n7'", "EqualTo(name,n7)"), ("bal > 3 AND bal <= 9", "GreaterThan(bal,3.0)"), ("k IN (1, 2)", "In(k, [1,2])"), ("bal BETWEEN 1 AND 2", "GreaterThanOrEqual(bal,1.0)"), ("name != 'n7'", "Not(EqualTo(name,n7))"), ("_key = '42'", "EqualTo(id,42)"), ("_id = 't/42'", "EqualTo(id,42)"), ("k = 1 OR k = 2 AND bal < 0", "Or(EqualTo(k,1)")):
        df = db.query(f"SELECT _key FROM t WHERE {where}")
        assert pushed in plan_of(df, spark), where
    keys = lambda q: sorted(r[0] for r in db.query(f"SELECT _key FROM t WHERE {q}").collect())
    assert keys("_key = '42'") == ["42"] and keys("_key = '042'") == [] and keys("_key != '42'") == sorted(str(i) for i in [*range(42), *range(43, 50), 99])
    assert len(keys("name != 'n7'")) == 50 and len(keys("NOT (k = 1)")) == 34 and keys("_key IN ('1', 'x', '99')") == ["1", "99"]
    assert keys("_key NOT IN ('1')") == sorted(str(i) for i in [0, *range(2, 50), 99])
    # After a change the key no longer follows the column.
    db.execute("UPDATE t SET id = 42 WHERE _key = '7'")
    assert keys("_key = '42'") == ["42"] and keys("_key = '7'") == ["7"]
    assert db.get("t/7")["id"] == 42 and db.contains("t/42") and not db.contains("t/777")


def test_equalities_are_join_keys(spark):
    db = DB(spark)
    db.execute("INSERT INTO a (_key, k) VALUES ('1', 1), ('2', 2)")
    db.execute("INSERT INTO b (_key, k) VALUES ('x', 2), ('y', 3)")
    df = db.query("SELECT x._key AS x, y._key AS y FROM a AS x, b AS y WHERE x.k = y.k")
    assert "Cartesian" not in plan_of(df, spark) and "NestedLoop" not in plan_of(df, spark)
    assert [tuple(r) for r in df.collect()] == [("2", "x")]


def test_aggregates_per_path(spark):
    db = DB(spark)
    db.execute("INSERT INTO s (_key, n) VALUES ('b', 1)")
    for i in range(1, 5):
        db.execute(f"INSERT INTO w (_key, score) VALUES ('a{i}', {i * 0.25})")
        db.link("s/b", f"w/a{i}", "did")
    q = "SELECT COUNT(*) AS cnt, AVG(a.score) AS mean FROM MATCH ('s/b')-[:did]->(a)"
    assert sorted(tuple(r) for r in db.query(q).collect()) == [(1, i * 0.25) for i in range(1, 5)]
    assert [tuple(r) for r in db.query(q, collapse=True).collect()] == [(4, 0.625)]
    assert db.query("SELECT COUNT(*) AS n FROM MATCH ('s/b')-[:did]->(a)").first()["n"] == 4


# ── indexes ──
def test_vector_index(spark):
    import numpy as np

    r = np.random.default_rng(3)
    middle = r.normal(size=(30, 24))
    v = (middle[r.integers(0, 30, 3000)] + 0.7 * r.normal(size=(3000, 24))).astype(float)
    rows = spark.createDataFrame([("c", str(i), f"c/{i}", x.tolist()) for i, x in enumerate(v)] + [("c", "n", "c/n", None), ("c", "s", "c/s", [1.0])], "_collection string, _key string, _id string, vec array<float>")
    db = DB(spark)
    db.graph = db.graph.with_collection("c", rows.cache())
    db.execute("CREATE INDEX ON c USING hnsw (vec)")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 300):
        want = {f"c/{i}" for i in np.argsort(-(unit @ unit[q]))[:10]}
        hits += len(want & {x["_id"] for x in db.vector_search("c", "vec", v[q].tolist(), 10).collect()})
    assert hits >= 90, "recall of at least 0.9"
    index = db._built["c", "vec"][1]
    assert index.probes < len(index.centroids) / 2 and len(index.cells_of(v[0])) == index.probes
    before = index
    db.execute("DELETE FROM c WHERE _key = '0'")
    assert "c/0" not in {x["_id"] for x in db.vector_search("c", "vec", v[0].tolist(), 10).collect()} and db._built["c", "vec"][1] is not before
    empty = DB(spark)
    empty.graph = empty.graph.with_collection("c", rows.limit(0))
    empty.execute("CREATE INDEX ON c USING hnsw (vec)")
    assert empty.vector_search("c", "vec", [1.0], 3).count() == 0


def test_trigram_index(spark):
    db = DB(spark)
    words = ["Straße", "strasse", "STRASSE", "str", "abc def", "abcxdef", "", None]
    db.graph = db.graph.with_collection("c", spark.createDataFrame([("c", str(i), f"c/{i}", w) for i, w in enumerate(words)], "_collection string, _key string, _id string, w string"))
    for p in ("%trass%", "ABC%DEF", "st", "%", "%abc%xyz%"):
        plain = sorted(r["_key"] for r in db.ilike("c", "w", p).select("_key").collect())
        db.execute("CREATE INDEX ON c USING gin (w)")
        assert sorted(r["_key"] for r in db.ilike("c", "w", p).select("_key").collect()) == plain
        assert set(plain) <= {r["_id"][2:] for r in db.text_index_candidates("c", "w", p).collect()}
        db.execute("DROP INDEX ON c USING gin (w)")


def test_least_gap(spark):
    from pyspark.sql import functions as F

    from latticeon.functions.text import least_gap

    rows = [([1, 9, 20], [14, 30]), ([5], [5]), ([], [1]), ([3, 3], [100, 7])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(least_gap(F.col("a"), F.col("b"))).collect()]
    assert got == [5, 0, None, 4]


def test_join_containing(spark):
    from latticeon.functions import geo

    point = lambda x, y: f'{{"type":"Point","coordinates":[{x},{y}]}}'
    box = lambda x0, y0, x1, y1: f'{{"type":"Polygon","coordinates":[[[{x0},{y0}],[{x1},{y0}],[{x1},{y1}],[{x0},{y1}],[{x0},{y0}]]]}}'
    import random

    r = random.Random(2)
    pts = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(200)]
    boxes = [(j, x, y, x + w, y + w) for j in range(20) for x, y, w in [(r.uniform(-5, 5), r.uniform(-5, 5), 10 ** r.uniform(-2, 0.9))]]
    p = spark.createDataFrame([(i, point(x, y)) for i, x, y in pts] + [(-1, None)], "i int, geometry string")
    a = spark.createDataFrame([(j, box(*b)) for j, *b in boxes] + [(-1, point(0, 0))], "j int, geometry string")
    got = sorted((x[0], x[1]) for x in geo.join_containing(p, a).select("p.i", "a.j").collect())
    assert got == sorted((i, j) for i, x, y in pts for j, x0, y0, x1, y1 in boxes if x0 < x < x1 and y0 < y < y1) and got


def test_join_containing_tests_a_text_once(spark):
    import re

    point = lambda x: f'{{"type":"Point","coordinates":[{x},0.5]}}'
    square = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}'
    p = spark.range(300).selectExpr("id AS i", f"CASE WHEN id % 3 = 0 THEN '{point(0.5)}' WHEN id % 3 = 1 THEN '{point(7)}' END AS geometry")
    a = spark.range(40).selectExpr("id AS j", f"IF(id < 30, '{square}', '{point(0.5)}') AS geometry")
    df = geo.join_containing(p, a).select("p.i", "a.j")
    assert sorted(map(tuple, df.collect())) == [(i, j) for i in range(0, 300, 3) for j in range(30)]
    # No row is parsed before the shuffle that leaves one per text, and no table is sent through the driver.
    plan = plan_of(df, spark)
    assert "Broadcast" not in plan
    raw = False
    for kind, block in re.findall(r"\n\(\d+\) (\w+)(.*?)(?=\n\(\d+\) |\Z)", plan, re.S):
        raw = kind in ("Scan", "Range") or raw and kind != "Exchange"
        assert not (raw and "json" in block), (kind, block[:300])


def test_shortest_path_broadcasts_nothing(spark, monkeypatch):
    from latticeon.model import Graph
    from latticeon.operators import graph as G

    far = 11  # levels are merged once
    pairs = [(str(i), str(i + 1)) for i in range(far)] + [("1", "2b"), ("2b", "3"), ("5", "0"), ("3", "gone"), ("gone", "11")]
    rows = lambda xs: "VALUES " + ", ".join(f"({', '.join(repr(y) for y in x)})" for x in xs)
    nodes = spark.sql(f"SELECT 'p' AS _collection, k AS _key, 'p/' || k AS _id FROM {rows([(str(i),) for i in range(far + 1)] + [('2b',), ('alone',)])} t(k)")
    graph = Graph(spark, {"p": nodes}).with_edges(spark.sql(f"SELECT 'p/' || s AS src, 'p/' || t AS dst, 'e' AS type, CAST(1 AS FLOAT) AS strength, CAST(NULL AS STRING) AS meta FROM {rows(pairs)} x(s, t)"))
    plans, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(plan_of(df, spark)) or cut(df))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    path, edges = G.shortest_path(graph, "p/0", f"p/{far}")
    assert path == [f"p/{i}" for i in range(far + 1)] and [x["to"] for x in edges] == path[1:]
    assert G.shortest_path(graph, "p/9", "p/alone") is None
    assert plans and not any("Broadcast" in x for x in plans)
    assert spark.conf.get("spark.sql.adaptive.enabled") == was
