"""Geometry over GeoJSON text columns.

A geometry is read into a list of lists of [lon, lat]. Containment looks at outer rings
only; centroids and vertex tests at all of them. All
predicates are higher-order expressions; a query polygon is a literal ring whose
tests are unrolled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def parts(g: Column, holes: bool = False) -> Column:
    """array<array<array<double>>> of a GeoJSON text: rings (outer ones, unless holes), lines or points."""
    kind = F.get_json_object(g, "$.type")
    text = F.get_json_object(g, "$.coordinates")
    read = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    return (
        F.when(kind == "Point", F.array(F.array(read(1))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(read(2)))
        .when(kind == "Polygon", read(3) if holes else F.slice(read(3), 1, 1))
        .when(kind == "MultiLineString", read(3))
        .when(kind == "MultiPolygon", F.flatten(read(4)) if holes else F.transform(read(4), lambda p: p[0]))
    )


def is_area(g: Column) -> Column:
    return F.get_json_object(g, "$.type").isin("Polygon", "MultiPolygon")


def vertices(g: Column) -> Column:
    return F.flatten(parts(g, holes=True))


def _mean(points: Column, axis: int) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)


def centroid(g: Column) -> Column:
    """struct(lon, lat): the mean of all vertices; null without any."""
    return let(vertices(g), lambda v: F.when(F.size(v) > 0, F.struct(_mean(v, 0).alias("lon"), _mean(v, 1).alias("lat"))))


def centroid_geojson(g: Column) -> Column:
    c = centroid(g)
    return F.when(c.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(c["lon"], c["lat"]).alias("coordinates"))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def dwithin(g: Column, lon: float, lat: float, km: float) -> Column:
    """Is the centroid within km of a point? A latitude band is tested first, before any trigonometry."""

    def test(c: Column) -> Column:
        band = F.abs(c["lat"] - lat) <= km / 111.0 + 0.01
        return band & (haversine_km(c["lat"], c["lon"], F.lit(lat), F.lit(lon)) <= km)

    return F.coalesce(let(centroid(g), test), F.lit(False))


def in_literal_ring(lon: Column, lat: Column, ring) -> Column:
    """Even-odd ray casting against a literal ring of (lon, lat)."""
    if len(ring) < 3:
        return F.lit(False)
    hits = []
    for (xi, yi), (xj, yj) in zip(ring, ring[-1:] + ring[:-1]):
        if yi != yj:
            hits.append((((F.lit(yi) > lat) != (F.lit(yj) > lat)) & (lon < F.lit(xj - xi) * (lat - yi) / F.lit(yj - yi) + xi)).cast("int"))
    return reduce(lambda a, b: a + b, hits) % 2 == 1 if hits else F.lit(False)


def _in_ring(lon, lat, ring: Column) -> Column:
    """The same for a point (numbers or columns) and a ring column."""
    lon, lat = (x if isinstance(x, Column) else F.lit(x) for x in (lon, lat))

    def cross(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        dy = F.when(q[1] == p[1], F.lit(None)).otherwise(q[1] - p[1])
        return F.coalesce(((p[1] > lat) != (q[1] > lat)) & (lon < (q[0] - p[0]) * (lat - p[1]) / dy + p[0]), F.lit(False))

    count = F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), cross))
    return F.when(F.size(ring) >= 3, count % 2 == 1).otherwise(False)


def contains_point(g: Column, lon: float, lat: float) -> Column:
    return F.coalesce(is_area(g) & F.exists(parts(g), lambda r: _in_ring(lon, lat, r)), F.lit(False))


def within(g: Column, ring) -> Column:
    """Are all vertices inside the ring?"""
    return F.coalesce(let(vertices(g), lambda v: (F.size(v) > 0) & F.forall(v, lambda p: in_literal_ring(p[0], p[1], ring))), F.lit(False))


def _holds(p):
    return lambda r: _in_ring(float(p[0]), float(p[1]), r)


def contains_polygon(g: Column, ring) -> Column:
    """Is each vertex of the ring in some outer ring of the geometry?"""
    if not ring:
        return F.lit(False)
    inside = lambda ps: reduce(lambda a, b: a & b, [F.exists(ps, _holds(p)) for p in ring])
    return F.coalesce(is_area(g) & let(parts(g), inside), F.lit(False))


def _cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p):
    lo, hi = (lambda x, y: F.least(x, y)), (lambda x, y: F.greatest(x, y))
    return (p[0] >= lo(a[0], b[0])) & (p[0] <= hi(a[0], b[0])) & (p[1] >= lo(a[1], b[1])) & (p[1] <= hi(a[1], b[1]))


def _segments_meet(a1, a2, b1, b2) -> Column:
    d1, d2, d3, d4 = _cross(a1, a2, b1), _cross(a1, a2, b2), _cross(b1, b2, a1), _cross(b1, b2, a2)
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    return proper | ((d1 == 0) & _on(a1, a2, b1)) | ((d2 == 0) & _on(a1, a2, b2)) | ((d3 == 0) & _on(b1, b2, a1)) | ((d4 == 0) & _on(b1, b2, a2))


def intersects(g: Column, ring) -> Column:
    """A vertex of one inside the other, or segments that meet (touching counts)."""
    closed = ring if ring[0] == ring[-1] else ring + ring[:1]
    lit = lambda p: (F.lit(float(p[0])), F.lit(float(p[1])))

    def meets(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(v) - 2)
        edge = lambda i: reduce(lambda a, b: a | b, [_segments_meet(F.get(v, i), F.get(v, i + 1), lit(p), lit(q)) for p, q in zip(closed, closed[1:])])
        return F.exists(v, lambda p: in_literal_ring(p[0], p[1], ring)) | F.when(F.size(v) >= 2, F.exists(steps, edge)).otherwise(False)

    corner = lambda ps: reduce(lambda a, b: a | b, [F.exists(ps, _holds(p)) for p in ring])
    return F.coalesce(let(vertices(g), meets), F.lit(False)) | F.coalesce(is_area(g) & let(parts(g), corner), F.lit(False))


def distance_km(g: Column, lon: float, lat: float) -> Column:
    """Point to point on the sphere; otherwise the least vertex distance in degrees times 111."""
    flat = lambda p: F.sqrt(F.pow(p[0] - lon, 2) + F.pow(p[1] - lat, 2))
    return let(vertices(g), lambda v: F.when(F.size(v) == 1, haversine_km(v[0][1], v[0][0], F.lit(lat), F.lit(lon))).when(F.size(v) > 1, F.array_min(F.transform(v, flat)) * 111.0))


def length_km(g: Column) -> Column:
    def total(v: Column) -> Column:
        step = lambda i: haversine_km(F.get(v, i)[1], F.get(v, i)[0], F.get(v, i + 1)[1], F.get(v, i + 1)[0])
        return F.when(F.size(v) >= 2, F.aggregate(F.transform(F.sequence(F.lit(0), F.size(v) - 2), step), F.lit(0.0), lambda a, b: a + b))

    return let(vertices(g), total)


def area_km2(g: Column) -> Column:
    """Shoelace area in square degrees, scaled at the mean latitude."""

    def total(v: Column) -> Column:
        n = F.size(v)
        term = lambda i: F.get(v, i)[0] * F.get(v, (i + 1) % n)[1] - F.get(v, (i + 1) % n)[0] * F.get(v, i)[1]
        deg = F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, b: a + b)) / 2
        return F.when(n >= 3, deg * 111.0 * 111.0 * F.cos(F.radians(_mean(v, 1))))

    return let(vertices(g), total)


def cell(g: Column, degrees: float) -> tuple[Column, Column]:
    """Grid cell of the centroid, for joins of two spatial tables on cells.

    Decimal arithmetic on coordinates rounded to 12 places: a point on a border belongs to the cell that begins there,
    whatever the last bits of its doubles.
    """
    c = centroid(g)
    number = "decimal(20,12)"
    index = lambda x: F.floor(x.try_cast(number) / F.lit(degrees).cast(number)).cast("long")
    return index(c["lat"]).alias("cell_lat"), index(c["lon"]).alias("cell_lon")


def join_containing(points: DataFrame, areas: DataFrame, point: str = "geometry", area: str = "geometry", degrees: float = 0.01) -> DataFrame:
    """Pairs of a row of points (as struct p) and a row of areas (struct a) that contains its centroid.

    Geometries of one text are read and tested once; rows join the pairs of texts afterwards, so that what grows with the
    square where rows share their places is only the writing of the result.
    """
    rows = lambda df, g, name: df.select(F.struct("*").alias(name), F.col(g).alias(f"{name}_text"))
    # Parsed is the result of an aggregate, not its key: else the optimizer tests (and parses) every row before it is one per text.
    texts = lambda df, g, name, parsed: df.select(F.col(g).alias(name)).distinct().groupBy(name).agg(F.min(name).alias(parsed))
    pairs = _containing_texts(texts(points, point, "p_text", "point"), texts(areas, area, "a_text", "area"), degrees)
    # Merge joins: nothing that grows with the tables passes through the driver. The side that is kept per place, areas, comes second.
    at = pairs.join(rows(areas, area, "a").hint("merge"), "a_text").select("p_text", "a")
    return rows(points, point, "p").join(at.hint("merge"), "p_text").select("p", "a")


def _containing_texts(points: DataFrame, areas: DataFrame, degrees: float) -> DataFrame:
    """The pairs (p_text, a_text) of points (p_text, point) and areas (a_text, area), one row per GeoJSON text.

    A join on grid cells, not a product. Each area goes to the level (of cells of degrees * 2^level) at which
    it spans at most two cells a side, so it has at most four; a point is looked up at each level. Pairs of a cell are
    then tested exactly. Levels are at most 20 or so: they double up to the circumference.
    """
    g = F.col("area")
    corner = lambda axis, f: f(F.transform(vertices(g), lambda v: v[axis]))
    box = areas.filter(is_area(g)).select("a_text", parts(g).alias("rings"), *[corner(i, f).alias(n) for n, i, f in (("x0", 0, F.array_min), ("x1", 0, F.array_max), ("y0", 1, F.array_min), ("y1", 1, F.array_max))])
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(degrees))
    box = box.filter("x0 IS NOT NULL").withColumn("level", F.ceil(F.log2(extent / degrees)).cast("int"))
    width = F.lit(degrees) * F.pow(F.lit(2.0), F.col("level"))
    index = lambda c: F.floor(c / width).cast("long")
    box = box.withColumn("cx", F.explode(F.sequence(index(F.col("x0")), index(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(index(F.col("y0")), index(F.col("y1")))))
    top = 1 + int(360 / degrees).bit_length()
    c = centroid(F.col("point"))
    at = points.select("p_text", c["lon"].alias("x"), c["lat"].alias("y")).filter("x IS NOT NULL")
    at = at.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("cx", index(F.col("x"))).withColumn("cy", index(F.col("y")))
    near = at.join(box.hint("merge"), ["level", "cx", "cy"]).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return near.filter(F.exists("rings", lambda r: _in_ring(F.col("x"), F.col("y"), r))).select("p_text", "a_text")
