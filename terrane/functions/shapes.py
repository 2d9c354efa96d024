"""Shapes as Column expressions: struct<kind, rings, roles>, rings of struct<lat, lon> and a role for each ring.

kind is Point, LineString, Polygon, MultiLineString or MultiPolygon; roles are 0 (exterior, or no area) and 1 (interior).
Rings of areas are closed. Everything stays in the JVM: rings are folded with higher-order functions. Null shapes give
null, which callers turn into false or zero as they need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import geodesy as G

SHAPE = "struct<kind:string,rings:array<array<struct<lat:double,lon:double>>>,roles:array<int>>"


def shape(kind: str, rings: list[list[tuple[float, float]]], roles: list[int] | None = None) -> Column:
    """A literal; points are (lat, lon)."""
    body = F.array(*[F.array(*[G.point(*p) for p in r]) for r in rings])
    return F.struct(F.lit(kind).alias("kind"), body.alias("rings"), F.array(*[F.lit(x) for x in roles or [0] * len(rings)]).alias("roles"))


def point_shape(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.struct(lat.alias("lat"), lon.alias("lon")))).alias("rings"), F.array(F.lit(0)).alias("roles"))


def segments(ring: Column) -> Column:
    """The edges of a ring or line as struct<a, b>."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _area(g: Column) -> Column:
    return g["kind"].isin("Polygon", "MultiPolygon")


def exterior_rings(g: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(g["rings"].alias("ring"), g["roles"].alias("role")), lambda x: x["role"] == 0), lambda x: x["ring"])


def interior_rings(g: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(g["rings"].alias("ring"), g["roles"].alias("role")), lambda x: x["role"] == 1), lambda x: x["ring"])


def geometry_type(g: Column) -> Column:
    """MultiPolygon only with two exterior rings or more; otherwise a polygon with holes."""
    n = F.size(F.filter(g["roles"], lambda r: r == 0))
    return F.when(g["kind"].isin("MultiPolygon", "Polygon"), F.when(n >= 2, "MultiPolygon").otherwise("Polygon")).otherwise(g["kind"])


def points(g: Column) -> Column:
    return F.flatten(g["rings"])


def point_count(g: Column) -> Column:
    return F.size(points(g))


def object_count(g: Column) -> Column:
    return F.size(g["rings"])


def subobject(g: Column, i: int) -> Column:
    return F.get(g["rings"], i)


def envelope(g: Column) -> Column:
    lats, lons = F.transform(points(g), lambda p: p["lat"]), F.transform(points(g), lambda p: p["lon"])
    return F.struct(F.array_min(lats).alias("min_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lats).alias("max_lat"), F.array_max(lons).alias("max_lon"))


def box_centre(e: Column) -> Column:
    return F.struct(((e["min_lat"] + e["max_lat"]) / 2).alias("lat"), ((e["min_lon"] + e["max_lon"]) / 2).alias("lon"))


def in_box(p: Column, min_lat, min_lon, max_lat, max_lon) -> Column:
    """Ends included; a box does not go over the antimeridian."""
    return p["lat"].between(min_lat, max_lat) & p["lon"].between(min_lon, max_lon)


def box_is_null(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> bool:
    return abs(min_lon - max_lon) <= G.EPSILON or max_lat <= min_lat


def box_is_valid(min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> bool:
    return all(-90 <= x <= 90 for x in (min_lat, max_lat)) and all(-180 <= x <= 180 for x in (min_lon, max_lon))


def normalize_box(e: Column) -> Column:
    """A box with its corners brought to latitudes of -90 to 90 and longitudes of -180 to 180, each by itself."""
    norm = {"lat": G.norm_latitude, "lon": G.norm_longitude}
    return F.struct(*[norm[k[-3:]](e[k]).alias(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")])


def extremes(ring: Column, coordinate: str) -> Column:
    """Places of the first point with the least and the first with the greatest `lat` or `lon`; null for no points."""
    values = F.transform(ring, lambda p: p[coordinate])
    place = lambda x: F.array_position(values, x) - 1
    return F.when(F.size(ring) > 0, F.struct(place(F.array_min(values)).alias("least"), place(F.array_max(values)).alias("greatest")))


def winding(ring: Column) -> Column:
    """1: counter-clockwise; -1: clockwise (an interior ring by the shoelace rule)."""
    twice = F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]))
    return F.when(twice < 0, -1).otherwise(1)


def ring_holds(ring: Column, p: Column) -> Column:
    """Even-odd rule in the plane of latitude and longitude; a vertex is inside."""
    a, b = lambda e: e["a"], lambda e: e["b"]
    crosses = lambda e: ((a(e)["lat"] > p["lat"]) != (b(e)["lat"] > p["lat"])) & (p["lon"] < (b(e)["lon"] - a(e)["lon"]) * (p["lat"] - a(e)["lat"]) / (b(e)["lat"] - a(e)["lat"]) + a(e)["lon"])
    odd = F.aggregate(segments(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))
    return F.exists(ring, lambda v: G.equal(v, p)) | odd


def contains(g: Column, p: Column) -> Column:
    """A point by equality, an area by the even-odd rule with holes, a line by equality with a vertex."""
    inside = F.exists(exterior_rings(g), lambda r: ring_holds(r, p)) & ~F.exists(interior_rings(g), lambda r: ring_holds(r, p))
    return F.when(_area(g), inside).otherwise(F.exists(points(g), lambda v: G.equal(v, p)))


def contains_shape(g: Column, other: Column) -> Column:
    """Only an identical shape or a point can be asked for."""
    first = F.get(F.get(other["rings"], 0), 0)
    return F.when(g == other, True).when(other["kind"] == "Point", contains(g, first)).otherwise(F.raise_error(F.lit("contains takes a point or the same shape")).cast("boolean"))


def segment_meets_box(a: Column, b: Column, min_lat, min_lon, max_lat, max_lon) -> Column:
    """Liang-Barsky clipping, so collinear but separate edges don't meet."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    apart = F.lit(False)
    for d, p, least, most in ((b["lat"] - a["lat"], a["lat"], min_lat, max_lat), (b["lon"] - a["lon"], a["lon"], min_lon, max_lon)):
        flat = F.abs(d) <= G.EPSILON
        apart = apart | (flat & ((p < least) | (p > most)))
        t, u = (least - p) / F.when(flat, 1.0).otherwise(d), (most - p) / F.when(flat, 1.0).otherwise(d)
        lo = F.greatest(lo, F.when(flat, 0.0).otherwise(F.least(t, u)))
        hi = F.least(hi, F.when(flat, 1.0).otherwise(F.greatest(t, u)))
    return ~apart & (lo <= hi)


def intersects_box(g: Column, min_lat, min_lon, max_lat, max_lon) -> Column:
    """A point inside the box, an edge that meets it, or an area that holds it; a box within a hole does not meet the area."""
    edges = F.exists(F.flatten(F.transform(g["rings"], segments)), lambda e: segment_meets_box(e["a"], e["b"], min_lat, min_lon, max_lat, max_lon))
    alone = F.exists(points(g), lambda p: in_box(p, min_lat, min_lon, max_lat, max_lon))
    return alone | edges | (_area(g) & contains(g, G.point(min_lat, min_lon)))


def closest_point(g: Column, p: Column) -> Column:
    """struct<distance, point, offset, subobj>: the first edge at the least distance, over all rings."""
    rings = F.transform(g["rings"], lambda r, k: F.transform(F.when(F.size(r) == 1, F.array(F.struct(F.get(r, 0).alias("a"), F.get(r, 0).alias("b")))).otherwise(segments(r)), lambda e, i: F.struct(G.cross_track(e["a"], e["b"], p).alias("near"), i.alias("offset"), k.alias("subobj"))))
    each = F.transform(F.flatten(rings), lambda x: F.struct(x["near"]["distance"].alias("distance"), x["subobj"].alias("subobj"), x["offset"].alias("offset"), x["near"]["point"].alias("point")))
    best = F.array_min(each)
    return F.struct(best["distance"].alias("distance"), best["point"].alias("point"), best["offset"].alias("offset"), best["subobj"].alias("subobj"))


def distance(g: Column, p: Column) -> Column:
    """0 inside an area, else to the nearest edge; within a hole that is the hole's edge."""
    first = F.get(F.get(g["rings"], 0), 0)
    return F.when(g["kind"] == "Point", G.haversine(first, p)).when(_area(g) & contains(g, p), 0.0).otherwise(closest_point(g, p)["distance"])


def distance_shape(g: Column, other: Column) -> Column:
    first = F.get(F.get(other["rings"], 0), 0)
    return F.when(g == other, 0.0).when(other["kind"] == "Point", distance(g, first)).otherwise(F.raise_error(F.lit("distance takes a point or the same shape")).cast("double"))


def line_length(ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + G.haversine(e["a"], e["b"]))


def length(g: Column) -> Column:
    """Over all rings."""
    return F.aggregate(F.transform(g["rings"], line_length), F.lit(0.0), lambda s, x: s + x)


def part_length(g: Column, pos: int, count: int) -> Column:
    """Of `count` points of a line from the pos-th (0 is the first)."""
    return line_length(F.slice(F.get(g["rings"], 0), pos + 1, count))


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines a b and c d meet in the plane; null if they are parallel. The point is a + t (b - a)."""
    step = lambda p, q: {k: q[k] - p[k] for k in ("lat", "lon")}
    cross = lambda v, w: v["lon"] * w["lat"] - v["lat"] * w["lon"]
    ab, cd = step(a, b), step(c, d)
    turn = cross(ab, cd)
    t = cross(step(a, c), cd) / turn
    return F.when(F.abs(turn) > G.EPSILON, F.struct(*[(a[k] + t * ab[k]).alias(k) for k in ("lat", "lon")]))


# --- text -------------------------------------------------------------------------------------------------------


def number_text(x: Column, precision: int = 6) -> Column:
    """Significant digits as printed by default: no trailing zeros."""
    digits = F.round(x, precision)
    return F.regexp_replace(F.regexp_replace(digits.cast("decimal(20,%d)" % precision).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _ring_text(ring: Column, precision: int) -> Column:
    pairs = F.transform(ring, lambda p: F.concat_ws(" ", number_text(p["lon"], precision), number_text(p["lat"], precision)))
    return F.concat(F.lit("("), F.concat_ws(", ", pairs), F.lit(")"))


def as_text(g: Column, precision: int = 6) -> Column:
    """Well-known text, longitude first; the holes of a multipolygon stand with the exterior before them."""
    rings = F.transform(g["rings"], lambda r: _ring_text(r, precision))
    one = F.get(rings, 0)
    joined = F.concat(F.lit("("), F.concat_ws(", ", rings), F.lit(")"))
    zipped = F.arrays_zip(rings.alias("t"), g["roles"].alias("role"))
    body = F.aggregate(zipped, F.lit(""), lambda s, x: F.when(s == "", F.concat(F.lit("("), x["t"])).when(x["role"] == 0, F.concat(s, F.lit("), ("), x["t"])).otherwise(F.concat(s, F.lit(", "), x["t"])))
    kind = geometry_type(g)
    return F.when(kind == "Point", F.concat(F.lit("POINT "), one)).when(kind == "LineString", F.concat(F.lit("LINESTRING "), one)).when(kind == "MultiLineString", F.concat(F.lit("MULTILINESTRING "), joined)).when(kind == "Polygon", F.concat(F.lit("POLYGON "), joined)).otherwise(F.concat(F.lit("MULTIPOLYGON ("), body, F.lit("))")))


def part_as_text(g: Column, pos: int, count: int, make_valid: bool = False, precision: int = 6) -> Column:
    """`count` (2 or more) points of a line from the pos-th; make_valid drops points nearer than the precision to the one kept before."""
    if count < 2:
        raise ValueError("a part has two points or more")
    part = F.slice(F.get(g["rings"], 0), pos + 1, count)
    if make_valid:
        near = 10.0**-precision
        last = lambda s: F.element_at(s, -1)
        close = lambda s, p: (F.abs(last(s)["lat"] - p["lat"]) < near) & (F.abs(last(s)["lon"] - p["lon"]) < near)
        part = F.aggregate(F.slice(part, 2, count), F.slice(part, 1, 1), lambda s, p: F.when(close(s, p), s).otherwise(F.concat(s, F.array(p))))
    return F.concat(F.lit("LINESTRING "), _ring_text(part, precision))


def point_from_text(text: Column) -> Column:
    """struct<lat, lon> of POINT (lon lat); null where the text has another form."""
    number = r"\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)"
    lon, lat = F.regexp_extract(text, number, 1), F.regexp_extract(text, number, 2)
    return F.when((lon != "") & (lat != ""), F.struct(lat.try_cast("double").alias("lat"), lon.try_cast("double").alias("lon")))
