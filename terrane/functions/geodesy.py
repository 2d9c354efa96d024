"""Geodesy on a sphere as Column expressions. Angles are degrees, distances metres, points struct<lat, lon>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius and the distance at which coordinates count as equal.
RADIUS, EPSILON = 6_371_000.0, 1e-12


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def point(lat, lon) -> Column:
    return F.struct(_c(lat).alias("lat"), _c(lon).alias("lon"))


def bind(value: Column, use) -> Column:
    """use(v) where v is value worked out once: an expression that stands in many places makes plans explode."""
    return F.get(F.transform(F.array(value), use), 0)


def equal(p: Column, q: Column) -> Column:
    """Both coordinates within EPSILON."""
    return (F.abs(p["lat"] - q["lat"]) <= EPSILON) & (F.abs(p["lon"] - q["lon"]) <= EPSILON)


def match(p: Column, q: Column) -> Column:
    """Equal places: a pole has one place for all longitudes, and 180 and -180 are one meridian."""
    pole = (F.abs(F.abs(p["lat"]) - 90) <= EPSILON) & (F.abs(p["lat"] - q["lat"]) <= EPSILON)
    edge = (F.abs(F.abs(p["lon"]) - 180) <= EPSILON) & (F.abs(F.abs(q["lon"]) - 180) <= EPSILON) & (F.abs(p["lat"] - q["lat"]) <= EPSILON)
    return equal(p, q) | pole | edge


def sort_key(p: Column) -> Column:
    """Points are in order of longitude, then latitude."""
    return F.struct(p["lon"], p["lat"])


def norm_longitude(x: Column) -> Column:
    return F.when(F.abs(x) <= 180, x).otherwise(F.pmod(x + 180, F.lit(360.0)) - 180)


def norm_latitude(x: Column) -> Column:
    """Reflected over the poles."""
    turn = F.pmod(x, F.lit(360.0))
    return F.when(F.abs(x) <= 90, x).when(turn > 270, turn - 360).when(turn > 90, 180 - turn).otherwise(turn)


def haversine(p: Column, q: Column) -> Column:
    dlat, dlon = F.radians(q["lat"] - p["lat"]) / 2, F.radians(q["lon"] - p["lon"]) / 2
    a = F.sqrt(F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(p["lat"])) * F.cos(F.radians(q["lat"])) * F.pow(F.sin(dlon), F.lit(2.0)))
    return F.when(equal(p, q), 0.0).when(a >= 1, math.pi * RADIUS).otherwise(2 * RADIUS * F.asin(F.least(a, F.lit(1.0))))


def law_of_cosines(p: Column, q: Column) -> Column:
    a, b = F.radians(p["lat"]), F.radians(q["lat"])
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(q["lon"] - p["lon"]))
    return RADIUS * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def course(p: Column, q: Column) -> Column:
    """Bearing from p to q in [0, 360): 180 from the north pole, 0 from the south pole and between equal points."""
    a, b, d = F.radians(p["lat"]), F.radians(q["lat"]), F.radians(q["lon"] - p["lon"])
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    turn = F.pmod(F.round(F.pmod(turn, F.lit(360.0)), 12), F.lit(360.0))  # just under 0 must not become 360
    return F.when(equal(p, q), 0.0).when(F.abs(p["lat"] - 90) <= EPSILON, 180.0).when(F.abs(p["lat"] + 90) <= EPSILON, 0.0).otherwise(turn)


def angle(p: Column, at: Column, q: Column) -> Column:
    """Angle of p, at, q; 0 where `at` equals a neighbour, 180 where p equals q."""
    d = F.abs(course(at, q) - course(p, at))
    d = F.when(d > 180, 360 - d).otherwise(d)
    return F.when(equal(p, at) | equal(at, q), 0.0).when(equal(p, q), 180.0).otherwise(180 - d)


def destination(p: Column, metres, bearing) -> Column:
    """Where a great circle leads; a distance of 0 or less leads nowhere. Bearings of 90 and 270 keep the latitude; from a pole the bearing is the longitude."""
    here = F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    s, turn = _c(metres) / RADIUS, _c(bearing)
    a, b = F.radians(p["lat"]), F.radians(turn)
    east = (F.abs(turn - 90) <= EPSILON) | (F.abs(turn - 270) <= EPSILON)
    to = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a) * F.cos(s) + F.cos(a) * F.sin(s) * F.cos(b))))
    pole = F.abs(F.abs(p["lat"]) - 90) <= EPSILON

    def end(t: Column) -> Column:
        lon = p["lon"] + F.degrees(F.atan2(F.sin(b) * F.sin(s) * F.cos(a), F.cos(s) - F.sin(a) * F.sin(t)))
        return F.struct(F.degrees(t).alias("lat"), F.when(pole, turn).otherwise(lon).alias("lon"))

    def tidy(e: Column) -> Column:
        return F.struct(norm_latitude(e["lat"]).alias("lat"), F.when(F.abs(F.abs(e["lat"]) - 90) <= 1e-9, 0.0).otherwise(norm_longitude(e["lon"])).alias("lon"))

    return F.when(_c(metres) <= 0, here).otherwise(bind(bind(F.when(east, a).otherwise(to), end), tidy))


def cross_track(a: Column, b: Column, p: Column) -> Column:
    """struct<distance, point>: from p to the segment a b."""
    limit = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    fold = lambda d: F.when(d > 180, 360 - d).otherwise(d)
    first = F.struct(bind(F.abs(course(a, p) - course(a, b)), fold).alias("turn"), haversine(a, p).alias("ap"), haversine(a, b).alias("ab"))

    def second(x: Column) -> Column:
        off = F.asin(limit(F.sin(x["ap"] / RADIUS) * F.sin(F.radians(x["turn"]))))
        along = RADIUS * F.acos(limit(F.cos(x["ap"] / RADIUS) / F.cos(off)))
        return F.struct(x["turn"].alias("turn"), x["ab"].alias("ab"), along.alias("along"))

    def foot(x: Column) -> Column:
        return F.when((x["turn"] > 90) | equal(a, b) | equal(a, p), a).when(x["along"] >= x["ab"], b).otherwise(destination(a, x["along"], course(a, b)))

    return bind(bind(bind(first, second), foot), lambda to: F.struct(haversine(p, to).alias("distance"), to.alias("point")))


def planar_closest(a: Column, b: Column, p: Column) -> Column:
    """The orthogonal projection of p on the segment a b in the plane of latitude and longitude, the short way round."""
    short = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    bx, by = short(b["lon"] - a["lon"]), b["lat"] - a["lat"]
    px, py = short(p["lon"] - a["lon"]), p["lat"] - a["lat"]
    n = bx * bx + by * by
    t = F.when(n <= EPSILON, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / n)))
    return F.struct((a["lat"] + t * by).alias("lat"), norm_longitude(a["lon"] + t * bx).alias("lon"))


def to_polar(x: Column, y: Column) -> Column:
    """struct<radius, angle> with the angle in degrees; (0, 0) has angle 0."""
    return F.struct(F.hypot(x, y).alias("radius"), F.degrees(F.atan2(y, x)).alias("angle"))


# --- comparisons with a tolerance ---------------------------------------------------------------------------------


def fequal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def fzero(a: Column) -> Column:
    return F.abs(a) <= EPSILON


def fless(a: Column, b: Column) -> Column:
    return a < b - EPSILON


def frange(a: Column, lo, hi) -> Column:
    return a.between(_c(lo) - EPSILON, _c(hi) + EPSILON)


def fsign(a: Column) -> Column:
    return F.when(a > EPSILON, 1).when(a < -EPSILON, -1).otherwise(0)
