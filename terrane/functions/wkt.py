"""Well-known text and binary to shapes at ingest, with the roles of rings found by nesting."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_SHAPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(_POINT))), T.StructField("roles", T.ArrayType(T.IntegerType()))])

_KIND = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def _ring_holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:], strict=False):
        if (a > p[0]) != (c > p[0]) and p[1] < (d - b) * (p[0] - a) / (c - a) + b:
            odd = not odd
    return odd


def ring_roles(rings: list[list[tuple[float, float]]]) -> list[int]:
    """A ring within an odd number of the others is an interior; an island in a hole is an exterior again.

    The ring's first point that is no vertex of the other ring decides.
    """
    roles = []
    for i, ring in enumerate(rings):
        depth = 0
        for j, other in enumerate(rings):
            free = next((p for p in ring if p not in other), None) if i != j else None
            depth += free is not None and _ring_holds(other, free)
        roles.append(depth % 2)
    return roles


def parse(text: str | None) -> tuple[str, list, list] | None:
    """(kind, rings, roles) of text in longitude, latitude order; None where it is no supported shape."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(\(.*\))\s*", text or "", re.DOTALL)
    if not m or m[1].upper() not in _KIND:
        return None
    try:
        rings = [[(float(lat), float(lon)) for lon, lat in (p.split() for p in r.split(","))] for r in re.findall(r"\(([^()]+)\)", m[2])]
    except ValueError:
        return None
    kind = _KIND[m[1].upper()]
    roles = ring_roles(rings) if "Polygon" in kind else [0] * len(rings)
    return (kind, rings, roles) if rings else None


#: Codes of well-known binary.
_CODES = {1: "Point", 2: "LineString", 3: "Polygon", 5: "MultiLineString", 6: "MultiPolygon"}


class _Binary:
    """Reads well-known binary from front to end; either order of bytes, two coordinates a point."""

    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, form: str) -> tuple:
        found = struct.unpack_from(self.order + form, self.data, self.at)
        self.at += struct.calcsize(self.order + form)
        return found

    def points(self, n: int) -> list[tuple[float, float]]:
        if n < 1 or self.at + 16 * n > len(self.data):
            raise ValueError("no points, or fewer than stated")
        xy = self.take(f"{2 * n}d")
        return list(zip(xy[1::2], xy[::2], strict=True))

    def shape(self) -> tuple[str, list]:
        self.order = "<" if self.take("B")[0] else ">"
        kind = _CODES[self.take("I")[0]]
        if kind == "Point":
            return kind, [self.points(1)]
        n = self.take("I")[0]
        if kind == "LineString":
            return kind, [self.points(n)]
        if kind == "Polygon":
            return kind, [self.points(self.take("I")[0]) for _ in range(n)]
        rings = []
        for _ in range(n):
            inner, found = self.shape()
            if f"Multi{inner}" != kind:
                raise ValueError(f"a {inner} in a {kind}")
            rings += found
        return kind, rings


def parse_binary(data: bytes | None) -> tuple[str, list, list] | None:
    """(kind, rings, roles) of well-known binary; None where it is no supported shape or has bytes too many or too few."""
    reader = _Binary(bytes(data or b""))
    try:
        kind, rings = reader.shape()
    except (struct.error, KeyError, ValueError):
        return None
    if reader.at != len(reader.data) or not rings or any(x != x for ring in rings for p in ring for x in p):
        return None
    return kind, rings, ring_roles(rings) if "Polygon" in kind else [0] * len(rings)


def _shapes(values: pd.Series, read) -> pd.DataFrame:
    rows = []
    for found in map(read, values):
        rows.append({"kind": None, "rings": None, "roles": None} if found is None else {"kind": found[0], "rings": [[{"lat": a, "lon": b} for a, b in r] for r in found[1]], "roles": found[2]})
    return pd.DataFrame(rows, columns=["kind", "rings", "roles"])


def _text_shapes(texts: pd.Series) -> pd.DataFrame:
    return _shapes(texts, parse)


def _binary_shapes(data: pd.Series) -> pd.DataFrame:
    return _shapes(data, parse_binary)


def shape_from_text(text: Column | str) -> Column:
    """The shape of well-known text; its fields are null where the text is no supported shape."""
    return F.pandas_udf(_text_shapes, _SHAPE)(text)


def shape_from_binary(data: Column | str) -> Column:
    """The shape of well-known binary; its fields are null where it is no supported shape."""
    return F.pandas_udf(_binary_shapes, _SHAPE)(data)
