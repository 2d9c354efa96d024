"""The spatial index: cells beside keys, searches by cover, and the join of points with shapes."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import shapes
from terrane.functions.cells import id_range, make_cell
from terrane.functions.geodesy import bind, haversine, point
from terrane.operators.cover import cover_box, cover_circle, cover_shapes, in_ranges, merge_ranges, spread

#: What a cell is to a shape: touched, partly covered, covered.
TOUCH, PART, COVER = 0, 1, 2
#: Prefixes of the join of points with shapes have so many bytes; a shape's cells are cut while so many are in part.
PREFIX_BYTES, SHAPE_CELLS = 2, 16


def _near(lat: Column, lon: Column, cell: str | None, ranges: list[tuple[int, int]]) -> Column:
    """As in_ranges, of a stored cell or of one worked out once a row."""
    return in_ranges(F.col(cell), ranges) if cell else bind(make_cell(lat, lon), lambda c: in_ranges(c, ranges))


def index_points(df: DataFrame, key: str, lat: Column, lon: Column) -> DataFrame:
    """cell_id, depth, pk0 and cell_attr of a table of points, in order of cell within each partition."""
    return df.select(make_cell(lat, lon).alias("cell_id"), F.lit(4).cast("byte").alias("depth"), F.col(key).alias("pk0"), F.lit(PART).cast("byte").alias("cell_attr")).sortWithinPartitions("cell_id")


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First place and number of what each list holds (nothing for null), and what these are places of."""
    at = lists.offsets.to_numpy()
    return at[:-1].astype(np.int64), np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at)).astype(np.int64), lists.values


def _shape_ranges(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each range of each shape of the batch (pk0, kind, rings, roles), as index_shapes has them."""
    key, kinds, *_ = batch.columns
    first, count, rings = _parts(batch.column(2))
    role_first, role_count, roles = _parts(batch.column(3))
    count = np.where(kinds.is_null().to_numpy(zero_copy_only=False), 0, count)
    if (count > 0).any() and (count != role_count)[count > 0].any():
        raise ValueError("each ring has a role")
    start, size, points = _parts(rings)
    owner, i = spread(count)
    ring, role = first[owner] + i, roles.to_numpy(zero_copy_only=False)[role_first[owner] + i]
    full = size[ring] > 0
    owner, ring, role = owner[full], ring[full], role[full]
    shape, first, count = np.unique(owner, return_index=True, return_counts=True)
    if not len(shape):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    # the points of these rings alone, in turn
    own, i = spread(size[ring])
    flat = np.stack([x.to_numpy(zero_copy_only=False).astype(float) for x in (points.field("lat"), points.field("lon"))], 1)[start[ring][own] + i]
    area = pc.is_in(kinds, pa.array(["Polygon", "MultiPolygon"])).to_numpy(zero_copy_only=False)[shape]
    at, lo, hi, whole = cover_shapes(flat, np.cumsum(size[ring]) - size[ring], size[ring], first, count, role, area, SHAPE_CELLS)
    attr = np.where(whole, COVER, PART).astype(np.int8)
    return pa.RecordBatch.from_arrays([key.take(pa.array(shape[at])), pa.array(lo), pa.array(hi), pa.array(attr)], schema=schema)


def index_shapes(df: DataFrame, key: str, geography: str) -> DataFrame:
    """pk0, lo, hi and cell_attr: disjoint ranges of the cells that a shape covers (COVER) or has a part of (PART).

    Null shapes and such without points have none. A point of a covered cell is in the shape without another test.
    """
    g = F.col(geography)
    given = df.select(F.col(key).alias("pk0"), g["kind"].alias("kind"), g["rings"].alias("rings"), g["roles"].alias("roles"))
    out = T.StructType([given.schema["pk0"], *[T.StructField(n, t, False) for n, t in (("lo", T.LongType()), ("hi", T.LongType()), ("cell_attr", T.ByteType()))]])

    def ranges(batches):
        for b in batches:
            schema = pa.schema([b.schema.field(0), ("lo", pa.int64()), ("hi", pa.int64()), ("cell_attr", pa.int8())])
            yield _shape_ranges(b, schema)

    return given.mapInArrow(ranges, out)


def seek_shapes(index: DataFrame, base: DataFrame, key: str, geography: str, box: tuple[float, float, float, float]) -> DataFrame:
    """select_intersects through a stored index_shapes: only shapes with cells in the box's cover are read and tested."""
    near = index.where(reduce(lambda a, b: a | b, [(F.col("lo") <= hi) & (F.col("hi") >= lo) for lo, hi in cover_box(*box)], F.lit(False)))
    met = near.groupBy(F.col("pk0").alias(key)).agg(F.count(F.lit(1)).alias("_cells"))
    # a test that needs both sides stays above the join: Catalyst would put one of the shape alone below it, on every row
    return base.join(met, key).where(F.when(F.col("_cells") > 0, _intersects(geography, box))).drop("_cells")


def attribute_histogram(index: DataFrame) -> DataFrame:
    """cell_attr and how many index rows have it."""
    return index.groupBy("cell_attr").agg(F.count(F.lit(1)).alias("n"))


def for_cell(index: DataFrame, cell: int, depth: int) -> DataFrame:
    """Index rows of points whose cell is below the given one. An index is best stored: its cells are then plain columns."""
    lo, hi = id_range(cell, depth)
    return index.where(F.col("cell_id").between(lo, hi))


def for_range(index: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    return index.where(in_ranges(F.col("cell_id"), cover_circle(lat, lon, metres)))


def for_box(index: DataFrame, *box: float) -> DataFrame:
    return index.where(in_ranges(F.col("cell_id"), cover_box(*box)))


def keys_of(found: DataFrame) -> DataFrame:
    """Each pk0 once."""
    return found.select("pk0").distinct()


def full_globe(index: DataFrame) -> DataFrame:
    return index.orderBy("cell_id", "depth", "pk0")


def min_max_cell(index: DataFrame) -> DataFrame:
    return index.agg(F.min("cell_id").alias("min_cell"), F.max("cell_id").alias("max_cell"))


def find_cell(index: DataFrame, cell: int) -> DataFrame:
    """The first index row from a cell on."""
    return index.where(F.col("cell_id") >= cell).orderBy("cell_id", "pk0").limit(1)


def lookup(index: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Base rows of an index's keys."""
    return base.join(index.select(F.col("pk0").alias(key)), key, "left_semi")


def within_distance(df: DataFrame, lat_column: Column, lon_column: Column, lat: float, lon: float, metres: float, cell: str | None = None, use_index: bool = True) -> DataFrame:
    """Points within so many metres: the cover of the circle first (on a stored cell column, if named), then the exact distance."""
    here = F.struct(lat_column.alias("lat"), lon_column.alias("lon"))
    exact = haversine(here, point(lat, lon)) <= metres
    return df.where(_near(lat_column, lon_column, cell, cover_circle(lat, lon, metres)) & exact) if use_index else df.where(exact)


def within_box(df: DataFrame, lat_column: Column, lon_column: Column, box: tuple[float, float, float, float], cell: str | None = None, use_index: bool = True) -> DataFrame:
    exact = lat_column.between(box[0], box[2]) & lon_column.between(box[1], box[3])
    if shapes.box_is_null(*box):
        return df.where(F.lit(False))
    return df.where(_near(lat_column, lon_column, cell, cover_box(*box)) & exact) if use_index else df.where(exact)


def nearest(df: DataFrame, lat_column: Column, lon_column: Column, lat: float, lon: float, k: int, tie: str) -> DataFrame:
    """The k nearest points, ties by a column; a top-k without a full sort."""
    d = haversine(F.struct(lat_column.alias("lat"), lon_column.alias("lon")), point(lat, lon))
    return df.withColumn("distance", d).orderBy("distance", tie).limit(k)


def select_intersects(df: DataFrame, geography: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Shapes that meet the box; nothing for a null box."""
    return df.where(_intersects(geography, box))


def _intersects(geography: str, box: tuple[float, float, float, float]) -> Column:
    return F.lit(False) if shapes.box_is_null(*box) else F.coalesce(shapes.intersects_box(F.col(geography), *box), F.lit(False))


def select_distance(df: DataFrame, geography: str, lat: float, lon: float, metres: float) -> DataFrame:
    return df.where(F.coalesce(shapes.distance(F.col(geography), point(lat, lon)) <= metres, F.lit(False)))


def join_points(points: DataFrame, lat: str, lon: str, areas: DataFrame, key: str, geography: str) -> DataFrame:
    """Each point with each area that holds it: areas' prefixes meet the points' in a hash join, then the exact test.

    An area goes once to each prefix that its cover meets; points stay single. Points under a prefix that the area covers
    skip the test. AQE broadcasts the areas if they are small and splits prefixes that hold many points.
    """
    shift = 8 * (4 - PREFIX_BYTES)
    first = F.shiftleft(F.col("_prefix"), shift)
    full = (F.col("cell_attr") == COVER) & (F.col("lo") <= first) & (F.col("hi") >= first + ((1 << shift) - 1))
    covers = index_shapes(areas, key, geography).withColumn("_prefix", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    covers = covers.groupBy(F.col("pk0").alias(key), "_prefix").agg(F.max(full).alias("_covered")).join(areas.select(key, geography), key)
    near = points.withColumn("_prefix", F.shiftright(make_cell(F.col(lat), F.col(lon)), shift)).join(covers, "_prefix")
    exact = shapes.contains(F.col(geography), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    return near.where(F.col("_covered") | exact).drop("_prefix", "_covered", geography)


class BoxCache:
    """Results of box searches by the box rounded to 1e-7 degrees, in two generations of a bounded size."""

    SCALE = 10_000_000

    def __init__(self, size: int = 64):
        self.size, self.young, self.old = size, OrderedDict(), OrderedDict()

    def get(self, df: DataFrame, geography: str, box: tuple[float, float, float, float]) -> DataFrame:
        key = tuple(round(x * self.SCALE) for x in box)
        found = self.young.get(key)
        if found is None:
            found = self.old.pop(key, None)
            found = select_intersects(df, geography, box).cache() if found is None else found
            if len(self.young) >= self.size:
                for x in self.old.values():
                    x.unpersist()
                self.young, self.old = OrderedDict(), self.young
            self.young[key] = found
        return found


def merged_cells(cells: list[tuple[int, int]], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of (cell, depth) pairs, adjacent ones joined."""
    return merge_ranges([id_range(*c) for c in cells], most)
