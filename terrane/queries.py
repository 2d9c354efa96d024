"""The queries of the engine's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import cells, dates, geodesy, shapes, text
from terrane.functions.wkt import shape_from_text
from terrane.operators import keys, sets, spatial
from terrane.operators.components import connected_components
from terrane.plans.predicates import USE, All, Between, Greater, GreaterEq, If, In, IsNull, Less, LessEq, Not, NotNull, STContains, STDistance, STIntersects, STLength, Where
from terrane.plans.query import Select
from terrane.runtime import cut
from terrane.schema import ColumnDef, KeyPart, TableDef
from terrane.sources.catalog import KEYS, Catalog, null_counts
from terrane.sources.dump import dump
from terrane.streaming.windows import sessions, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- predicates, order, top --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 500 AND o_totalprice > 50000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def flagship(c: Catalog):
    return c.select("orders").or_(Between("o_orderkey", 100, 500)).and_(Greater("o_totalprice", 50000.0)).order_by("o_totalprice", False).top(10).project("o_orderkey", "o_totalprice").df()


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 50000")
def scan_filter_or_and(c: Catalog):
    return c.select("orders").or_(Where("o_orderstatus", "F")).or_(Where("o_orderpriority", "1-URGENT")).and_(Greater("o_totalprice", 50000.0)).df()


def _simple(name: str, table: str, predicate, where: str, *columns: str):
    ORACLE[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"
    QUERIES[name] = lambda spark, sf_dir: Catalog(spark, sf_dir).select(table).or_(predicate).project(*columns).df()


_simple("select_all", "nation", All(), "true", "n_nationkey", "n_name", "n_regionkey")
_simple("where_eq", "customer", Where("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'", "c_custkey", "c_name")
_simple("in_list", "part", In("p_size", 1, 2, 3), "p_size IN (1, 2, 3)", "p_partkey", "p_size")
_simple("not_in", "part", Not("p_size", 1, 2, 3), "p_size NOT IN (1, 2, 3)", "p_partkey", "p_size")
_simple("less", "customer", Less("c_acctbal", 100.0), "c_acctbal < 100", "c_custkey", "c_acctbal")
_simple("greater", "customer", Greater("c_acctbal", 9000.0), "c_acctbal > 9000", "c_custkey", "c_acctbal")
_simple("less_eq", "lineitem", LessEq("l_quantity", 2.0), "l_quantity <= 2", "l_orderkey", "l_linenumber", "l_quantity")
_simple("greater_eq", "lineitem", GreaterEq("l_quantity", 49.0), "l_quantity >= 49", "l_orderkey", "l_linenumber", "l_quantity")
_simple("between", "lineitem", Between("l_orderkey", 100, 300), "l_orderkey BETWEEN 100 AND 300", "l_orderkey", "l_linenumber")
_simple("float_eq_eps", "lineitem", Where("l_discount", 0.05), "l_discount BETWEEN CAST(0.05 AS DOUBLE) - CAST(1e-12 AS DOUBLE) AND CAST(0.05 AS DOUBLE) + CAST(1e-12 AS DOUBLE)", "l_orderkey", "l_linenumber", "l_discount")
_simple("where_text_range", "nation", Between("n_name", "NATION_1", "NATION_2"), "n_name BETWEEN 'NATION_1' AND 'NATION_2'", "n_nationkey", "n_name")

_HOLED = "SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 1000 THEN NULL ELSE s_acctbal END AS bal FROM supplier"


def _holed(c: Catalog, null_mode: str = "sql") -> Select:
    df = c.table("supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 1000, F.col("s_acctbal")).alias("bal"))
    return Select(TableDef("s", (ColumnDef("s_suppkey", "bigint"), ColumnDef("s_nationkey", "int"), ColumnDef("bal", "float")), (KeyPart("s_suppkey"),)), df, null_mode)


@query(f"SELECT * FROM ({_HOLED}) WHERE bal IS NULL")
def is_null(c: Catalog):
    return _holed(c).or_(IsNull("bal")).df()


@query(f"SELECT * FROM ({_HOLED}) WHERE bal IS NOT NULL")
def not_null(c: Catalog):
    return _holed(c).or_(NotNull("bal")).df()


@query(f"SELECT * FROM ({_HOLED}) WHERE coalesce(bal, 0) < 1500")
def null_default_less(c: Catalog):
    return _holed(c, "default_value").or_(Less("bal", 1500.0)).df()


@query(f"SELECT * FROM ({_HOLED}) WHERE coalesce(bal, 0) > 1500")
def null_default_greater(c: Catalog):
    return _holed(c, "default_value").or_(Greater("bal", 1500.0)).df()


@query(f"SELECT * FROM ({_HOLED}) WHERE coalesce(bal, 0) NOT IN (5)")
def null_default_not(c: Catalog):
    return _holed(c, "default_value").or_(Not("bal", 5.0)).df()


@query(f"SELECT * FROM ({_HOLED}) ORDER BY coalesce(bal, 0), s_suppkey LIMIT 15")
def null_default_order(c: Catalog):
    return _holed(c, "default_value").or_(All()).order_by("bal").top(15).df()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 80000")
def lambda_filter(c: Catalog):
    return c.select("lineitem").or_(If(lambda col: col("l_extendedprice") * (1 - col("l_discount")) > 80000)).project("l_orderkey", "l_linenumber").df()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 50 AND o_orderkey < 60")
def key_conjunction(c: Catalog):
    return c.select("orders").or_(All()).and_(Greater("o_orderkey", 50)).and_(Less("o_orderkey", 60)).project("o_orderkey").df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20")
def top_n(c: Catalog):
    return c.select("orders").or_(Where("o_orderstatus", "O")).top(20).project("o_orderkey", "o_totalprice").df()


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def order_by_multi(c: Catalog):
    return c.select("customer").or_(All()).order_by("c_mktsegment").order_by("c_acctbal", False).top(50).project("c_custkey", "c_mktsegment", "c_acctbal").df()


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_order_by(c: Catalog):
    return c.select("part").or_(All()).order_by("p_retailprice", False).top(25).project("p_partkey", "p_retailprice").df()


@query("SELECT o_orderkey FROM orders LIMIT 0")
def top_zero(c: Catalog):
    return c.select("orders").or_(All()).top(0).project("o_orderkey").df()


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_filtered(c: Catalog):
    return c.select("orders").or_(Where("o_orderstatus", "F")).count_df()


@query("SELECT least(count(*), 100) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_top(c: Catalog):
    return c.select("orders").or_(Where("o_orderstatus", "F")).top(100).count_df()


# --- key access --------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def key_find(c: Catalog):
    return keys.find_with_key(c.definition("orders"), c.table("orders"), 77)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 77 AND l_linenumber = 1 ORDER BY ALL LIMIT 1")
def composite_key_find(c: Catalog):
    return keys.find_with_key(c.definition("lineitem"), c.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 77, 1)


@query("SELECT o_orderkey, o_totalprice, o_orderkey = 78 AS is_equal FROM orders WHERE o_orderkey >= 78 ORDER BY o_orderkey LIMIT 1")
def lower_bound(c: Catalog):
    return keys.lower_bound(c.definition("orders"), c.table("orders").select("o_orderkey", "o_totalprice"), 78)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 200 ORDER BY o_orderkey LIMIT 30")
def scan_next(c: Catalog):
    return keys.walk(c.definition("orders"), c.table("orders").select("o_orderkey"), 200).limit(30)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <= 200 ORDER BY o_orderkey DESC LIMIT 30")
def scan_prev(c: Catalog):
    return keys.walk(c.definition("orders"), c.table("orders").select("o_orderkey"), 200, forward=False).limit(30)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 90 OR (l_orderkey = 90 AND l_linenumber >= 2) ORDER BY l_orderkey, l_linenumber LIMIT 40")
def composite_walk(c: Catalog):
    return keys.walk(c.definition("lineitem"), c.table("lineitem").select("l_orderkey", "l_linenumber").distinct(), 90, 2).limit(40)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 10 AND 50 OR o_orderkey BETWEEN 40 AND 90")
def keyed_union(c: Catalog):
    k = F.col("o_orderkey")
    return keys.seek_any(c.table("orders").select("o_orderkey", "o_custkey"), k.between(10, 50), k.between(40, 90))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 90")
def union_by_key(c: Catalog):
    o = c.table("orders").select("o_orderkey")
    return keys.union_by_key(c.definition("orders"), o.where("o_orderkey BETWEEN 10 AND 50"), o.where("o_orderkey BETWEEN 40 AND 90"))


# --- geography ---------------------------------------------------------------------------------------------------

_LATLON = "CAST((event_id * 7919) % 17001 AS DOUBLE) / 100 - 85 AS lat, CAST((event_id * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lon"
_E = f"SELECT event_id, {_LATLON} FROM events"
_LAT0, _LON0 = 48.7139, 44.4984
_HAV = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


def _hav(lat1, lat2, lon1, lon2) -> str:
    return _HAV.format(lat1, lat2, lon1, lon2)


_D0 = _hav("lat", _LAT0, "lon", _LON0)


def _located(c: Catalog, name: str = "events", key: str = "event_id") -> DataFrame:
    k = F.col(key)
    return c.table(name).select(key, ((k * 7919 % 17001).cast("double") / 100 - 85).alias("lat"), ((k * 104729 % 36000).cast("double") / 100 - 180).alias("lon"))


def _here() -> Column:
    return F.struct("lat", "lon")


@query(f"SELECT event_id, round({_D0}, 3) AS metres FROM ({_E})")
def geo_distance(c: Catalog):
    return _located(c).select("event_id", F.round(geodesy.haversine(_here(), geodesy.point(_LAT0, _LON0)), 3).alias("metres"))


@query(f"SELECT event_id FROM ({_E}) WHERE {_D0} <= 1500000")
def geo_within(c: Catalog):
    return spatial.within_distance(_located(c), F.col("lat"), F.col("lon"), _LAT0, _LON0, 1_500_000.0).select("event_id")


@query(f"SELECT event_id, round({_D0}, 3) AS metres FROM ({_E}) ORDER BY {_D0}, event_id LIMIT 20")
def geo_knn(c: Catalog):
    return spatial.nearest(_located(c), F.col("lat"), F.col("lon"), _LAT0, _LON0, 20, "event_id").select("event_id", F.round("distance", 3).alias("metres"))


@query(f"SELECT event_id, lat, lon FROM ({_E}) WHERE lat BETWEEN 10.5 AND 42.25 AND lon BETWEEN -20.5 AND 71.125")
def geo_rect(c: Catalog):
    return spatial.within_box(_located(c), F.col("lat"), F.col("lon"), (10.5, -20.5, 42.25, 71.125)).select("event_id", "lat", "lon")


@query(f"SELECT event_id, lat, lon FROM ({_E}) WHERE lat BETWEEN 71 AND 89 AND lon BETWEEN 100 AND 179.5")
def geo_rect_polar(c: Catalog):
    return spatial.within_box(_located(c), F.col("lat"), F.col("lon"), (71.0, 100.0, 89.0, 179.5)).select("event_id", "lat", "lon")


_POLYGON = [(10.005, 10.005), (50.005, 20.005), (40.005, 60.005), (15.005, 45.005), (10.005, 10.005)]
_HOLE = [(25.005, 25.005), (25.005, 35.005), (35.005, 35.005), (35.005, 25.005), (25.005, 25.005)]


def _crossing_sql(ring: list[tuple[float, float]]) -> str:
    edges = [f"CASE WHEN ({a} > lat) <> ({c} > lat) AND lon < ({d} - {b}) * (lat - {a}) / ({c} - {a}) + {b} THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(ring, ring[1:], strict=False)]
    return f"(({' + '.join(edges)}) % 2 = 1)".replace("(", "(", 1)


_IN_POLYGON = f"{_crossing_sql(_POLYGON)} AND NOT {_crossing_sql(_HOLE)}"


def _as_table(c: Catalog) -> Select:
    df = _located(c).select("event_id", "lat", "lon", shapes.point_shape(F.col("lat"), F.col("lon")).alias("g"))
    return Select(TableDef("e", (ColumnDef("event_id", "bigint"), ColumnDef("lat", "float"), ColumnDef("lon", "float"), ColumnDef("g", "geography")), (KeyPart("event_id"),), "g"), df)


@query(f"SELECT event_id FROM ({_E}) WHERE {_IN_POLYGON}")
def geo_polygon_contains(c: Catalog):
    area = shapes.shape("Polygon", [_POLYGON, _HOLE], [0, 1])
    return _located(c).where(shapes.contains(area, _here())).select("event_id")


@query(f"SELECT event_id FROM ({_E}) WHERE {_D0} < 900000")
def st_distance_predicate(c: Catalog):
    return _as_table(c).or_(STDistance("g", "less", _LAT0, _LON0, 900_000.0)).project("event_id").df()


@query(f"SELECT event_id FROM ({_E}) WHERE lat BETWEEN -30 AND -10 AND lon BETWEEN 5 AND 25")
def st_intersects_predicate(c: Catalog):
    return _as_table(c).or_(STIntersects("g", -30.0, 5.0, -10.0, 25.0)).project("event_id").df()


@query(f"SELECT event_id FROM ({_E}) WHERE abs(lat + 85) <= 1e-12 AND abs(lon + 180) <= 1e-12")
def st_contains_predicate(c: Catalog):
    return _as_table(c).or_(STContains("g", -85.0, -180.0)).project("event_id").df()


@query(f"SELECT event_id FROM ({_E}) ORDER BY {_D0} DESC, event_id LIMIT 12")
def order_by_geo(c: Catalog):
    return _as_table(c).or_(All()).order_by("g", False, _LAT0, _LON0).top(12).project("event_id").df()


def _with_cells(c: Catalog) -> Select:
    """The same table with a stored column of cells."""
    plain = _as_table(c)
    return Select(replace(plain.table, columns=(*plain.table.columns, ColumnDef("cell", "bigint")), cell="cell"), cut(plain.source.withColumn("cell", cells.make_cell(F.col("lat"), F.col("lon")))))


@query(f"SELECT event_id FROM ({_E}) WHERE {_D0} < 900000 OR lat BETWEEN -30 AND -10 AND lon BETWEEN 5 AND 25")
def spatial_seek(c: Catalog):
    return _with_cells(c).or_(STDistance("g", "less", _LAT0, _LON0, 900_000.0, hint=USE)).or_(STIntersects("g", -30.0, 5.0, -10.0, 25.0, hint=USE)).project("event_id").df()


def _squares(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Around each point away from the edges of the plane a square with a square hole, an equal one 8 degrees further on, and a diagonal."""
    at = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    ring = lambda r, dx: F.array(at(-r, dx - r), at(-r, dx + r), at(r, dx + r), at(r, dx - r), at(-r, dx - r))
    several = F.struct(F.lit("MultiPolygon").alias("kind"), F.array(ring(2, 0), ring(1, 0), ring(2, 8)).alias("rings"), F.array(F.lit(0), F.lit(1), F.lit(0)).alias("roles"))
    line = F.struct(F.lit("LineString").alias("kind"), F.array(F.array(at(-3, -3), at(3, 3))).alias("rings"), F.array(F.lit(0)).alias("roles"))
    return rows.where(_INSIDE).select(key, "lat", "lon", several.alias("g"), line.alias("l"))


_INSIDE = "abs(lat) < 80 AND lon BETWEEN -170 AND 160"
_BOX = (9.997, 19.997, 12.003, 23.003)


def _square_sql(east: int, box: tuple[float, float, float, float] = _BOX) -> str:
    return f"(lat + 2 >= {box[0]} AND lat - 2 <= {box[2]} AND lon + {east} + 2 >= {box[1]} AND lon + {east} - 2 <= {box[3]})"


@query(f"SELECT event_id FROM ({_E}) WHERE {_INSIDE} AND ({_square_sql(0)} AND NOT (lat - 1 < {_BOX[0]} AND lat + 1 > {_BOX[2]} AND lon - 1 < {_BOX[1]} AND lon + 1 > {_BOX[3]}) OR {_square_sql(8)})")
def shape_intersects(c: Catalog):
    return spatial.select_intersects(_squares(_located(c)), "g", _BOX).select("event_id")


@query(f"SELECT event_id FROM ({_E}) WHERE {_INSIDE} AND greatest(-3, {_BOX[0]} - lat, {_BOX[1]} - lon) <= least(3, {_BOX[2]} - lat, {_BOX[3]} - lon)")
def line_intersects(c: Catalog):
    return spatial.select_intersects(_squares(_located(c)), "l", _BOX).select("event_id")


_HELD = "(abs(lat - 11.003) < 2 AND abs(lon - 21.003) < 2 AND NOT (abs(lat - 11.003) < 1 AND abs(lon - 21.003) < 1) OR abs(lat - 11.003) < 2 AND abs(lon + 8 - 21.003) < 2)"


@query(f"SELECT event_id FROM ({_E}) WHERE {_INSIDE} AND {_HELD}")
def shape_contains(c: Catalog):
    return _squares(_located(c)).where(shapes.contains(F.col("g"), geodesy.point(11.003, 21.003))).select("event_id")


@query(f"SELECT event_id FROM ({_E}) WHERE {_INSIDE} AND {_HELD}")
def shape_distance_zero(c: Catalog):
    return spatial.select_distance(_squares(_located(c)), "g", 11.003, 21.003, 0.0).select("event_id")


_WIDE = (-10.003, 19.997, 12.003, 53.003)


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {_LATLON.replace('event_id', 'c_custkey')} FROM customer) WHERE {_INSIDE} AND ({_square_sql(0, _WIDE)} OR {_square_sql(8, _WIDE)})")
def shape_index_seek(c: Catalog):
    # dealt by key: a file of customers is small for the work that a shape is
    rows = _squares(_located(c, "customer", "c_custkey").repartition("c_custkey"), "c_custkey")
    return spatial.seek_shapes(cut(spatial.index_shapes(rows, "c_custkey", "g")), rows, "c_custkey", "g", _WIDE).select("c_custkey")


@query(f"SELECT 2 AS cell_attr, count(*) > 0 AS met, true AS inside FROM ({_E})")
def shape_index_covered(c: Catalog):
    """Events in covered cells of the polygon are in the polygon, and there are some."""
    area = c.spark.range(1).select("id", shapes.shape("Polygon", [_POLYGON, _HOLE], [0, 1]).alias("g"))
    index = spatial.index_shapes(area, "id", "g").where(F.col("cell_attr") == spatial.COVER)
    met = _located(c).withColumn("cell", cells.make_cell(F.col("lat"), F.col("lon"))).join(index, F.col("cell").between(F.col("lo"), F.col("hi")))
    inside = shapes.contains(shapes.shape("Polygon", [_POLYGON, _HOLE], [0, 1]), _here())
    return met.agg(F.max(F.col("cell_attr").cast("int")).alias("cell_attr"), (F.count(F.lit(1)) > 0).alias("met"), F.every(inside).alias("inside"))


def _line(c: Catalog) -> DataFrame:
    """Three points a row: the event's, one fixed and one shifted."""
    ring = F.array(_here(), geodesy.point(10.0, 20.0), F.struct((-F.col("lat") / 2).alias("lat"), (F.col("lon") / 2).alias("lon")))
    return _located(c).select("event_id", F.struct(F.lit("LineString").alias("kind"), F.array(ring).alias("rings"), F.array(F.lit(0)).alias("roles")).alias("g"))


_LENGTH = f"{_hav('lat', '10', 'lon', '20')} + {_hav('10', '(-lat / 2)', '20', '(lon / 2)')}"


@query(f"SELECT event_id, round({_LENGTH}, 3) AS metres FROM ({_E})")
def geo_length(c: Catalog):
    return _line(c).select("event_id", F.round(shapes.length(F.col("g")), 3).alias("metres"))


@query(f"SELECT event_id FROM ({_E}) WHERE {_LENGTH} > 15000000")
def st_length_predicate(c: Catalog):
    table = TableDef("l", (ColumnDef("event_id", "bigint"), ColumnDef("g", "geography")), (KeyPart("event_id"),), "g")
    return Select(table, _line(c)).or_(STLength("g", "greater", 15_000_000.0)).project("event_id").df()


_COURSE = f"degrees(atan2(sin(radians({_LON0} - lon)) * cos(radians({_LAT0})), cos(radians(lat)) * sin(radians({_LAT0})) - sin(radians(lat)) * cos(radians({_LAT0})) * cos(radians({_LON0} - lon))))"


@query(f"SELECT event_id, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 6) AS course FROM (SELECT event_id, {_COURSE} AS x FROM ({_E}))")
def geo_course(c: Catalog):
    return _located(c).select("event_id", F.round(geodesy.course(_here(), geodesy.point(_LAT0, _LON0)), 6).alias("course"))


_S, _B = 1_000_000 / 6_371_000, 37
_TO = f"asin(sin(radians(lat)) * cos({_S}) + cos(radians(lat)) * sin({_S}) * cos(radians({_B})))"
_TOLON = f"lon + degrees(atan2(sin(radians({_B})) * sin({_S}) * cos(radians(lat)), cos({_S}) - sin(radians(lat)) * sin(to)))"


@query(f"SELECT event_id, round(degrees(to), 6) AS lat2, round(CASE WHEN l > 180 THEN l - 360 WHEN l < -180 THEN l + 360 ELSE l END, 6) AS lon2 FROM (SELECT *, {_TOLON} AS l FROM (SELECT *, {_TO} AS to FROM ({_E})))".replace(" to ", " t_o ").replace("(to)", "(t_o)").replace("AS to ", "AS t_o "))
def geo_destination(c: Catalog):
    to = geodesy.destination(_here(), 1_000_000.0, 37.0)
    return _located(c).select("event_id", F.round(to["lat"], 6).alias("lat2"), F.round(to["lon"], 6).alias("lon2"))


@query(f"SELECT min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM (SELECT CAST(x AS DOUBLE) AS lat, CAST(y AS DOUBLE) AS lon FROM (VALUES {', '.join(str(p) for p in _POLYGON)}) t(x, y))")
def geo_envelope(c: Catalog):
    return c.spark.range(1).select(shapes.envelope(shapes.shape("Polygon", [_POLYGON])).alias("e")).select("e.*")


_PRINTED = "rtrim(rtrim(CAST(CAST({0} AS DECIMAL(10, 2)) AS VARCHAR), '0'), '.')"


@query(f"SELECT event_id, 'POINT (' || {_PRINTED.format('lon')} || ' ' || {_PRINTED.format('lat')} || ')' AS wkt FROM ({_E})")
def geo_as_text(c: Catalog):
    return _located(c).select("event_id", shapes.as_text(shapes.point_shape(F.col("lat"), F.col("lon"))).alias("wkt"))


#: The same cells in SQL: octahedron face, plane, unit square, then the curve's place of each of the four digits.
_CELLS = f"""SELECT event_id, p[(x >> 12) * 16 + (y >> 12) + 1] * 16777216 + p[((x >> 8) & 15) * 16 + ((y >> 8) & 15) + 1] * 65536
    + p[((x >> 4) & 15) * 16 + ((y >> 4) & 15) + 1] * 256 + p[(x & 15) * 16 + (y & 15) + 1] AS cell
  FROM (SELECT event_id, {[int(p) for p in cells.PLACES.reshape(-1)]}::BIGINT[] AS p, CAST(least(65535, greatest(0, floor(u * 65536))) AS BIGINT) AS x, CAST(least(65535, greatest(0, floor(v * 65536))) AS BIGINT) AS y
  FROM (SELECT event_id, CASE q WHEN 0 THEN 1 - b WHEN 1 THEN 1 - a WHEN 2 THEN b ELSE a END AS u,
    CASE q WHEN 0 THEN 0.5 + n * a WHEN 1 THEN CASE n WHEN 1 THEN 1 - b ELSE b END WHEN 2 THEN CASE n WHEN 1 THEN 1 - a ELSE a END ELSE 0.5 + n * b END AS v
  FROM (SELECT event_id, q, n, (y / (x + y + z) - x / (x + y + z) + 1) / sqrt(2.0) * (CASE WHEN q % 2 = 1 THEN 1.0 ELSE 0.5 END / sqrt(2.0)) AS a,
    (z / (x + y + z) - (x / (x + y + z) - 1) / 2 - y / (x + y + z) / 2) / sqrt(1.5) * (CASE WHEN q % 2 = 1 THEN 0.25 ELSE 0.5 END / sqrt(1.5)) AS b
  FROM (SELECT event_id, q, n, cos(up) * cos(m) AS x, cos(up) * sin(m) AS y, sin(up) AS z
  FROM (SELECT event_id, q, CASE WHEN lat >= 0 THEN 1 ELSE -1 END AS n, radians(abs(lat)) AS up,
    radians(CASE q WHEN 0 THEN lon + 45 WHEN 1 THEN lon - 45 WHEN 3 THEN lon + 135 ELSE CASE WHEN lon >= 0 THEN lon - 135 ELSE lon + 225 END END) AS m
  FROM (SELECT event_id, lat, lon, CASE WHEN lon >= -45 AND lon < 45 THEN 0 WHEN lon >= 45 AND lon < 135 THEN 1 WHEN lon >= -135 AND lon < -45 THEN 3 ELSE 2 END AS q FROM ({_E})))))))"""


@query(_CELLS)
def cell_id(c: Catalog):
    return _located(c).select("event_id", cells.make_cell(F.col("lat"), F.col("lon")).alias("cell"))


_BOXES = [(i, -40.0 + 20 * i, -150.0 + 60 * i, -15.5 + 20 * i, -90.5 + 60 * i) for i in range(5)]


@query(f"SELECT event_id, k FROM ({_E}) JOIN (VALUES {', '.join(map(str, _BOXES))}) t(k, a, b, c, d) ON lat BETWEEN a AND c AND lon BETWEEN b AND d")
def poi_join(c: Catalog):
    text_of = lambda a, b, x, y: f"POLYGON (({b} {a}, {y} {a}, {y} {x}, {b} {x}, {b} {a}))"
    areas = c.spark.createDataFrame([(k, text_of(a, b, x, y)) for k, a, b, x, y in [(k, a - 1e-7, b - 1e-7, x + 1e-7, y + 1e-7) for k, a, b, x, y in _BOXES]], "k int, wkt string").select("k", shape_from_text("wkt").alias("g"))
    return spatial.join_points(_located(c), "lat", "lon", areas, "k", "g").select("event_id", "k")


@query(f"SELECT event_id FROM ({_E}) WHERE {_D0} <= 500000")
def index_lookup(c: Catalog):
    rows = _located(c)
    index = cut(spatial.index_points(rows, "event_id", F.col("lat"), F.col("lon")))
    near = spatial.lookup(spatial.for_range(index, _LAT0, _LON0, 500_000.0), rows, "event_id")
    return near.where(geodesy.haversine(_here(), geodesy.point(_LAT0, _LON0)) <= 500_000).select("event_id")


@query(f"SELECT min(cell) AS min_cell, max(cell) AS max_cell FROM ({_CELLS})")
def index_extent(c: Catalog):
    return spatial.min_max_cell(spatial.index_points(_located(c), "event_id", F.col("lat"), F.col("lon")))


@query("SELECT CAST(1 AS TINYINT) AS cell_attr, count(*) AS n FROM events")
def index_attributes(c: Catalog):
    return spatial.attribute_histogram(spatial.index_points(_located(c), "event_id", F.col("lat"), F.col("lon")))


# --- sets --------------------------------------------------------------------------------------------------------


@query("SELECT min(k) AS first, max(k) AS last FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30)) GROUP BY g")
def islands(c: Catalog):
    return sets.islands(c.table("lineitem").where("l_quantity > 30"), "l_orderkey")


@query("SELECT count(DISTINCT g) AS n_runs, min(k) AS least, max(k) AS largest FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS k FROM orders))")
def run_summary(c: Catalog):
    return sets.run_summary(c.table("orders"), "o_custkey")


_STEPS = [(0.0, "a"), (50_000.0, "b"), (100_000.0, "c"), (150_000.0, "d"), (250_000.0, "e"), (400_000.0, "f")]


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'f' WHEN o_totalprice >= 250000 THEN 'e' WHEN o_totalprice >= 150000 THEN 'd' WHEN o_totalprice >= 100000 THEN 'c' WHEN o_totalprice >= 50000 THEN 'b' WHEN o_totalprice >= 0 THEN 'a' ELSE '-' END AS band FROM orders")
def interval_map_lookup(c: Catalog):
    return c.table("orders").select("o_orderkey", sets.step_value(F.col("o_totalprice"), _STEPS, "-").alias("band"))


@query("SELECT e.event_id, o.o_orderkey AS step FROM (SELECT event_id, value * 1000 AS v FROM events) e ASOF LEFT JOIN (SELECT o_totalprice AS p, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) o ON e.v >= o.p")
def step_table_lookup(c: Catalog):
    steps = c.table("orders").groupBy("o_totalprice").agg(F.min("o_orderkey").alias("step"))
    return sets.step_lookup(c.table("events").select("event_id", (F.col("value") * 1000).alias("v")), "v", steps, "o_totalprice", "step", 20_000.0).select("event_id", "step")


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 1000 + c_custkey % 40 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.v = u.a) SELECT v, min(c) AS component FROM r GROUP BY v")
def components(c: Catalog):
    return connected_components(c.table("customer").select(F.col("c_nationkey").cast("long").alias("a"), (1000 + F.col("c_custkey") % 40).alias("b")))


@query("SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def bitmap_distinct(c: Catalog):
    return sets.bitmap_distinct(c.table("lineitem"), "l_partkey")


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem GROUP BY 1")
def bitmap_distinct_by(c: Catalog):
    return sets.bitmap_distinct(c.table("lineitem"), "l_orderkey", "l_returnflag")


# --- text and dates ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(text, ' ') AS t, length(rtrim(text, ' ')) AS n FROM documents")
def text_trim(c: Catalog):
    return c.table("documents").select("doc_id", text.trim_spaces(F.col("text")).alias("t"), text.text_length(F.col("text")).cast("long").alias("n"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery' OR lower(c_name) LIKE 'customer#00000001%'")
def text_iequal(c: Catalog):
    return c.table("customer").where(text.iequal(F.col("c_mktsegment"), "Machinery") | text.iprefix(F.col("c_name"), "CUSTOMER#00000001")).select("c_custkey")


@query("SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '')[1] AS head, len(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS n FROM part")
def text_split(c: Catalog):
    parts = text.split_on(F.col("p_type"), " ")
    return c.table("part").select("p_partkey", F.get(parts, 0).alias("head"), F.size(parts).cast("long").alias("n"))


@query("SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
def text_upper(c: Catalog):
    return c.table("nation").select("n_nationkey", text.to_upper(F.col("n_name")).alias("u"), text.to_lower(F.col("n_name")).alias("l"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages")
def text_file_name(c: Catalog):
    return c.table("pages").select("page_id", text.file_name(F.col("url")).alias("f"))


@query("SELECT c_custkey, hex(encode(c_name)) AS h FROM customer")
def text_hex(c: Catalog):
    return c.table("customer").select("c_custkey", F.replace(text.hex_dump(F.col("c_name").cast("binary")), F.lit(" "), F.lit("")).alias("h"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events")
def dt_unix(c: Catalog):
    return c.table("events").select("event_id", dates.unix_time(F.col("ts")).alias("s"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS wd, weekofyear(o_orderdate) AS wk, datediff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) AS dn FROM orders")
def dt_gregorian(c: Catalog):
    d = F.col("o_orderdate")
    g = dates.gregorian(d)
    long = lambda x, n: x.cast("long").alias(n)
    return c.table("orders").select("o_orderkey", long(g["year"], "y"), long(g["month"], "m"), long(g["day"], "d"), long(dates.weekday(d), "wd"), long(dates.iso_week(d), "wk"), long(dates.day_number(d), "dn"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS t FROM events")
def dt_format(c: Catalog):
    return c.table("events").select("event_id", dates.date_text(F.col("ts")).alias("t"))


@query("SELECT event_id, (epoch_us(ts) % 86400000000) * 3 // 10000 AS ticks, ((epoch_us(ts) % 86400000000) * 3 // 10000 % 300) * 1000 // 300 AS ms FROM events")
def dt_300ticks(c: Catalog):
    t = dates.day_ticks(F.col("ts"))
    return c.table("events").select("event_id", t.alias("ticks"), dates.milliseconds(t).cast("long").alias("ms"))


@query("SELECT o_orderkey, o_orderdate AS again FROM orders")
def dt_parts_round_trip(c: Catalog):
    d = F.col("o_orderdate")
    return c.table("orders").select("o_orderkey", dates.from_parts(dates.day_number(d), dates.day_ticks(d)).alias("again"))


# --- catalog, dumps ----------------------------------------------------------------------------------------------


_KEY_ROWS = ", ".join(str((n, i, k)) for n in sorted(KEYS) for i, k in enumerate(KEYS[n]))
_KEYED = f"(VALUES {_KEY_ROWS}) k(table_name, position, column_name)"
#: Columns as the database sees its views, with the type that holds each; text of a key has a fixed width.
_COLUMNS = f"""SELECT i.table_name, CAST(i.ordinal_position - 1 AS INTEGER) AS position, i.column_name,
    CASE i.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'float' WHEN 'FLOAT' THEN 'real' WHEN 'BOOLEAN' THEN 'bit'
      WHEN 'TIMESTAMP' THEN 'datetime' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'datetimeoffset' WHEN 'DATE' THEN 'date' WHEN 'BLOB' THEN 'varbinary' WHEN 'VARCHAR' THEN CASE WHEN k.position IS NULL THEN 'nvarchar' ELSE 'nchar' END ELSE 'sql_variant' END AS sql_type
  FROM information_schema.columns i LEFT JOIN {_KEYED} USING (table_name, column_name) WHERE i.table_name IN (SELECT table_name FROM {_KEYED})"""
_FIXED = "sql_type NOT IN ('nvarchar', 'varbinary', 'sql_variant')"


@query(f"SELECT CAST(row_number() OVER (ORDER BY table_name) AS INTEGER) AS table_id, table_name, CAST(count(*) AS INTEGER) AS n_columns, CAST(count(*) FILTER ({_FIXED}) AS INTEGER) AS n_fixed, CAST((SELECT count(*) FROM {_KEYED} WHERE k.table_name = c.table_name) AS INTEGER) AS n_key_parts FROM ({_COLUMNS}) c GROUP BY table_name")
def catalog_tables(c: Catalog):
    return c.tables()


@query(f"SELECT table_name, position, column_name, sql_type, {_FIXED} AS fixed, true AS nullable FROM ({_COLUMNS})")
def catalog_columns(c: Catalog):
    return c.columns()


@query(f"SELECT DISTINCT table_name, 1 AS kind, 'CLUSTERED' AS kind_name FROM {_KEYED}")
def catalog_indexes(c: Catalog):
    return c.indexes()


@query(f"SELECT table_name, position, column_name, true AS ascending FROM {_KEYED}")
def catalog_index_columns(c: Catalog):
    return c.index_columns()


@query("SELECT count(*) AS n FROM lineitem")
def record_count(c: Catalog):
    return c.table("lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) - count(s_suppkey) AS s_suppkey, count(*) - count(s_nationkey) AS s_nationkey, count(*) - count(bal) AS bal FROM (" + _HOLED + ")")
def column_nulls(c: Catalog):
    return null_counts(_holed(c).source)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) || ',' || n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def dump_lines(c: Catalog):
    return dump(c.table("nation"), order=["n_nationkey"])


@query()
def table_checksum(c: Catalog):
    return c.checksum("orders")


# --- extensions, not part of the parity surface --------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def ext_join_group(c: Catalog):
    rows = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def ext_anti_join(c: Catalog):
    return c.table("customer").join(c.table("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def ext_window_rank(c: Catalog):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return c.table("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(c: Catalog):
    return c.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query("SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def ext_intersect(c: Catalog):
    return c.table("orders").select(F.col("o_custkey").alias("k")).intersect(c.table("customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def ext_window_counts(c: Catalog):
    return windowed(c.table("events")).withColumn("total", F.round("total", 3))


@query(
    """WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g"""
)
def ext_sessions(c: Catalog):
    return sessions(c.table("events"))
