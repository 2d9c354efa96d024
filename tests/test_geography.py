import math
import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import cells, geodesy as G, shapes, wkt
from terrane.operators import spatial
from terrane.operators.cover import cover_box, cover_circle

R = 6_371_000.0


@pytest.fixture(scope="module")
def value(spark):
    return lambda *columns: spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


CELLS = [((48.7139, 44.4984), "156-163-67-177-4"), ((55.7975, 49.2194), "157-178-149-55-4"), ((47.2629, 39.7111), "163-78-72-221-4"), ((47.261, 39.7068), "163-78-72-223-4"), ((55.7831, 37.3567), "156-38-25-118-4"), ((0, -86), "128-234-255-15-4")]


def test_cells(spark):
    df = spark.createDataFrame([(float(p[0]), float(p[1])) for p, _ in CELLS], "lat double, lon double")
    got = [r[0] for r in df.select(cells.cell_text(cells.make_cell(F.col("lat"), F.col("lon")))).collect()]
    assert got == [t for _, t in CELLS]
    assert sorted(cells.PLACES.reshape(-1)) == list(range(256))
    assert cells.parse_cell("9ca343b104") == (0x9CA343B1, 4)
    assert cells.cells_meet((0x9CA343B1, 4), (0x9C000000, 1)) and not cells.cells_meet((0x9CA343B1, 4), (0x9D000000, 1))
    assert cells.id_range(0x9C123456, 2) == (0x9C120000, 0x9C12FFFF)


def test_inverse_projection(spark):
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lat, lon)], "lat double, lon double")
    u, v = (np.array(x) for x in zip(*[(r.s.u, r.s.v) for r in df.select(cells.unit_square(F.col("lat"), F.col("lon")).alias("s")).collect()]))
    a, b = cells.globe_point(u, v)
    assert np.allclose(a, lat, atol=1e-7) and np.allclose(b, lon, atol=1e-7)


def test_geodesy(value):
    p = lambda a, b: G.point(a, b)
    o = p(0, 0)
    for turn, to in ((0, (45, 0)), (90, (0, 45)), (180, (-45, 0)), (270, (0, -45))):
        d = value(G.destination(o, R * math.pi / 4, turn))[0]
        assert close(d.lat, to[0]) and close(d.lon, to[1])
    d = value(G.destination(o, R * math.pi / 2, 0))[0]
    assert close(d.lat, 90) and close(d.lon, 0)
    got = value(G.course(o, p(0, 90)), G.course(o, p(0, 1)), G.course(o, p(0, -1)), G.course(o, p(1, 1)), G.course(p(90, 0), o), G.course(p(-90, 0), o), G.course(o, o))
    assert all(close(a, b) for a, b in zip(got, (90, 90, 270, 44.9956364553448, 180, 0, 0)))
    got = value(G.angle(o, p(0, 90), o), G.angle(p(0, 1), o, p(1, 0)), G.angle(p(1, 1), o, p(1, 0)))
    assert all(close(a, b) for a, b in zip(got, (180, 90, 45.004363544655149)))
    got = value(G.haversine(p(-90, 0), p(90, 0)), G.haversine(o, p(0, 180)), G.haversine(o, p(90, 0)))
    assert close(got[0], R * math.pi) and close(got[1], R * math.pi) and got[2] == pytest.approx(R * math.pi / 2, abs=1e-6)
    n = value(*[G.norm_longitude(F.lit(float(x))) for x in (-270, 270, 630)], *[G.norm_latitude(F.lit(float(x))) for x in (100, 460, -100)])
    assert tuple(n) == (90, -90, -90, 80, 80, -80)
    c = value(G.cross_track(p(55.765116, 37.534117), p(55.765061, 37.534054), p(55.76505270062228, 37.53414184234521)))[0]
    assert close(c.distance, 5.1190082853006986) and close(c.point.lat, 55.765077633388081) and close(c.point.lon, 37.534073052767347)
    got = value(G.match(p(90, 10), p(90, 50)), G.match(p(5, 180), p(5, -180)), G.equal(p(5, 180), p(5, -180)), G.planar_closest(p(0, 0), p(0, 2), p(1, 1)))
    assert got[0] and got[1] and not got[2] and (got[3].lat, got[3].lon) == (0, 1)


def test_shapes(value):
    line = shapes.shape("LineString", [[(55.765975, 37.534652), (55.765516, 37.53442)]])
    n = value(shapes.closest_point(line, G.point(55.765537, 37.534578)))[0]
    assert close(n.point.lat, 55.765558813184811) and close(n.point.lon, 37.534441639539345) and n.offset == 0
    ring = lambda r: F.array(*[G.point(b, a) for a, b in r])  # noqa: E731  (x, y)
    w = value(shapes.winding(ring([(10, 30), (40, 40), (40, 20), (20, 10), (10, 30)])), shapes.winding(ring([(30, 20), (35, 35), (20, 30), (30, 20)])))
    assert tuple(w) in {(-1, 1), (1, -1)}
    x = value(shapes.line_intersection(G.point(0, -1), G.point(0, 1), G.point(-1, 0), G.point(1, 0)))[0]
    assert (x.lat, x.lon) == (0, 0)
    outer, hole = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
    g = shapes.shape("Polygon", [outer, hole], [0, 1])
    got = value(shapes.contains(g, G.point(1, 1)), shapes.contains(g, G.point(5, 5)), shapes.contains(g, G.point(0, 0)), shapes.contains(g, G.point(11, 1)), shapes.geometry_type(g), shapes.object_count(g), shapes.point_count(g))
    assert tuple(got) == (True, False, True, False, "Polygon", 2, 10)
    assert value(shapes.as_text(g))[0] == "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    assert value(shapes.as_text(shapes.shape("LineString", [[(1.5, 2.25), (3, 4)]])), shapes.part_as_text(shapes.shape("LineString", [[(0, 0), (0, 1), (0, 1), (0, 2)]]), 0, 4, True))[1] == "LINESTRING (0 0, 1 0, 2 0)"
    p = value(shapes.point_from_text(F.lit("POINT (37.5 55.25)")))[0]
    assert (p.lat, p.lon) == (55.25, 37.5)


def test_q6_collinear_and_open_lines(value):
    """Separate edges on one line don't meet; a line is not closed."""
    g = shapes.shape("LineString", [[(0, 0), (0, 1)]])
    u = shapes.shape("LineString", [[(0, 0), (10, 0), (10, 10), (0, 10)]])
    assert tuple(value(shapes.intersects_box(g, 0.0, 5.0, 0.0, 6.0), shapes.intersects_box(u, -1.0, 4.0, 1.0, 6.0), shapes.intersects_box(u, 9.0, 4.0, 11.0, 6.0))) == (False, False, True)


def test_q11_holes(value):
    g = shapes.shape("Polygon", [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]], [0, 1])
    got = value(shapes.distance(g, G.point(5, 5)), shapes.intersects_box(g, 4.5, 4.5, 5.5, 5.5), shapes.distance(g, G.point(1, 1)))
    assert got[0] > 100_000 and not got[1] and got[2] == 0


def test_q5_null_geography(spark):
    df = spark.createDataFrame([(1, None)], f"k int, g {shapes.SHAPE}")
    assert spatial.select_distance(df, "g", 0, 0, 10.0).count() == 0


def test_wkt(spark):
    kind, rings, roles = wkt.parse("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2), (4 4, 6 4, 6 6, 4 6, 4 4))")
    assert roles == [0, 1, 0] and kind == "Polygon"
    assert wkt.parse("nonsense") is None and wkt.parse(None) is None
    df = spark.createDataFrame([("POINT (1 2)",), (None,), ("LINESTRING (0 0, 1 1)",)], "t string")
    got = df.select(wkt.shape_from_text("t").alias("g")).collect()
    assert got[0].g.kind == "Point" and got[0].g.rings[0][0].lat == 2 and got[2].g.kind == "LineString"


@pytest.mark.parametrize("seed", range(4))
def test_covers_hold_their_regions(spark, seed):
    """q12: no boundary is lost, at poles and edges too."""
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 3000), rng.uniform(-180, 180, 3000))] + [(89.9, float(x)) for x in range(-180, 180, 30)] + [(-89.9, float(x)) for x in range(-180, 180, 30)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", cells.make_cell(F.col("lat"), F.col("lon"))).toPandas()
    inside = lambda ranges: np.any([(df.cell >= lo) & (df.cell <= hi) for lo, hi in ranges] or [np.zeros(len(df), bool)], axis=0)
    for _ in range(6):
        a, b = rng.uniform(-90, 90), rng.uniform(-180, 180)
        r = float(rng.choice([1e4, 3e5, 2e6, 9e6]))
        h = np.sin(np.radians(df.lat - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(df.lat)) * np.sin(np.radians(df.lon - b) / 2) ** 2
        near = 2 * R * np.arcsin(np.sqrt(np.minimum(1, h))) <= r
        assert not (near & ~inside(cover_circle(a, b, r))).any()
        lat, lon = np.sort(rng.uniform(-90, 90, 2)), np.sort(rng.uniform(-180, 180, 2))
        box = df.lat.between(*lat) & df.lon.between(*lon)
        assert not (box & ~inside(cover_box(lat[0], lon[0], lat[1], lon[1]))).any()
    assert cover_box(0, 0, 0, 5) == [] and cover_circle(90, 0, 1000.0)


def test_shape_covers_hold_and_cover_only_what_is_inside(spark):
    """Points of shapes are in cells of the cover; points of covered cells are in the shape."""
    rng = np.random.default_rng(7)
    star = [(float(30 + (25 if i % 2 else 8) * math.sin(i * math.pi / 7)), float(40 + (35 if i % 2 else 12) * math.cos(i * math.pi / 7))) for i in range(14)]
    box = lambda a, b, c, d: [(a, b), (a, d), (c, d), (c, b), (a, b)]
    texts = ["MULTIPOLYGON (((-179 60, -120 60, -120 89, -179 89, -179 60)), ((100 -89, 179 -89, 179 -40, 100 -40, 100 -89)))", "POINT (3 4)", "LINESTRING (-170 -80, 170 80)", None]
    areas = [("Polygon", [star + star[:1], box(27.0, 35.0, 33.0, 45.0)], [0, 1]), ("Polygon", [box(-1.0, -1.0, 1.0, 1.0)], [0]), ("Polygon", [box(-90.0, -180.0, 90.0, 180.0)], [0]), ("Polygon", [star], [0])]
    parsed = [wkt.parse(t) for t in texts] + areas
    df = spark.createDataFrame([(i, *([None] * 1 if x is None else [(x[0], [[tuple(map(float, p)) for p in r] for r in x[1]], list(x[2]))])) for i, x in enumerate(parsed)], f"k int, g {shapes.SHAPE}")
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(np.r_[rng.uniform(-90, 90, 4000), rng.uniform(-2, 2, 200), rng.uniform(-90, 90, 50)], np.r_[rng.uniform(-180, 180, 4000), rng.uniform(-2, 2, 200), np.repeat([180.0, -180.0], 25)])] + [(4.0, 3.0)], "lat double, lon double").withColumn("cell", cells.make_cell(F.col("lat"), F.col("lon")))
    pairs = points.join(spatial.index_shapes(df, "k", "g"), F.col("cell").between(F.col("lo"), F.col("hi"))).select(F.col("pk0").alias("k"), "lat", "lon", "cell_attr").toPandas()
    truth = points.join(F.broadcast(df)).where(shapes.contains(F.col("g"), F.struct("lat", "lon"))).select("k", "lat", "lon").toPandas()
    place = lambda f: set(zip(f.k, f.lat, f.lon))
    assert place(truth) <= place(pairs) and place(pairs[pairs.cell_attr == spatial.COVER]) <= place(truth)
    assert len(pairs) == len(pairs.drop_duplicates(["k", "lat", "lon"])) and set(pairs[pairs.cell_attr == spatial.COVER].k) >= {0, 4}
    assert place(spatial.join_points(points.drop("cell"), "lat", "lon", df, "k", "g").toPandas()) == place(truth)
    for b in [(10.0, 10.0, 20.0, 20.0), (28.0, 36.0, 29.0, 37.0), (-85.0, 120.0, -80.0, 125.0), (3.9, 2.9, 4.1, 3.1), (-0.1, -90.0, 0.1, 0.1)]:
        seen = lambda f: {r.k for r in f.select("k").collect()}
        assert seen(spatial.seek_shapes(spatial.index_shapes(df, "k", "g"), df, "k", "g", b)) == seen(spatial.select_intersects(df, "g", b)) != set()


def _random_shapes(spark, n):
    """Squares with a hole and a far square, stars, lines, points, open rings, shapes over poles and edges, and nothing."""
    rng, rows = np.random.default_rng(11), []
    for i in range(n):
        a, b, r = float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180)), float(rng.choice([0.5, 3, 20]))
        square = lambda r, dx: [(a + y * r, b + dx + x * r) for y, x in ((-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))]  # noqa: B023, E731
        star = [(a + r * k % 3 / 3 * math.sin(k), b + r * math.cos(k)) for k in range(6)]
        rows.append((i, [("MultiPolygon", [square(r, 0), square(r / 2, 0), [], square(r, 3 * r)], [0, 1, 1, 0]), ("Polygon", [star + star[:1]], [0]), ("Polygon", [star], [0]), ("LineString", [star], [0]), ("Point", [[(a, b)]], [0]), ("Polygon", [], []), (None, None, None), None][i % 8]))
    return spark.createDataFrame(rows, f"k int, g {shapes.SHAPE}").coalesce(1)


def _indexed(spark, df, key, batch):
    """The index's rows and the seconds that it took, with so many shapes in a batch."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(size)
    try:
        spark.conf.set(size, str(batch))
        start = time.perf_counter()
        return [tuple(r) for r in spatial.index_shapes(df, key, "g").collect()], time.perf_counter() - start
    finally:
        spark.conf.set(size, held)


def test_shapes_of_a_batch_have_the_cells_that_each_has_alone(spark):
    df = _random_shapes(spark, 64)
    together, alone = (_indexed(spark, df, "k", n)[0] for n in (64, 1))
    assert sorted(together) == sorted(alone) and len(set(alone)) == len(alone) and {k for k, *_ in alone} == {k for k in range(64) if k % 8 < 5}
    assert spatial.index_shapes(df.where("k % 8 > 4"), "k", "g").collect() == []


def test_shapes_go_down_together_and_only_found_ones_are_tested(spark):
    """A batch of 3,000 shapes took almost as long as 3,000 batches of one: numpy calls for each shape."""
    from terrane.queries import _squares

    place = F.col("id") * 7919
    df = _squares(spark.range(0, 3000, 1, 1).select("id", (place % 15000 / 100 - 75).alias("lat"), (place * 13 % 30000 / 100 - 150).alias("lon")), "id").select("id", "g")
    (_, first), (alone, one_by_one), (together, at_once) = (_indexed(spark, df, "id", n) for n in (3000, 1, 3000))
    assert sorted(together) == sorted(alone) and min(first, at_once) * 3 < one_by_one
    index = spatial.index_shapes(df, "id", "g").localCheckpoint()
    box = (10.003, 20.003, 20.003, 40.003)
    found = spatial.seek_shapes(index, df, "id", "g", box)
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "flatten" in x]
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in spatial.select_intersects(df, "g", box).select("id").collect()) != []


def test_stored_cells_change_no_result(spark):
    from terrane.plans.predicates import IGNORE, USE, STContains, STDistance, STIntersects
    from terrane.plans.query import Select
    from terrane.schema import ColumnDef, KeyPart, TableDef

    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.r_[rng.uniform(-90, 90, 2000), 90, -90, 5, 5], np.r_[rng.uniform(-180, 180, 2000), 0, 7, 180, -180]))]
    df = spark.createDataFrame(rows, "k long, lat double, lon double").withColumn("g", shapes.point_shape(F.col("lat"), F.col("lon"))).withColumn("cell", cells.make_cell(F.col("lat"), F.col("lon")))
    table = TableDef("t", (ColumnDef("k", "bigint"), ColumnDef("g", "geography"), ColumnDef("cell", "bigint")), (KeyPart("k"),), "g", "cell")
    asks = [lambda h: STIntersects("g", 10.0, 170.0, 40.0, 180.0, hint=h), lambda h: STIntersects("g", 5.0, 180.0, 5.0, 180.0, hint=h), lambda h: STContains("g", 5.0, -180.0, hint=h), lambda h: STContains("g", 90.0, 0.0, hint=h)]
    asks += [lambda h, c=c: STDistance("g", c, 80.0, 179.0, 1.5e6, hint=h) for c in ("less", "less_eq", "greater", "greater_eq")] + [lambda h: STDistance("g", "less", 0.0, 0.0, 9e6, hint=h, null_as_default=True)]
    for ask in asks:
        found = [{r.k for r in Select(table, df).or_(ask(h)).project("k").df().collect()} for h in (USE, IGNORE)]
        assert found[0] == found[1] != set()


def test_as_text_of_all_events(spark):
    from terrane.queries import QUERIES

    def printed(hundredths):
        whole, rest = divmod(abs(hundredths), 100)
        return ("-" if hundredths < 0 else "") + f"{whole}.{rest:02}".rstrip("0").rstrip(".")

    sf = "/root/testdata/sf0.01"
    ids = [r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()]
    expected = {k: f"POINT ({printed(k * 104729 % 36000 - 18000)} {printed(k * 7919 % 17001 - 8500)})" for k in ids}
    got = {r.event_id: r.wkt for r in QUERIES["geo_as_text"](spark, sf).collect()}
    assert got == expected and len(got) == len(ids) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_cells_on_edges_are_those_of_sql(spark, tmp_path):
    """At longitudes that are multiples of 45 degrees points lie on edges of cells, where the last bit decides."""
    from terrane.queries import ORACLE, QUERIES

    spark.range(0, 6_000_000, 4500).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["cell_id"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        expected = set(db.execute(ORACLE["cell_id"]).fetchall())
    assert got == expected and len(got) == 1334


def _wkb(order, kind, body):
    return struct.pack(order + "BI", order == "<", kind) + body


def _line(order, points):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_is_as_text(spark, order):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    far = [(20, 20), (30, 20), (30, 30), (20, 20)]
    polygon = _wkb(order, 3, struct.pack(order + "I", 2) + _line(order, outer) + _line(order, hole))
    other = _wkb(">", 3, struct.pack(">I", 1) + _line(">", far))
    string = _wkb(order, 2, _line(order, [(1, 2), (3, 4)]))
    rows = {
        "POINT (1.5 -2)": _wkb(order, 1, struct.pack(order + "2d", 1.5, -2)), "LINESTRING (1 2, 3 4)": string,
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))": polygon,
        "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 20, 30 20, 30 30, 20 20)))": _wkb(order, 6, struct.pack(order + "I", 2) + polygon + other),
        "MULTILINESTRING ((1 2, 3 4), (1 2, 3 4))": _wkb(order, 5, struct.pack(order + "I", 2) + string + string),
    }
    for text, data in rows.items():
        assert wkt.parse_binary(data) == wkt.parse(text)
    bad = [None, b"", string[:-1], string + b"x", _wkb(order, 4, struct.pack(order + "I", 0)), _wkb(order, 7, b""), _wkb(order, 2, _line(order, [])), _wkb(order, 6, struct.pack(order + "I", 1) + string), _wkb(order, 2, struct.pack(order + "I", 1 << 31))]
    assert [wkt.parse_binary(x) for x in bad] == [None] * len(bad)
    df = spark.createDataFrame([(t, d) for t, d in rows.items()] + [(None, b"?")], "t string, d binary")
    got = df.select("t", wkt.shape_from_binary("d").alias("g")).select("t", shapes.as_text(F.col("g")).alias("out"), F.col("g.kind").alias("kind")).collect()
    assert all(r.out == r.t for r in got if r.t) and [r.kind for r in got if r.t is None] == [None]


def test_boxes_and_extremes(value):
    box = F.struct(*[F.lit(float(x)).alias(k) for k, x in (("min_lat", -95), ("min_lon", -190), ("max_lat", 45), ("max_lon", 190))])
    assert tuple(value(shapes.normalize_box(box))[0]) == (-85, 170, 45, -170)
    ring = F.array(*[G.point(a, b) for a, b in [(1, 5), (0, 5), (0, 2), (3, 2), (3, 4)]])
    got = value(shapes.extremes(ring, "lat"), shapes.extremes(ring, "lon"), shapes.extremes(F.slice(ring, 1, 1), "lat"), shapes.extremes(F.slice(ring, 1, 0), "lat"))
    assert [x and tuple(x) for x in got] == [(1, 3), (2, 0), (0, 0), None]


def test_attribute_histogram(spark):
    area = spark.range(1).select("id", shapes.shape("Polygon", [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]], [0]).alias("g"))
    index = spatial.index_shapes(area, "id", "g")
    got = {r.cell_attr: r.n for r in spatial.attribute_histogram(index).collect()}
    assert set(got) == {spatial.PART, spatial.COVER} and sum(got.values()) == index.count()
