import pytest
from pyspark.sql import functions as F

from terrane.functions import dates, text
from terrane.operators import keys, sets
from terrane.operators.components import connected_components
from terrane.plans.predicates import All, Between, Greater, If, In, IsNull, Less, Not, NotNull, Where
from terrane.plans.query import Select, find, scan_if
from terrane.schema import ColumnDef, KeyPart, TableDef
from terrane.sources.catalog import Catalog, null_counts
from terrane.sources.dump import dump, export_all, export_script, generate_definition, load_definition
from terrane.sources.text_files import read_points, read_schema_list

T = TableDef("t", (ColumnDef("Id", "int", 4), ColumnDef("Id2", "bigint", 8), ColumnDef("Col1", "char", 6), ColumnDef("x", "float")), (KeyPart("Id"), KeyPart("Id2", False)))


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 2, "b", 0.5), (1, 1, "a", None), (2, 1, "c   ", 0.5 + 1e-13), (3, 5, None, -1.0), (None, 7, "d", 2.0)]
    return spark.createDataFrame(rows, "Id int, Id2 long, Col1 string, x double").cache()


def ids(q):
    return sorted((r.Id2 for r in (q.df() if isinstance(q, Select) else q).collect()))


def test_grammar(df):
    q = Select(T, df)
    assert ids(q.or_(Where("Id", 1)).or_(Less("Id2", 2)).and_(Not("Id2", 2))) == [1, 1]
    assert ids((q | Where("Id", 1) | Where("Id", 2)) & Greater("Id2", 1)) == [2]
    assert ids(q.or_(In("Id", 1, 3))) == [1, 2, 5]
    assert ids(q.or_(If(lambda c: c("Id") + c("Id2") == 3))) == [1, 2]
    for bad in (lambda: q.df(), lambda: q.or_(Where("nope", 1)), lambda: q.order_by("Id").order_by("Id"), lambda: q.top(1).top(2), lambda: q.or_(All()).top(1).for_record(print), lambda: q.or_(Where("Id2", 1, hint="USE")), lambda: q.or_(Not("Id", 1, hint="USE"))):
        with pytest.raises(ValueError):
            bad()


def test_order_is_stable_and_by_key(df):
    q = Select(T, df.where("Id IS NOT NULL")).or_(All())
    assert [(r.Id, r.Id2) for r in q.top(3).df().collect()] == [(1, 2), (1, 1), (2, 1)]
    assert [r.Id2 for r in q.order_by("Id2", False).top(2).df().collect()] == [5, 2]
    assert q.top(0).df().count() == 0 and q.top(2).count() == 2 and q.count() == 4


def test_q1_two_key_predicates_are_a_conjunction(df):
    assert ids(Select(T, df).or_(All()).and_(Greater("Id2", 1)).and_(Less("Id2", 7))) == [2, 5]


def test_floats_and_text(df):
    assert ids(Select(T, df).or_(Where("x", 0.5))) == [1, 2]
    assert ids(Select(T, df).or_(Where("Col1", "c"))) == [1]
    assert ids(Select(T, df).or_(Between("x", 3.0, 1.0))) == []


def test_null_modes(df):
    assert ids(Select(T, df).or_(IsNull("Id"))) == [7] and ids(Select(T, df).or_(NotNull("x"))) == [1, 2, 5, 7]
    q = Select(T, df, "default_value")
    assert ids(q.or_(Where("Id", 0))) == [7]
    assert ids(q.or_(Not("x", 5.0))) == [1, 1, 2, 5, 7]
    assert ids(q.or_(Less("x", 0.25))) == [1, 5] and ids(q.or_(Greater("x", 0.25))) == [1, 2, 7]
    assert [r.Id2 for r in q.or_(All()).order_by("x").df().collect()][:2] == [5, 1]


def test_pushdown(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    plan = c.select("orders").or_(Between("o_orderkey", 1, 5)).order_by("o_totalprice").top(3).project("o_orderkey", "o_totalprice").df()._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(o_orderkey,1)" in plan


def test_callbacks(df):
    seen = []
    Select(T, df).or_(All()).for_record(lambda r: seen.append(r) or len(seen) < 2)
    assert len(seen) == 2
    seen.clear()
    scan_if(df, lambda r: seen.append(r) or False)
    assert len(seen) == 1 and find(df, F.col("Id") == 3).Id2 == 5 and find(df, F.col("Id") == 99) is None


def test_keys(df):
    assert keys.find_with_key(T, df, 1, 2).count() == 1
    low = keys.lower_bound(T, df, 2).first()
    assert (low.Id, low.is_equal) == (2, True)
    assert [(r.Id, r.Id2) for r in keys.walk(T, df.where("Id IS NOT NULL"), 1, 1).collect()] == [(1, 1), (2, 1), (3, 5)]
    assert [(r.Id, r.Id2) for r in keys.walk(T, df.where("Id IS NOT NULL"), 2, 1, forward=False).collect()] == [(2, 1), (1, 1), (1, 2)]
    with pytest.raises(ValueError):
        keys.find_with_key(T, df, 1)


def test_sets(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    runs = lambda d: sorted((r.first_, r.last_) for r in sets.islands(d, "k").selectExpr("first first_", "last last_").collect())
    assert runs(k(4, 5, 10, 10)) == [(4, 5), (10, 10)]
    b = sets.BLOCK
    assert runs(k(b - 2, b - 1, b, b + 1, -1, 0)) == [(-1, 0), (b - 2, b + 1)]
    assert runs(spark.range(b - 3, 3 * b + 2).withColumnRenamed("id", "k")) == [(b - 3, 3 * b + 1)]
    assert runs(k()) == []
    assert sets.bitmap_distinct(k(-5, 3, 3, 1 << 40), "k").first()[0] == 3
    edges = spark.createDataFrame([(4, 3), (3, 8), (6, 5), (9, 4), (2, 1), (8, 9), (5, 0), (7, 2), (6, 1), (1, 0), (6, 7)], "a long, b long")
    assert sorted({r.component for r in connected_components(edges).collect()}) == [0, 3]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    steps = sets.assign_steps(sets.assign_steps([], -1, 0, 10, 5), -1, 3, 5, -1)
    assert steps == [(0, 5), (3, -1), (5, 5), (10, -1)]
    got = spark.createDataFrame([(1.0,), (4.0,), (None,), (-3.0,)], "x double").select(sets.step_value(F.col("x"), steps, -1)).collect()
    assert [r[0] for r in got] == [5, -1, None, -1]


def test_text(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()
    lit = F.lit
    got = one(text.is_blank(lit("")), text.is_blank(lit(" ")), text.is_blank(lit(" 1 ")), text.cyrillic_upper(lit("ёж")), text.cyrillic_lower(lit("ЁЖ"), True), text.decode_cp1251(F.unhex(lit("CFF0E8E2E5F2"))))
    assert tuple(got) == (True, True, False, "ЁЖ", "еж", "Привет")
    g = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    assert one(text.guid_text(text.guid_bytes(lit(g))))[0] == g
    got = one(text.file_name(lit("/a/b.txt")), text.without_extension(lit("/a.d/b.txt")), text.replace_double(lit("a--b"), "-"), text.is_listed(lit("X"), "a, x"), text.decode_utf16(F.unhex(lit("41004200"))))
    assert tuple(got) == ("b.txt", "/a.d/b", "a-b", True, "AB")


def test_dates(spark):
    got = spark.range(1).select(dates.date_text(dates.from_parts(F.lit(42003), F.lit(300))).alias("a"), dates.date_text(dates.from_parts(F.lit(0), F.lit(0))).alias("q10"), dates.milliseconds(F.lit(299)).alias("m")).first()
    assert tuple(got) == ("2015-01-01 00:00:01.000", "1900-01-01 00:00:00.000", 996)


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,POINT (37.5 55.5)\n2,POINT (1 2)\n\n3,POINT (3 4)\n")
    assert [(r.id, r.lat, r.lon) for r in read_points(spark, f"file://{tmp_path}/p.csv").orderBy("id").collect()] == [(1, 55.5, 37.5), (2, 2.0, 1.0)]
    (tmp_path / "s.csv").write_text("TABLE_NAME,COLUMN_NAME,ORDINAL_POSITION,SCHEMA_NAME\nA,x,1,dbo\na,x,1,dbo\n")
    with pytest.raises(ValueError):
        read_schema_list(spark, f"file://{tmp_path}/s.csv")


def test_dump_and_definitions(df, spark):
    lines = [r.line for r in dump(df.where("Id2 = 1"), ["Id", "Col1", "x"], trim=True, order=["Id"]).collect()]
    assert lines == ["1,1,a,[NULL]", "2,2,c,0.5000000000001"]
    assert load_definition(generate_definition(T), "t") == T
    assert "ORDER BY [Id] ASC, [Id2] DESC" in export_script(T, "a.dbo", "b.dbo") and "[PK 1 DESC]" in T.describe()
    assert null_counts(df).first().asDict() == {"Id": 1, "Id2": 0, "Col1": 1, "x": 1}
    with pytest.raises(ValueError):
        TableDef("u", (ColumnDef("a", "varchar"),), (KeyPart("a"),))


def test_checksum_of_arrays_and_nulls(spark, tmp_path):
    def checksum(name, rows, ddl="id long, v array<float>, s string"):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return Catalog(spark, str(tmp_path), [name]).checksum(name).first()[1]

    base = checksum("a", [(1, [1.0, 2.0], "x"), (2, None, None)])
    assert base == checksum("b", [(2, None, None), (1, [1.0, 2.0], "x")])
    others = [[(1, [1.0, 3.0], "x"), (2, None, None)], [(1, [2.0, 1.0], "x"), (2, None, None)], [(1, [1.0, 2.0], "x"), (2, [], None)], [(1, [1.0, 2.0], "x"), (2, None, "")]]
    assert len({base, *(checksum(f"c{i}", rows) for i, rows in enumerate(others))}) == 5
    assert checksum("d", [(1, [1.0, None], "x")]) != checksum("e", [(1, [1.0], "x")])


def test_checksums_of_files(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    catalog = Catalog(spark, str(tmp_path), ["a"])
    for first in (0, 10, 20):
        spark.range(first, first + 5).coalesce(1).write.mode("append").parquet(path)
    stored = spark.createDataFrame(catalog.file_checksums("a").collect())
    assert stored.count() == 3 and sum(r.n_rows for r in stored.collect()) == 15
    found = []
    assert catalog.scan_checksum("a", stored, found.append) and not found
    changed = stored.withColumn("checksum", F.col("checksum") + F.when(F.col("file_path") == stored.first().file_path, 1).otherwise(0))
    assert catalog.scan_checksum("a", changed, found.append) and [r.file_path for r in found] == [stored.first().file_path]
    assert not catalog.scan_checksum("a", changed) and not catalog.scan_checksum("a", stored.limit(1))
    spark.range(7).coalesce(1).write.mode("append").parquet(path)
    found.clear()
    assert catalog.scan_checksum("a", stored, found.append) and [(r.n_rows, r.now_rows) for r in found] == [(None, 7)]


def test_export_of_a_schema_list():
    rows = [("t", "g", 2, "dbo"), ("t", "ST_AREA", 3, "dbo"), ("t", "id", 1, "dbo"), ("u", "ST_AREA", 1, "app")]
    script = export_all(rows, "a", "b", "g")
    assert "SELECT id, g, g.STArea() AS ST_AREA FROM [a].[dbo].[t];" in script and "SELECT ST_AREA FROM [a].[app].[u];" in script
    assert script.count("STIsValid") == 1 and script.index("STIsValid") < script.index("SPATIAL_DBO_T") < script.index("[app].[u]") < script.index("INTO [b].[dbo].[t]")
    assert "STIsValid" not in export_all(rows, "a", "b") and "INDEX" not in export_all(rows, "a", "b", "g", spatial=False) and export_all([], "a", "b") == ""
