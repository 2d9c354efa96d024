"""A folder of Parquet tables as a catalog, with metadata as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terrane.plans.query import Select
from terrane.schema import INDEX_KINDS, OBJECT_KINDS, SQL_TYPES, TableDef

#: Keys of the tables that are known here: name and whether ascending.
KEYS: dict[str, tuple] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}


class Catalog:
    """Tables by name: <folder>/<name>.parquet. Nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str] | None = None, keys: dict[str, tuple] | None = None, geography: dict[str, str] | None = None):
        self.spark, self.folder, self.keys, self.geography = spark, folder, keys or KEYS, geography or {}
        self.names = names or list(self.keys)
        self._defs: dict[str, TableDef] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table_by_id(self, number: int) -> DataFrame:
        """Tables are numbered from 1 in the order of their names."""
        return self.table(sorted(self.names)[number - 1])

    def definition(self, name: str) -> TableDef:
        if name not in self._defs:
            self._defs[name] = TableDef.of(name, self.table(name), self.keys.get(name, ()), self.geography.get(name))
        return self._defs[name]

    def select(self, name: str, null_mode: str = "sql") -> Select:
        return Select(self.definition(name), self.table(name), null_mode)

    def record_count(self, name: str) -> int:
        """From the files' footers."""
        return self.table(name).count()

    # --- metadata ----------------------------------------------------------------------------------------------

    def tables(self) -> DataFrame:
        rows = [(i, n, len(d.columns), d.fixed_count, len(d.key)) for i, n in enumerate(sorted(self.names), 1) for d in [self.definition(n)]]
        return self.spark.createDataFrame(rows, "table_id int, table_name string, n_columns int, n_fixed int, n_key_parts int")

    def columns(self) -> DataFrame:
        rows = [(n, i, c.name, c.sql_type, c.fixed, c.nullable) for n in sorted(self.names) for i, c in enumerate(self.definition(n).columns)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, sql_type string, fixed boolean, nullable boolean")

    def indexes(self) -> DataFrame:
        rows = []
        for n in sorted(self.names):
            d = self.definition(n)
            rows.append((n, 1 if d.key else 0, INDEX_KINDS[1 if d.key else 0]))
            if d.geography:
                rows.append((n, 4, INDEX_KINDS[4]))
        return self.spark.createDataFrame(rows, "table_name string, kind int, kind_name string")

    def index_columns(self) -> DataFrame:
        rows = [(n, i, p.column, p.ascending) for n in sorted(self.names) for i, p in enumerate(self.definition(n).key)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, ascending boolean")

    def types(self) -> DataFrame:
        return self.spark.createDataFrame([(k, s, f) for k, (s, f) in SQL_TYPES.items()], "sql_type string, spark_type string, fixed boolean")

    def object_kinds(self) -> DataFrame:
        return self.spark.createDataFrame(list(OBJECT_KINDS.items()), "code string, kind string")

    def info(self) -> DataFrame:
        """One row about the whole."""
        return self.spark.createDataFrame([(self.folder.rstrip("/").rsplit("/", 1)[-1], self.spark.version, len(self.names))], "name string, version string, n_tables int")

    def files(self, name: str) -> DataFrame:
        """Files of a table with their rows: where rows are stored."""
        return self.table(name).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n_rows"))

    def row_at(self, name: str, file_path: str, row_index: int) -> DataFrame:
        """The row at a place of a file; for diagnosis."""
        return self.table(name).where((F.col("_metadata.file_path") == file_path) & (F.col("_metadata.row_index") == row_index))

    def _sums(self, name: str) -> tuple[DataFrame, list[Column]]:
        df = self.table(name)
        nested = lambda kind: kind.startswith(("array", "map", "struct"))
        texts = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) if nested(kind) else F.col(c).cast("string") for c, kind in df.dtypes]
        h = F.crc32(F.concat_ws("|", *[F.coalesce(x, F.lit("\0")) for x in texts]).cast("binary"))
        return df, [F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("long").alias("checksum")]

    def checksum(self, name: str) -> DataFrame:
        """One row: rows and an order-free checksum of all columns, arrays too; a null differs from an empty value."""
        df, sums = self._sums(name)
        return df.agg(*sums)

    def file_checksums(self, name: str) -> DataFrame:
        """file_path, n_rows and checksum of each file of a table that has rows; a file is the unit that can go bad."""
        df, sums = self._sums(name)
        return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(*sums)

    def scan_checksum(self, name: str, stored: DataFrame, bad: Callable[[Row], bool | None] = lambda row: False) -> bool:
        """Compares the files with file_checksums stored before, and calls `bad` with each that differs.

        Its row has file_path, n_rows and checksum as stored and, as now_rows and now_checksum, as they are now; a file
        that is gone or new has nulls on one side. The scan stops when `bad` returns False. True if it came to the end.
        """
        now = self.file_checksums(name).withColumnsRenamed({"n_rows": "now_rows", "checksum": "now_checksum"})
        same = F.col("n_rows").eqNullSafe(F.col("now_rows")) & F.col("checksum").eqNullSafe(F.col("now_checksum"))
        differing = stored.join(now, "file_path", "full").where(~same).orderBy("file_path")
        return all(bad(row) is not False for row in differing.toLocalIterator())


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of each column."""
    return df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns])


def null_count_of_row(df: DataFrame) -> DataFrame:
    """n_null and n_fixed beside each row."""
    return df.withColumn("n_null", reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns]))
