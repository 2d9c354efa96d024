"""Typed table definitions: columns with SQL types, key order and the geography column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: SQL type names, the Spark type that holds them, and whether their width is fixed.
SQL_TYPES = {
    "int": ("int", True), "bigint": ("bigint", True), "smallint": ("smallint", True), "tinyint": ("smallint", True), "float": ("double", True), "real": ("float", True),
    "bit": ("boolean", True), "money": ("decimal(19,4)", True), "smallmoney": ("decimal(10,4)", True), "decimal": ("decimal(38,10)", True), "numeric": ("decimal(38,10)", True),
    "datetime": ("timestamp_ntz", True), "smalldatetime": ("timestamp_ntz", True), "datetime2": ("timestamp_ntz", True), "date": ("date", True), "time": ("string", True),
    "datetimeoffset": ("timestamp", True), "timestamp": ("binary", True), "uniqueidentifier": ("string", True), "char": ("string", True), "nchar": ("string", True),
    "varchar": ("string", False), "nvarchar": ("string", False), "text": ("string", False), "ntext": ("string", False), "sysname": ("string", False), "varbinary": ("binary", False),
    "binary": ("binary", True), "image": ("binary", False), "geometry": ("binary", False), "geography": ("geography", False), "xml": ("string", False), "hierarchyid": ("binary", False), "sql_variant": ("string", False),
}
_FROM_SPARK = {"int": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "double": "float", "float": "real", "boolean": "bit", "timestamp_ntz": "datetime", "timestamp": "datetimeoffset", "date": "date", "string": "nvarchar", "binary": "varbinary"}
#: Kinds of catalog objects and of indexes.
OBJECT_KINDS = {
    "AF": "AGGREGATE_FUNCTION", "C": "CHECK_CONSTRAINT", "D": "DEFAULT_CONSTRAINT", "F": "FOREIGN_KEY_CONSTRAINT", "FN": "SQL_SCALAR_FUNCTION", "FS": "CLR_SCALAR_FUNCTION", "FT": "CLR_TABLE_VALUED_FUNCTION",
    "IF": "SQL_INLINE_TABLE_VALUED_FUNCTION", "IT": "INTERNAL_TABLE", "P": "SQL_STORED_PROCEDURE", "PC": "CLR_STORED_PROCEDURE", "PG": "PLAN_GUIDE", "PK": "PRIMARY_KEY_CONSTRAINT", "R": "RULE", "RF": "REPLICATION_FILTER_PROCEDURE",
    "S": "SYSTEM_TABLE", "SN": "SYNONYM", "SQ": "SERVICE_QUEUE", "TA": "CLR_TRIGGER", "TF": "SQL_TABLE_VALUED_FUNCTION", "TR": "SQL_TRIGGER", "TT": "TYPE_TABLE", "U": "USER_TABLE", "UQ": "UNIQUE_CONSTRAINT", "V": "VIEW", "X": "EXTENDED_STORED_PROCEDURE",
}
#: Kinds of complex columns.
COMPLEX_KINDS = ("row_overflow", "blob_inline_root", "sparse_vector", "forwarded")
INDEX_KINDS = {0: "HEAP", 1: "CLUSTERED", 2: "NONCLUSTERED", 3: "XML", 4: "SPATIAL"}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    sql_type: str
    length: int | None = None
    nullable: bool = True

    def __post_init__(self):
        if self.sql_type not in SQL_TYPES:
            raise ValueError(f"unknown type {self.sql_type}")

    @property
    def fixed(self) -> bool:
        return SQL_TYPES[self.sql_type][1]

    @property
    def zero(self):
        """What a null reads as in the default-value mode."""
        kind = SQL_TYPES[self.sql_type][0]
        return "" if kind == "string" else False if kind == "boolean" else "1900-01-01 00:00:00" if kind == "timestamp_ntz" else 0


@dataclass(frozen=True)
class KeyPart:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    key: tuple[KeyPart, ...] = field(default=())
    geography: str | None = None
    #: A stored column with the cells of the geography's points; spatial predicates then search it first.
    cell: str | None = None

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("column names repeat")
        for part in self.key:
            if not self.column(part.column).fixed:
                raise ValueError(f"{part.column} has no fixed width, so it can't be in a key")

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"{self.name} has no column {name}")

    @property
    def fixed_count(self) -> int:
        return sum(c.fixed for c in self.columns)

    def describe(self) -> str:
        """The schema as text: place, name, type, key part and order."""
        keys = {p.column: (i, "ASC" if p.ascending else "DESC") for i, p in enumerate(self.key)}
        lines = [f"{self.name} ({len(self.columns)} columns, {self.fixed_count} fixed)"]
        for i, c in enumerate(self.columns):
            length = f"({c.length})" if c.length else ""
            key = f" [PK {keys[c.name][0]} {keys[c.name][1]}]" if c.name in keys else ""
            lines.append(f"{i} {c.name} {c.sql_type}{length}{'' if c.nullable else ' NOT NULL'}{key}")
        return "\n".join(lines)

    @staticmethod
    def of(name: str, df: DataFrame, key: tuple[str | tuple[str, bool], ...] = (), geography: str | None = None) -> TableDef:
        columns = []
        for f in df.schema.fields:
            text = f.dataType.simpleString()
            kind = "geography" if f.name == geography else "decimal" if isinstance(f.dataType, T.DecimalType) else _FROM_SPARK.get(text, "sql_variant")
            kind = {"nvarchar": "nchar"}.get(kind, kind) if any(f.name == (k if isinstance(k, str) else k[0]) for k in key) else kind
            columns.append(ColumnDef(f.name, kind, nullable=f.nullable))
        return TableDef(name, tuple(columns), tuple(KeyPart(k) if isinstance(k, str) else KeyPart(*k) for k in key), geography)
