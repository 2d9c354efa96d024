"""Sinks: text dumps, SQL export scripts and generated table definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import trim_spaces
from terrane.runtime import cut
from terrane.schema import ColumnDef, KeyPart, TableDef

#: Cells that a spatial index of an export gives each object.
CELLS_PER_OBJECT = 8192


def dump(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), records: int | None = None, trim: bool = False, order: list[str | Column] | None = None) -> DataFrame:
    """One `line` a row: the row's number from 1 and its columns as text, nulls as [NULL].

    Numbers follow `order` or, without it, the input. The rows are written down once in that order; what is counted
    then is the rows of each partition, so numbers need no pass through one task.
    """
    named = [c for c in columns or df.columns if c not in exclude]
    if missing := set(named) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    if order:
        df = df.orderBy(*order)
    if records is not None:
        df = df.limit(records)
    text = lambda c: trim_spaces(F.col(c).cast("string")) if trim and dict(df.dtypes)[c] == "string" else F.col(c).cast("string")
    cells = [F.coalesce(text(c), F.lit("[NULL]")) for c in named]
    numbered = cut(df.select(F.monotonically_increasing_id().alias("_i"), F.concat_ws(",", *cells).alias("_cells")))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(numbered.groupBy(part.alias("_part")).count().collect())  # a row for each partition
    starts, total = [], 0
    for number, n in sizes:
        starts += [F.lit(number), F.lit(total)]
        total += n
    before = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return numbered.select(F.concat_ws(",", (before + place + 1).cast("string"), "_cells").alias("line"))


def dump_head(database: str, table: str, columns: list[str]) -> list[str]:
    """The lines before a table's rows: database and table, then the columns."""
    return [f"[{database}].[{table}]", ",".join(["#", *columns])]


def write_dump(df: DataFrame, path: str, **options) -> None:
    dump(df, **options).write.mode("overwrite").text(path)


def export_script(table: TableDef, source: str, target: str, spatial: bool = True, valid: bool = False) -> str:
    """SQL that copies a table between databases, by default with its spatial index."""
    columns = ", ".join(f"[{c.name}]" for c in table.columns)
    picked = ", ".join(f"[{c.name}].MakeValid()" if valid and c.sql_type == "geography" else f"[{c.name}]" for c in table.columns)
    order = ", ".join(f"[{p.column}] {'ASC' if p.ascending else 'DESC'}" for p in table.key)
    lines = [f"SET IDENTITY_INSERT {target}.[{table.name}] ON;", f"INSERT INTO {target}.[{table.name}] ({columns})", f"SELECT {picked} FROM {source}.[{table.name}]" + (f" ORDER BY {order};" if order else ";"), f"SET IDENTITY_INSERT {target}.[{table.name}] OFF;"]
    if spatial and table.geography:
        lines.append(f"CREATE SPATIAL INDEX [idx_{table.name}] ON {target}.[{table.name}]([{table.geography}]) USING GEOGRAPHY_GRID WITH (GRIDS = (HIGH, HIGH, HIGH, HIGH), CELLS_PER_OBJECT = {CELLS_PER_OBJECT});")
    return "\n".join(lines) + "\n"


def export_all(schema: list[tuple[str, str, int, str]], source: str, target: str, geography: str | None = None, spatial: bool = True) -> str:
    """One script for all tables of a schema list (table, column, position, schema), by schema, table and position.

    First queries that show invalid shapes of the source, then the spatial indexes, then the copies. A table that has
    the geography column fills its columns ST_AREA and ST_LENGTH from it. Tables must exist in the target.
    """
    tables: dict[tuple[str, str], list[str]] = {}
    for table, column, _, owner in sorted(schema, key=lambda r: (r[3], r[0], r[2])):
        tables.setdefault((owner, table), []).append(column)
    checks, indexes, copies = [], [], []
    for (owner, table), columns in tables.items():
        here, there = f"[{source}].[{owner}].[{table}]", f"[{target}].[{owner}].[{table}]"
        from_shape = {}
        if geography and geography in columns:
            from_shape = {"ST_AREA": f"{geography}.STArea() AS ST_AREA", "ST_LENGTH": f"{geography}.STLength() AS ST_LENGTH"}
            checks += [f"PRINT 'CHECK {here}'", "GO", f"SELECT * FROM {here} WHERE {geography}.STIsValid() = 0;", "GO"]
            if spatial:
                indexes += [f"CREATE SPATIAL INDEX SPATIAL_{owner.upper()}_{table.upper()} ON {there}({geography}) USING GEOGRAPHY_GRID WITH (GRIDS = (HIGH, HIGH, HIGH, HIGH), CELLS_PER_OBJECT = {CELLS_PER_OBJECT});", "GO"]
        picked = ", ".join(from_shape.get(c, c) for c in columns)
        copies += [f"PRINT 'INSERT INTO {there}'", "GO", f"SET IDENTITY_INSERT {there} ON;", f"INSERT INTO {there} ({', '.join(columns)})", f"SELECT {picked} FROM {here};", f"SET IDENTITY_INSERT {there} OFF;", "GO"]
    return "".join(f"{line}\n" for line in checks + indexes + copies)


def generate_definition(table: TableDef) -> str:
    """Python source that defines the table; running it gives an equal definition under the table's name."""
    columns = ", ".join(f"ColumnDef({c.name!r}, {c.sql_type!r}, {c.length!r}, {c.nullable!r})" for c in table.columns)
    key = ", ".join(f"KeyPart({p.column!r}, {p.ascending!r})" for p in table.key)
    tail = lambda s: s + "," if s else s
    return f"from terrane.schema import ColumnDef, KeyPart, TableDef\n\n{table.name} = TableDef({table.name!r}, ({tail(columns)}), ({tail(key)}), {table.geography!r})\n"


def load_definition(source: str, name: str) -> TableDef:
    """The definition in generated source."""
    space = {"ColumnDef": ColumnDef, "KeyPart": KeyPart, "TableDef": TableDef}
    exec(source, space)
    return space[name]
