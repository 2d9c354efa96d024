"""Access by primary key: exact find, lower bound and ordered walks, as filters that reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terrane.schema import TableDef


def make_key(table: TableDef) -> Column:
    """The key as one comparable value; for descending parts use the order, not this."""
    return F.struct(*[p.column for p in table.key])


def key_equal(table: TableDef, *values) -> Column:
    if len(values) != len(table.key):
        raise ValueError("a value is needed for each part of the key")
    return reduce(lambda a, b: a & b, [F.col(p.column) == v for p, v in zip(table.key, values, strict=True)])


def key_less(table: TableDef, *values) -> Column:
    """Before the given key in stored order, part by part."""
    out = F.lit(False)
    for p, v in reversed(list(zip(table.key, values, strict=False))):
        c = F.col(p.column)
        out = (c < v if p.ascending else c > v) | ((c == v) & out)
    return out


def stored_order(table: TableDef, forward: bool = True) -> list[Column]:
    return [F.col(p.column).asc() if p.ascending == forward else F.col(p.column).desc() for p in table.key]


def find_with_key(table: TableDef, df: DataFrame, *values) -> DataFrame:
    """The row of a full key; of several, the least by all columns that have an order."""
    ordered = [c for c, kind in df.dtypes if not kind.startswith("map") and "map<" not in kind]
    return df.where(key_equal(table, *values)).orderBy(*ordered).limit(1)


def lower_bound(table: TableDef, df: DataFrame, first) -> DataFrame:
    """The first row not before the value of the first key part, and `is_equal`, whether it has just that value."""
    p = table.key[0]
    c = F.col(p.column)
    return df.where(c >= first if p.ascending else c <= first).orderBy(*stored_order(table)).limit(1).withColumn("is_equal", c == first)


def walk(table: TableDef, df: DataFrame, *values, forward: bool = True) -> DataFrame:
    """Rows from a key (or its leading parts) on, in stored order, or from it back."""
    parts = list(zip(table.key, values, strict=False))
    if not parts:
        return df.orderBy(*stored_order(table, forward))
    before = key_less(table, *values)
    same = reduce(lambda a, b: a & b, [F.col(p.column) == v for p, v in parts])
    return df.where(~before if forward else before | same).orderBy(*stored_order(table, forward))


def scan_next(table: TableDef, df: DataFrame, fn: Callable[[Row], bool | None], *values) -> None:
    for row in walk(table, df, *values).toLocalIterator():
        if fn(row) is False:
            return


def scan_prev(table: TableDef, df: DataFrame, fn: Callable[[Row], bool | None], *values) -> None:
    for row in walk(table, df, *values, forward=False).toLocalIterator():
        if fn(row) is False:
            return


def seek_any(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows of any of several key conditions, each once: one filter, no union to make distinct."""
    return df.where(reduce(lambda a, b: a | b, conditions))


def union_by_key(table: TableDef, *parts: DataFrame) -> DataFrame:
    """Rows of several results, one for each key."""
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates([p.column for p in table.key])
