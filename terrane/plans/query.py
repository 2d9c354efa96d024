"""The query builder: predicates tagged or / and, ordering and top, compiled to one DataFrame.

A row passes if any predicate tagged or holds and all tagged and hold, whatever the order in which they were added; there
is no nesting. A query needs one or-predicate at least. An order column or top given twice is an error. Top without an
order goes by the primary key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terrane.functions import shapes
from terrane.functions.geodesy import point
from terrane.plans.predicates import Predicate
from terrane.schema import TableDef


@dataclass(frozen=True)
class OrderBy:
    """By a column, or with lat and lon by a shape's distance to that point."""

    column: str
    ascending: bool = True
    lat: float | None = None
    lon: float | None = None

    def compile(self, table: TableDef, null_mode: str) -> Column:
        key = F.col(self.column)
        if self.lat is not None:
            key = shapes.distance(key, point(self.lat, self.lon))
            key = F.coalesce(key, F.lit(0.0)) if null_mode == "default_value" else key
        elif null_mode == "default_value":
            key = F.coalesce(key, F.lit(table.column(self.column).zero))
        return key.asc() if self.ascending else key.desc()


@dataclass(frozen=True)
class Select:
    table: TableDef
    source: DataFrame
    null_mode: str = "sql"
    any_of: tuple[Predicate, ...] = ()
    all_of: tuple[Predicate, ...] = ()
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    columns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.null_mode not in ("sql", "default_value"):
            raise ValueError("null_mode is sql or default_value")

    def or_(self, p: Predicate) -> Select:
        p.check(self.table)
        return replace(self, any_of=(*self.any_of, p))

    def and_(self, p: Predicate) -> Select:
        p.check(self.table)
        return replace(self, all_of=(*self.all_of, p))

    __or__, __and__ = or_, and_

    def order_by(self, column: str, ascending: bool = True, lat: float | None = None, lon: float | None = None) -> Select:
        self.table.column(column)
        if any(o.column == column for o in self.order):
            raise ValueError(f"{column} is ordered by twice")
        return replace(self, order=(*self.order, OrderBy(column, ascending, lat, lon)))

    def top(self, n: int) -> Select:
        if self.limit is not None:
            raise ValueError("top is given twice")
        if n < 0:
            raise ValueError("top takes 0 or more")
        return replace(self, limit=n)

    def project(self, *columns: str) -> Select:
        for c in columns:
            self.table.column(c)
        return replace(self, columns=columns)

    def condition(self) -> Column:
        if not self.any_of:
            raise ValueError("a query needs a predicate tagged or")
        join = lambda ps, op: reduce(op, [p.compile(self.table, self.null_mode) for p in ps])
        found = join(self.any_of, lambda a, b: a | b)
        return found & join(self.all_of, lambda a, b: a & b) if self.all_of else found

    def df(self) -> DataFrame:
        out = self.source.where(self.condition())
        by = [o.compile(self.table, self.null_mode) for o in self.order]
        named = {o.column for o in self.order if o.lat is None}
        if self.limit is not None:  # ties go by the key, so that the rows are defined
            by += [F.col(k.column).asc() if k.ascending else F.col(k.column).desc() for k in self.table.key if k.column not in named]
        out = out.orderBy(*by) if by else out
        out = out.limit(self.limit) if self.limit is not None else out
        return out.select(*self.columns) if self.columns else out

    def values(self) -> list[Row]:
        """All rows at the driver; for results known to be small."""
        return self.df().collect()

    def count_df(self) -> DataFrame:
        """One row: the number of rows, at most top. The limit needs no sort: it bounds the number."""
        n = F.count(F.lit(1))
        return self.source.where(self.condition()).agg((n if self.limit is None else F.least(n, F.lit(self.limit))).cast("long").alias("n"))

    def count(self) -> int:
        return self.count_df().first()[0]

    def for_record(self, fn: Callable[[Row], bool | None]) -> None:
        """Call fn with each row until it gives False, partition by partition. Top and order are not allowed here."""
        if self.order or self.limit is not None:
            raise ValueError("for_record takes neither top nor order")
        for row in self.df().toLocalIterator():
            if fn(row) is False:
                return


def find(source: DataFrame, condition: Column) -> Row | None:
    """Some row that satisfies the condition, or None."""
    return next(iter(source.where(condition).limit(1).collect()), None)


def scan_if(source: DataFrame, fn: Callable[[Row], bool | None]) -> None:
    """Call fn with the rows until it gives False."""
    for row in source.toLocalIterator():
        if fn(row) is False:
            return
