"""Predicates on the columns of one table. Each compiles to a Column that Catalyst can push to the scan.

Null modes: "sql" is three-valued. In "default_value" a null reads as its type's zero: what the predicate says of zero is
worked out here, and only if that is true "or the column is null" is added, so ranges are still pushed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import shapes
from terrane.functions.geodesy import point
from terrane.operators.cover import cover_box, cover_circle, in_ranges
from terrane.schema import TableDef

#: Floats within this distance are equal.
EPSILON = 1e-12
COMPARISONS = {"equal": lambda a, b: a == b, "less": lambda a, b: a < b, "less_eq": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_eq": lambda a, b: a >= b}
AUTO, USE, IGNORE = "AUTO", "USE", "IGNORE"


class Predicate:
    """What can stand in a query; tagged or / and when it is added to one."""

    columns: tuple[str, ...] = ()
    hint = AUTO

    def compile(self, table: TableDef, null_mode: str) -> Column:
        raise NotImplementedError

    def check(self, table: TableDef) -> None:
        for name in self.columns:
            table.column(name)
        if self.hint == USE:
            first = table.key[0].column if table.key else None
            if not (self.columns and self.columns[0] in (first, table.geography)) or isinstance(self, Not):
                raise ValueError("an index can be used only on the first key column or the geography, and not by Not")


def _text(table: TableDef, name: str, value):
    """Fixed-width text compares as padded to its width."""
    c, own = table.column(name), F.col(name)
    if c.sql_type in ("char", "nchar") and c.length and isinstance(value, str):
        return F.rpad(own, c.length, " "), F.rpad(F.lit(value), c.length, " ")
    return own, F.lit(value)


class _Value(Predicate):
    def __init__(self, column: str, *values, hint: str = AUTO):
        self.columns, self.values, self.hint = (column,), values, hint

    def test(self, table: TableDef, name: str) -> Column:
        raise NotImplementedError

    def holds(self, x) -> bool:
        raise NotImplementedError

    def compile(self, table: TableDef, null_mode: str) -> Column:
        name = self.columns[0]
        found = self.test(table, name)
        if null_mode == "default_value":
            zero = table.column(name).zero
            kinds = {type(v) for v in self.values}
            comparable = all(isinstance(v, (int, float)) for v in self.values) == isinstance(zero, (int, float)) and kinds
            found = found | F.col(name).isNull() if comparable and self.holds(zero) else F.coalesce(found, F.lit(False))
        return found

    def floating(self, table: TableDef) -> bool:
        return table.column(self.columns[0]).sql_type in ("float", "real")

    def equal(self, table: TableDef, name: str, v) -> Column:
        if self.floating(table):
            return F.col(name).between(float(v) - EPSILON, float(v) + EPSILON)
        a, b = _text(table, name, v)
        return a == b


def _same(a, b) -> bool:
    return abs(a - b) <= EPSILON if isinstance(a, float) or isinstance(b, float) else a == b


class Where(_Value):
    """column = value; floats within EPSILON, as a range so that it is pushed."""

    def test(self, table, name):
        return self.equal(table, name, self.values[0])

    def holds(self, x):
        return _same(x, self.values[0])


class In(_Value):
    """Equal to any of the values."""

    def test(self, table, name):
        if self.floating(table) or table.column(name).sql_type in ("char", "nchar"):
            return reduce(lambda a, b: a | b, [self.equal(table, name, v) for v in self.values], F.lit(False))
        return F.col(name).isin(*self.values)

    def holds(self, x):
        return any(_same(x, v) for v in self.values)


class Not(In):
    """Equal to none of the values. In default_value mode null rows stay unless zero is among the values."""

    def test(self, table, name):
        return ~super().test(table, name)

    def holds(self, x):
        return not super().holds(x)


class Less(_Value):
    def test(self, table, name):
        a, b = _text(table, name, self.values[0])
        return a < b

    def holds(self, x):
        return x < self.values[0]


class Greater(_Value):
    def test(self, table, name):
        a, b = _text(table, name, self.values[0])
        return a > b

    def holds(self, x):
        return x > self.values[0]


class LessEq(_Value):
    """Less or equal, with EPSILON for floats."""

    def test(self, table, name):
        a, b = _text(table, name, self.values[0])
        return a <= (b + EPSILON if self.floating(table) else b)

    def holds(self, x):
        return x <= self.values[0]


class GreaterEq(_Value):
    def test(self, table, name):
        a, b = _text(table, name, self.values[0])
        return a >= (b - EPSILON if self.floating(table) else b)

    def holds(self, x):
        return x >= self.values[0]


class Between(_Value):
    """Both ends included; empty if the first is over the second."""

    def test(self, table, name):
        a, lo = _text(table, name, self.values[0])
        _, hi = _text(table, name, self.values[1])
        return a.between(lo - EPSILON, hi + EPSILON) if self.floating(table) else a.between(lo, hi)

    def holds(self, x):
        return self.values[0] <= x <= self.values[1]


class IsNull(Predicate):
    """Null in all the named columns."""

    def __init__(self, *columns: str):
        self.columns = columns

    def compile(self, table, null_mode):
        return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in self.columns])


class NotNull(Predicate):
    def __init__(self, column: str):
        self.columns = (column,)

    def compile(self, table, null_mode):
        return F.col(self.columns[0]).isNotNull()


class All(Predicate):
    """Every row."""

    def compile(self, table, null_mode):
        return F.lit(True)


@dataclass
class If(Predicate):
    """A callable that gets a function from names to Columns and gives a Column."""

    rule: Callable[[Callable[[str], Column]], Column]
    columns: tuple[str, ...] = field(default=())
    hint = AUTO

    def compile(self, table, null_mode):
        return self.rule(F.col)


class _Shape(Predicate):
    def __init__(self, column: str, hint: str = AUTO, null_as_default: bool = False):
        self.columns, self.hint, self.null_as_default = (column,), hint, null_as_default

    def sought(self, table: TableDef, cover: Callable[[], list[tuple[int, int]]]) -> Column:
        """True, or where the table stores cells of its points and the hint allows it, that the cell is in the cover."""
        if table.cell is None or self.hint == IGNORE or self.columns[0] != table.geography:
            return F.lit(True)
        return in_ranges(F.col(table.cell), cover())


class STContains(_Shape):
    """The shape holds the point; false for a null shape."""

    def __init__(self, column: str, lat: float, lon: float, hint: str = AUTO):
        super().__init__(column, hint)
        self.lat, self.lon = lat, lon

    def compile(self, table, null_mode):
        pad = 1e-9
        return self.sought(table, lambda: cover_box(self.lat - pad, self.lon - pad, self.lat + pad, self.lon + pad)) & F.coalesce(shapes.contains(F.col(self.columns[0]), point(self.lat, self.lon)), F.lit(False))


class STIntersects(_Shape):
    """The shape meets the box; false for a null shape."""

    def __init__(self, column: str, min_lat: float, min_lon: float, max_lat: float, max_lon: float, hint: str = AUTO):
        super().__init__(column, hint)
        self.box = (min_lat, min_lon, max_lat, max_lon)

    def compile(self, table, null_mode):
        return self.sought(table, lambda: cover_box(self.box[0] - 1e-9, self.box[1] - 1e-9, self.box[2] + 1e-9, self.box[3] + 1e-9)) & F.coalesce(shapes.intersects_box(F.col(self.columns[0]), *self.box), F.lit(False))


class STDistance(_Shape):
    """Compare the distance to a point in metres. Null shapes never match, or count as 0 with null_as_default."""

    def __init__(self, column: str, comparison: str, lat: float, lon: float, metres: float, hint: str = AUTO, null_as_default: bool = False):
        super().__init__(column, hint, null_as_default)
        self.comparison, self.lat, self.lon, self.metres = comparison, lat, lon, metres

    def compile(self, table, null_mode):
        d = shapes.distance(F.col(self.columns[0]), point(self.lat, self.lon))
        d = F.coalesce(d, F.lit(0.0)) if self.null_as_default else d
        exact = F.coalesce(COMPARISONS[self.comparison](d, F.lit(float(self.metres))), F.lit(False))
        near = self.comparison in ("equal", "less", "less_eq") and not self.null_as_default
        return self.sought(table, lambda: cover_circle(self.lat, self.lon, self.metres)) & exact if near else exact


class STLength(_Shape):
    def __init__(self, column: str, comparison: str, metres: float, null_as_default: bool = False):
        super().__init__(column, AUTO, null_as_default)
        self.comparison, self.metres = comparison, metres

    def compile(self, table, null_mode):
        n = shapes.length(F.col(self.columns[0]))
        n = F.coalesce(n, F.lit(0.0)) if self.null_as_default else n
        return F.coalesce(COMPARISONS[self.comparison](n, F.lit(float(self.metres))), F.lit(False))
