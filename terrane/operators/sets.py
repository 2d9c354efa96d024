"""Sets of integers as tables: runs, bitmaps, step maps and sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integers of a block of the run finder: blocks are windows of their own, so no task gets all.
BLOCK = 1 << 16


def islands(df: DataFrame, column: str) -> DataFrame:
    """first and last of each run of consecutive integers in a column; repeats count once, nulls not at all.

    Runs are found within blocks of BLOCK integers, in parallel; what remains, at most a few edges a block, is joined by
    block number with the block before, so runs over many blocks need no window over everything but the block edges.
    """
    keys = df.select(F.col(column).cast("long").alias("k")).where("k IS NOT NULL").distinct().withColumn("block", F.floor(F.col("k") / BLOCK))
    w = Window.partitionBy("block").orderBy("k")
    runs = keys.withColumn("g", F.col("k") - F.row_number().over(w)).groupBy("block", "g").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    edge = runs.where((F.col("first") == F.col("block") * BLOCK) | (F.col("last") == (F.col("block") + 1) * BLOCK - 1))
    inner = runs.where((F.col("first") != F.col("block") * BLOCK) & (F.col("last") != (F.col("block") + 1) * BLOCK - 1)).select("first", "last")
    o = Window.orderBy("first")  # two rows a block at most
    begins = F.coalesce((F.col("first") != F.lag("last").over(o) + 1).cast("int"), F.lit(1))
    joined = edge.withColumn("b", begins).withColumn("n", F.sum("b").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return inner.unionByName(joined.groupBy("n").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last"))


def island_merge(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Runs of the union of two sets."""
    return islands(a.select(column).unionByName(b.select(column)), column)


def pop_front(runs: DataFrame) -> DataFrame:
    """The first run."""
    return runs.orderBy("first").limit(1)


def pop_back(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("last")).limit(1)


def island_values(runs: DataFrame) -> DataFrame:
    """The integers of the runs."""
    return runs.select(F.explode(F.sequence("first", "last")).alias("k"))


def run_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: how many runs, the least and the largest integer."""
    return islands(df, column).agg(F.count(F.lit(1)).alias("n_runs"), F.min("first").alias("least"), F.max("last").alias("largest"))


def bitmap(df: DataFrame, column: str, *by: str) -> DataFrame:
    """bucket and bitmap of a column's integers (negative ones too) by group."""
    k = F.col(column).cast("long")
    return df.where(k.isNotNull()).groupBy(*by, F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))


def bitmap_distinct(df: DataFrame, column: str, *by: str) -> DataFrame:
    """How many distinct integers, exactly: bitmaps are small partial results where a set of values would be large."""
    return bitmap(df, column, *by).groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Erase: the values that are not in gone (same column)."""
    return df.select(column).distinct().join(gone.select(column), column, "left_anti")


def step_value(key: Column, steps: list[tuple[float, object]], start) -> Column:
    """Value of a step map at key: of the greatest breakpoint that is not over it, else start. Steps are few literals."""
    out = F.lit(start)
    for at, value in sorted(steps, key=lambda s: s[0]):
        out = F.when(key >= at, F.lit(value)).otherwise(out)
    return F.when(key.isNotNull(), out)


def assign_steps(steps: list[tuple[float, object]], start, begin: float, end: float, value) -> list[tuple[float, object]]:
    """A step map with value on [begin, end); neighbours always differ."""
    if begin >= end:
        return list(steps)
    at = lambda x: next((v for k, v in reversed(steps) if k <= x), start)
    out = [s for s in steps if s[0] < begin] + [(begin, value), (end, at(end))] + [s for s in steps if s[0] > end]
    kept, before = [], start
    for k, v in out:
        if v != before:
            kept.append((k, v))
            before = v
    return kept


def step_lookup(df: DataFrame, key: str, steps: DataFrame, at: str, value: str, block: float) -> DataFrame:
    """As step_value with a table of breakpoints: keys and breakpoints are merged in blocks of the given width.

    A block is sorted as a stream (it may spill), keys take the last breakpoint before them, or what the blocks before
    end with. Nothing is collected, and no key meets more than one breakpoint.
    """
    b = lambda c: F.floor(F.col(c) / block)
    marked = lambda rows, c, row, step: rows.select(b(c).alias("_block"), F.col(c).cast("double").alias("_at"), row.alias("_row"), step.alias("_step"))
    kind = df.select(F.struct(*df.columns).alias("_row")).schema["_row"].dataType
    step = F.struct(F.col(value).alias("_value"))
    step_kind = steps.select(step.alias("_step")).schema["_step"].dataType
    both = marked(df, key, F.struct(*df.columns), F.lit(None).cast(step_kind)).unionByName(marked(steps.where(F.col(at).isNotNull()), at, F.lit(None).cast(kind), step))
    inside = Window.partitionBy("_block").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each block of breakpoints: where it ends, and the next block that has some
    ends = steps.where(F.col(at).isNotNull()).groupBy(b(at).alias("_block")).agg(F.max_by(step, at).alias("_end"))
    carried = ends.unionByName(df.where(F.col(key).isNotNull()).select(b(key).alias("_block")).distinct().withColumn("_end", F.lit(None).cast(step_kind))).groupBy("_block").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = carried.select("_block", F.last("_end", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = both.withColumn("_own", F.last("_step", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull()).join(carried, "_block", "left")
    chosen = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_before")["_value"])
    return found.select("_row.*", chosen.alias(value))

def sorted_unique(c: Column) -> Column:
    """A sorted array without repeats."""
    return F.array_sort(F.array_distinct(c))


def array_lower_bound(c: Column, value) -> Column:
    """Place (from 0) of the first element not under value in a sorted array."""
    return F.size(F.filter(c, lambda x: x < value))


def array_insert_sorted(c: Column, value) -> Column:
    """The value at its place, unless it is there."""
    v = F.lit(value)
    return F.when(F.array_contains(c, v), c).otherwise(F.concat(F.filter(c, lambda x: x < v), F.array(v), F.filter(c, lambda x: x > v)))


def array_erase(c: Column, value) -> Column:
    return F.array_remove(c, value)
