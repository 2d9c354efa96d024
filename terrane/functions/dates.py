"""Dates in days since 1900-01-01 and ticks of a three-hundredth of a second, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1900-01-01 to 1970-01-01, ticks of a second and of a day.
DAYS_TO_1970, TICKS, TICKS_OF_DAY = 25_567, 300, 300 * 86_400


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def unix_time(ts: Column) -> Column:
    """Seconds since 1970 (UTC), rounded down."""
    return F.floor(_micros(ts) / 1_000_000).cast("long")


def day_number(ts: Column) -> Column:
    """Days since 1900-01-01."""
    return F.datediff(F.to_date(ts), F.lit("1900-01-01").cast("date"))


def day_ticks(ts: Column) -> Column:
    """Ticks since midnight, rounded down."""
    return F.floor(F.pmod(_micros(ts), F.lit(86_400_000_000)) * 3 / 10_000).cast("long")


def milliseconds(ticks: Column) -> Column:
    """Of a number of ticks within its second, truncated."""
    return F.floor((ticks % TICKS) * 1000 / TICKS).cast("int")


def from_parts(days: Column, ticks: Column) -> Column:
    """timestamp_ntz of a day number and ticks; milliseconds are truncated."""
    seconds = F.floor(ticks / TICKS)
    whole = (days.cast("long") - DAYS_TO_1970) * 86_400 + seconds
    return F.timestamp_micros(whole.cast("long") * 1_000_000 + milliseconds(ticks).cast("long") * 1000).cast("timestamp_ntz")


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def date_text(ts: Column) -> Column:
    """Y-MM-DD hh:mm:ss.mmm"""
    return F.date_format(ts, "y-MM-dd HH:mm:ss.SSS")


def gregorian(ts: Column) -> Column:
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"))


def clock(ts: Column) -> Column:
    return F.struct(F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"), F.floor(_micros(ts) / 1000 % 1000).cast("int").alias("milliseconds"))


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def local_time(seconds: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), zone).cast("timestamp_ntz")
