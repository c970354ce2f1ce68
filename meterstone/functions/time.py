"""Date and time expressions. ``as_of`` stands for "now", so every result can be repeated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = str | dt.date | dt.datetime


def instant(as_of: Instant) -> Column:
    return F.lit(as_of).cast("timestamp")


def day(as_of: Instant) -> Column:
    return F.to_date(instant(as_of))


def cutoff_date(as_of: dt.date, days_back: int) -> dt.date:
    """First day of a report that looks ``days_back`` (1 to 365) days back."""
    if not 1 <= days_back <= 365:
        raise ValueError("days_back must lie between 1 and 365")
    return as_of - dt.timedelta(days=days_back)


def since_date(df: DataFrame, ts: str, first_day: dt.date, partition_column: str = "usage_date") -> DataFrame:
    """Rows whose ``ts`` falls on ``first_day`` or later.

    The date test reaches the Parquet scan as a filter on ``ts``. A table partitioned by
    ``usage_date`` also skips whole partitions.
    """
    kept = df.where(F.to_date(ts) >= F.lit(first_day))
    if partition_column in df.columns:
        kept = kept.where(F.col(partition_column) >= F.lit(first_day))
    return kept


def since(df: DataFrame, ts: str, start: Column, as_of: Instant, partition_column: str = "usage_date") -> DataFrame:
    """Rows with ``ts`` from an instant up to ``as_of``, both included; skips days of a table that has them as a column."""
    kept = df.where(F.col(ts).between(start, instant(as_of)))
    if partition_column in df.columns:
        kept = kept.where(F.col(partition_column).between(F.to_date(start), day(as_of)))
    return kept


def within(ts: str, as_of: Instant, *, days: int = 0, hours: int = 0) -> Column:
    """``ts`` lies in the last ``days``/``hours`` before ``as_of``; both ends count, later rows do not."""
    return F.col(ts).between(before(as_of, days=days, hours=hours), instant(as_of))


def before(as_of: Instant, *, days: int = 0, hours: int = 0) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))


def month_start(as_of: Instant) -> Column:
    return F.date_trunc("month", instant(as_of))


def _boundaries(start: Column, end: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(end) / seconds) - F.floor(F.unix_seconds(start) / seconds)


def minutes_between_marks(start: Column, end: Column) -> Column:
    """Minute marks crossed from ``start`` to ``end``."""
    return _boundaries(start, end, 60)


def seconds_between_marks(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def days_between_marks(start: Column, end: Column) -> Column:
    """Midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start).cast("bigint")


def month_of(text: str) -> dt.date:
    """First day of a ``YYYY-MM`` month."""
    return dt.datetime.strptime(text, "%Y-%m").date()
