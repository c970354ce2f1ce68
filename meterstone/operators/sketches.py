"""Daily sketch tables: counts of different values, and quantiles, over any span of days without reading the rows again.

A day's sketch has a bounded size however many rows it stands for, and sketches of days merge into that of the span. Counts come from
HyperLogLog sketches (relative error about 0.8 / sqrt(2 ** log_size); far fewer values than the sketch has room for are counted
exactly), quantiles from KLL sketches (``k`` values or fewer exactly; beyond, the rank is off by about 2.3 / k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.functions.time import Instant, day
from meterstone.operators.governance import is_paid

LOG_SIZE, KLL_SIZE = 14, 1000


def daily_counts(rows: DataFrame, ts: str, keys: list[str], counted: list[str], log_size: int = LOG_SIZE) -> DataFrame:
    """One row per day and keys with a sketch of the different values of each column, and the first and last time."""
    sketches = [F.hll_sketch_agg(c, log_size).alias(c) for c in counted]
    return rows.groupBy(F.to_date(ts).alias("day"), *keys).agg(*sketches, F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def counts_over(daily: DataFrame, first: Instant, last: Instant, keys: list[str], counted: list[str]) -> DataFrame:
    """Different values between two days, both included, per ``keys``, which may be fewer than the table's."""
    span = daily.where(F.col("day").between(day(first), day(last)))
    return span.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in counted],
                                   F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def daily_scanners(findings: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """Scanners and scan runs of each package and day."""
    return daily_counts(findings, "start_timestamp", ["scanner_package_name"], ["scanner_name", "event_id"], log_size)


def paid_scanners_over(daily: DataFrame, first: Instant, last: Instant) -> DataFrame:
    """Different scanners of paid packages in a span of days."""
    return counts_over(daily.where(is_paid()), first, last, [], ["scanner_name"]).select(F.col("scanner_name").alias("scanners"))


def run_rate_over(daily: DataFrame, first: Instant, last: Instant) -> DataFrame:
    """Scanners, scan runs and runs per day of each package in a span of days."""
    found = counts_over(daily, first, last, ["scanner_package_name"], ["scanner_name", "event_id"])
    days = F.datediff("last_at", "first_at")
    rate = F.round(F.try_divide(F.col("event_id"), days), 1).cast("decimal(18,1)")
    return found.select("scanner_package_name", F.col("scanner_name").alias("distinct_scanners"), F.col("event_id").alias("total_scan_runs"),
                        days.alias("days_active"), rate.alias("runs_per_day"))


def daily_usage(rows: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """Users and queries of each function, model and day."""
    return daily_counts(rows, "start_time", ["function_name", "model_name"], ["user_id", "query_id"], log_size)


def usage_over(daily: DataFrame, first: Instant, last: Instant, by: list[str]) -> DataFrame:
    """Different users and queries in a span of days, by function, model, both or neither."""
    return counts_over(daily, first, last, by, ["user_id", "query_id"]).select(*by, F.col("user_id").alias("users"), F.col("query_id").alias("queries"))


def daily_durations(queries: DataFrame, k: int = KLL_SIZE) -> DataFrame:
    """One row per entity and day with a sketch of the seconds its queries took."""
    known = queries.where(F.col("duration_seconds").isNotNull())
    return known.groupBy("entity", F.to_date("start_time").alias("day")).agg(F.kll_sketch_agg_bigint("duration_seconds", k).alias("seconds"))


def moving_quantile(daily: DataFrame, days: int, quantile: float) -> DataFrame:
    """For each entity and day with queries, the quantile of the ``days`` days before it; days without any before them have none.

    Each day's sketch is moved once; an entity is as many rows as it has days.
    """
    span = Window.partitionBy("entity").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-days, -1)
    merged = daily.select("entity", "day", F.kll_merge_agg_bigint("seconds").over(span).alias("seconds"))
    known = merged.where(F.kll_sketch_get_n_bigint("seconds") > 0)
    return known.select("entity", "day", F.kll_sketch_get_quantile_bigint("seconds", F.lit(quantile)).alias("limit"))


def long_query_outliers(queries: DataFrame, daily: DataFrame, days: int = 30, quantile: float = 0.99) -> DataFrame:
    """Queries longer than the quantile of their entity's queries of the days before.

    The limits are one row per entity and day. A hot entity's queries are split over days, and by Spark where a day is large.
    """
    limits = moving_quantile(daily, days, quantile)
    dated = queries.withColumn("day", F.to_date("start_time"))
    return dated.join(limits, ["entity", "day"]).where(F.col("duration_seconds") > F.col("limit")).select(
        "entity", "query_id", "user_id", "start_time", "duration_seconds", "limit")


def streamed_scanners(findings: DataFrame, late: str = "1 hour", log_size: int = LOG_SIZE) -> DataFrame:
    """The rows of ``daily_scanners`` as a stream: a day is given out once it is over."""
    runs = findings.withWatermark("start_timestamp", late).groupBy(F.window("start_timestamp", "1 day").alias("w"), "scanner_package_name")
    sketches = [F.hll_sketch_agg(c, log_size).alias(c) for c in ("scanner_name", "event_id")]
    return runs.agg(*sketches, F.min("start_timestamp").alias("first_at"), F.max("start_timestamp").alias("last_at")).select(
        F.to_date("w.start").alias("day"), "scanner_package_name", "scanner_name", "event_id", "first_at", "last_at")


def estimate(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)
