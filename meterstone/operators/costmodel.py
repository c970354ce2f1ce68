"""Cost of scanning: scenario ranges, savings, scheduled runs and how they compare with observed ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.fixed_values import CREDIT_PRICE, FREE_PACKAGE_NAME, PACKAGE_DAILY_CREDITS
from meterstone.functions.predicates import duration_tier, is_true
from meterstone.functions.time import Instant, day

# Runs per 30-day month and per year of each frequency.
FREQUENCY = {"daily": (30, 365), "weekly": (4, 52), "monthly": (1, 12), "off": (0, 0)}

# Frequency of the CIS package and of the threat packages in each scenario; the free package never costs.
SCENARIOS = {
    "everything daily": ("daily", "daily"),
    "CIS weekly, threat daily": ("weekly", "daily"),
    "CIS monthly, threat weekly": ("monthly", "weekly"),
    "both off": ("off", "off"),
    "free package only": ("off", "off"),
}
PAID_PACKAGES = ("CIS_BENCHMARKS", "THREAT_INTELLIGENCE", "THREAT_INTELLIGENCE_EVENTS")


def package_share(scanners: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Part of each package's scanners that are on. Event-driven checks go with their package.

    With the package table the answer is about the present: a package that is off has no part that is on.
    """
    shares = scanners.groupBy("scanner_package_id").agg(
        (F.count_if(is_true("state")).cast("decimal(19,0)") / F.count(F.lit(1)).cast("decimal(19,0)"))
        .cast("decimal(9,6)").alias("share")
    )
    if packages is None:
        return shares
    on = packages.where(is_true("state")).select(F.col("id").alias("scanner_package_id"), F.lit(True).alias("on"))
    share = F.when(F.col("on"), F.col("share")).otherwise(F.lit(0)).cast("decimal(9,6)")
    return shares.join(on, "scanner_package_id", "left").select("scanner_package_id", share.alias("share"))


def scenario_cost(shares: DataFrame, daily_credits: Mapping[str, tuple] = PACKAGE_DAILY_CREDITS) -> DataFrame:
    """Low and high credits per month and year, and dollars per year, of each scenario.

    ``shares`` holds the enabled part of each package (0 when it is off). Yearly credits are rounded
    outward to whole credits, and dollars follow from them.
    """
    packages = {"CIS_BENCHMARKS": [PAID_PACKAGES[0]], "THREAT_INTELLIGENCE": list(PAID_PACKAGES[1:])}
    options = []
    for scenario, frequencies in SCENARIOS.items():
        for (package, parts), frequency in zip(packages.items(), frequencies):
            month, year = FREQUENCY[frequency]
            low = sum(daily_credits[p][0] for p in parts)
            high = sum(daily_credits[p][1] for p in parts)
            options.append(F.struct(
                F.lit(scenario).alias("scenario"), F.lit(package).alias("package"),
                *[F.lit(v).cast("decimal(18,4)").alias(n) for n, v in (
                    ("month_low", low * month), ("month_high", high * month), ("year_low", low * year), ("year_high", high * year),
                )],
            ))
    priced = shares.select("scanner_package_id", "share", F.explode(F.array(*options)).alias("o")).where(
        F.col("scanner_package_id") == F.col("o.package")
    )
    # Products keep all ten decimals; only the sum is rounded.
    total = lambda name: F.sum(F.col(f"o.{name}") * F.col("share")).cast("decimal(28,6)")
    sums = priced.groupBy(F.col("o.scenario").alias("scenario")).agg(
        total("month_low").alias("monthly_low"), total("month_high").alias("monthly_high"),
        F.floor(total("year_low")).alias("annual_low"), F.ceil(total("year_high")).alias("annual_high"),
    )
    price = F.lit(CREDIT_PRICE).cast("decimal(8,2)")
    dollars = lambda c: (F.col(c).cast("decimal(19,0)") * price).cast("decimal(28,2)")
    return sums.withColumn("annual_cost_low", dollars("annual_low")).withColumn("annual_cost_high", dollars("annual_high")).select(
        "scenario", "monthly_low", "monthly_high", F.col("annual_low").cast("bigint").alias("annual_low"),
        F.col("annual_high").cast("bigint").alias("annual_high"), "annual_cost_low", "annual_cost_high",
    )


def recommendations(durations: DataFrame, overlap: DataFrame) -> DataFrame:
    """What to do with each scanner, from its duration tier and how far other monitoring covers it."""
    joined = durations.join(overlap, ["scanner_package_name", "scanner_name"], "left")
    covered, tier = F.coalesce("overlap", F.lit("NO")), duration_tier("avg_duration_sec")
    advice = (
        F.when(F.col("scanner_package_name") == FREE_PACKAGE_NAME, "KEEP")
        .when(covered == "YES", "DISABLE")
        .when((covered == "PARTIAL") & (tier == "HIGH"), "DISABLE IF MONITORED")
        .when(covered == "PARTIAL", "DISABLE")
        .when(tier == "LOW", "DISABLE, RARELY CHANGES")
        .otherwise("KEEP")
    )
    return joined.select(
        "scanner_package_name", "scanner_name", "avg_duration_sec", tier.alias("tier"), covered.alias("overlap"),
        advice.alias("recommendation"),
    )


def savings_plan(advice: DataFrame, daily_credits: Mapping[str, tuple] = PACKAGE_DAILY_CREDITS) -> DataFrame:
    """Scanners, seconds per run, and the credits a day (low and high) that each recommendation concerns.

    A package's credits a day are shared out over its scanners by their mean seconds.
    """
    prices = [F.struct(F.lit(p).alias("package"), *[F.lit(v).cast("decimal(9,4)").alias(n) for n, v in zip(("low", "high"), credits)])
              for p, credits in daily_credits.items()]
    package = F.upper(F.regexp_replace("scanner_package_name", " ", "_"))
    sums = advice.groupBy(package.alias("package"), "recommendation").agg(
        F.count(F.lit(1)).alias("scanners"), F.sum("avg_duration_sec").cast("decimal(28,1)").alias("seconds"))
    whole = sums.groupBy(F.col("package").alias("p")).agg(F.sum("seconds").alias("all_seconds"))
    priced = sums.join(whole, F.col("package") == F.col("p")).withColumn("price", F.try_element_at(
        F.map_from_arrays(F.array(*[x["package"] for x in prices]), F.array(*prices)), F.col("package")))
    part = F.try_divide(F.col("seconds").cast("double"), F.col("all_seconds").cast("double"))
    saved = lambda end: F.round(F.sum(F.coalesce(F.col(f"price.{end}").cast("double") * part, F.lit(0.0))), 4).cast("decimal(18,4)")
    return priced.groupBy("recommendation").agg(
        F.sum("scanners").alias("scanners"), F.sum("seconds").cast("decimal(28,1)").alias("seconds"),
        saved("low").alias("credits_low"), saved("high").alias("credits_high"))


# ---- schedules --------------------------------------------------------------------------------------------


# Lowest and highest value of the fields minute, hour, day of month, month, day of week (0 and 7 are Sunday).
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _part_values(part: Column, low: int, high: int) -> Column:
    """Values of one part of a field: a number, ``*``, a range ``a-b``, each with or without a step ``/n``. NULL if unreadable."""
    number = lambda group: F.regexp_extract(part, r"^(?:\*|(\d+)(?:-(\d+))?)(?:/(\d+))?$", group).try_cast("int")
    first = F.when(part.startswith("*"), low).otherwise(number(1))
    last = F.when(part.startswith("*"), high).otherwise(F.coalesce(number(2), F.when(number(3).isNotNull(), high).otherwise(number(1))))
    step = F.coalesce(number(3), F.lit(1))
    readable = part.rlike(r"^(\*|\d+(-\d+)?)(/\d+)?$") & (first >= low) & (last <= high) & (first <= last) & (step > 0)
    return F.when(readable, F.sequence(first, last, step))


def _field(schedule: Column, position: int) -> Column:
    """All values of a field of a schedule, NULL if it cannot be read."""
    fields = F.split(F.regexp_replace(schedule, r"^USING CRON\s+", ""), r"\s+")
    low, high = FIELDS[position]
    parts = F.transform(F.split(F.get(fields, position), ","), lambda part: _part_values(part, low, high))
    values = F.array_distinct(F.flatten(parts))
    # Five fields, and a time zone at most.
    return F.when(F.size(fields).between(5, 6), values)


def schedule_fields(schedules: DataFrame) -> DataFrame:
    """Each distinct schedule with the values of its five fields, and whether its day fields are free (``*``)."""
    distinct = schedules.where(F.col("schedule").isNotNull()).select("schedule").distinct()
    named = [_field(F.col("schedule"), k).alias(name) for k, name in enumerate(("minutes", "hours", "days", "months", "weekdays"))]
    text = F.split(F.regexp_replace("schedule", r"^USING CRON\s+", ""), r"\s+")
    return distinct.select("schedule", *named, F.get(text, 2).startswith("*").alias("any_day"), F.get(text, 4).startswith("*").alias("any_weekday"))


def _runs_on(date: Column) -> Column:
    """Whether a schedule with its fields in columns runs on a date. When both day fields are restricted, either one suffices."""
    week_day = F.dayofweek(date) - 1
    in_month = F.array_contains("days", F.dayofmonth(date))
    in_week = F.array_contains("weekdays", week_day) | ((week_day == 0) & F.array_contains("weekdays", 7))
    listed = F.when(F.col("any_day") | F.col("any_weekday"), in_month & in_week).otherwise(in_month | in_week)
    return listed & F.array_contains("months", F.month(date))


def run_days(schedules: DataFrame, first: Instant, last: Instant) -> DataFrame:
    """Days on which each distinct schedule runs, and the runs per day."""
    dates = schedule_fields(schedules).select("*", F.explode(F.sequence(day(first), day(last))).alias("run_day"))
    return dates.where(_runs_on(F.col("run_day"))).select("schedule", "run_day", (F.size("minutes") * F.size("hours")).alias("runs"))


def scheduled_runs(scanners: DataFrame, first: Instant, last: Instant) -> DataFrame:
    """Runs each enabled scanner is due for between two days: 0 without a schedule, NULL if it cannot be read.

    The fields of the few distinct schedules are read once, and the days are counted inside the row of each.
    """
    fields = schedule_fields(scanners)
    readable = (F.size("minutes") + F.size("hours") + F.size("days") + F.size("months") + F.size("weekdays")).isNotNull()
    days = F.size(F.filter(F.sequence(day(first), day(last)), _runs_on))
    known = fields.select("schedule", F.when(readable, days * F.size("minutes") * F.size("hours")).alias("runs"))
    return scanners.where(is_true("state")).join(known, "schedule", "left").select(
        "id", "scanner_package_id", "schedule", F.when(F.col("schedule").isNull(), 0).otherwise(F.col("runs")).cast("bigint").alias("runs")
    )


def expected_vs_actual_runs(scheduled: DataFrame, actual: DataFrame, days: int) -> DataFrame:
    """Scheduled against observed runs per day of each package; ``actual`` is the run rate of findings of the same days."""
    expected = scheduled.groupBy("scanner_package_id").agg(F.sum("runs").alias("scheduled_runs"))
    observed = actual.select(
        F.upper(F.regexp_replace("scanner_package_name", " ", "_")).alias("scanner_package_id"), "total_scan_runs", "runs_per_day"
    )
    per_day = F.round(F.col("scheduled_runs") / days, 1).cast("decimal(18,1)")
    return expected.join(observed, "scanner_package_id", "left").select(
        "scanner_package_id", "scheduled_runs", per_day.alias("scheduled_per_day"), "total_scan_runs", "runs_per_day"
    )
