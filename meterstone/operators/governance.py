"""Scanner inventory, configuration, findings and run activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.fixed_values import (
    CIS_PACKAGE_ID, FREE_PACKAGE_ID, FREE_PACKAGE_NAME, FREE_PACKAGE_SCANNERS, HEALTH_FREE_PACKAGE, HEALTH_PAID_PACKAGES,
    HEALTH_PAID_RUNS, SEVERITIES, THREAT_PACKAGE_ID,
)
from meterstone.functions.predicates import (
    duration_tier, is_not_true, is_open_finding, is_true, is_true_or_false, severity_rank,
)
from meterstone.functions.time import Instant, days_between_marks, instant, seconds_between_marks, within

# ---- inventory ---------------------------------------------------------------------------------


def list_packages(packages: DataFrame) -> DataFrame:
    return packages.select(
        "id", "name", "state", "schedule", "notification", "provider", "last_enabled_timestamp", "last_disabled_timestamp"
    ).orderBy(F.col("name").asc_nulls_last())


def with_package(scanners: DataFrame, packages: DataFrame, how: str = "left") -> DataFrame:
    """Scanners with the name and state of their package. Packages are few, so Spark copies them to each task."""
    named = packages.select(
        F.col("id").alias("scanner_package_id"), F.col("name").alias("package_name"), F.col("state").alias("package_state")
    )
    return scanners.join(named, "scanner_package_id", how)


def _by_package_and_name(df: DataFrame) -> DataFrame:
    """By package and name, then id: the id lets several tasks sort a package with very many scanners."""
    return df.orderBy(F.col("package_name").asc_nulls_last(), F.col("scanner_name").asc_nulls_last(), "id")


def list_scanners(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    return _by_package_and_name(with_package(scanners, packages).select(
        "id", F.col("name").alias("scanner_name"), "short_description", "state", "schedule", "notification",
        "last_scan_timestamp", "package_name",
    ))


def enabled_scanners(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    return _by_package_and_name(with_package(scanners.where(is_true("state")), packages).select(
        "id", F.col("name").alias("scanner_name"), "short_description", "schedule", "last_scan_timestamp", "package_name"
    ))


def disabled_scanners(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    return _by_package_and_name(with_package(scanners.where(is_not_true("state")), packages).select(
        "id", F.col("name").alias("scanner_name"), "short_description", "package_name", "package_state"
    ))


def enabled_in_known_packages(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    """Enabled scanners of packages that exist (a scanner with an unknown package is left out)."""
    return _by_package_and_name(with_package(scanners.where(is_true("state")), packages, "inner").select(
        "id", F.col("name").alias("scanner_name"), "state", "schedule", "package_name"
    ))


def enabled_paid_scanners(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    """Enabled scanners outside the free package."""
    kept = scanners.where(is_true("state") & (F.col("scanner_package_id") != FREE_PACKAGE_ID))
    return _by_package_and_name(with_package(kept, packages, "inner").select(
        "id", F.col("name").alias("scanner_name"), "state", "package_name"
    ))


def free_package_scanners(scanners: DataFrame, enabled_only: bool = False) -> DataFrame:
    kept = scanners.where(F.col("scanner_package_id") == FREE_PACKAGE_ID)
    if enabled_only:
        kept = kept.where(is_true("state"))
    return kept.select("id", "name", "state", "schedule").orderBy("name")


def package_status(packages: DataFrame, package_ids: tuple[str, ...] = (CIS_PACKAGE_ID, THREAT_PACKAGE_ID)) -> DataFrame:
    return packages.where(F.col("id").isin(*package_ids)).select("id", "name", "state", "schedule")


def enabled_in_package(scanners: DataFrame, package_id: str) -> DataFrame:
    """Scanners of one package that are still on (none expected after the package was switched off)."""
    return scanners.where((F.col("scanner_package_id") == package_id) & is_true("state")).select("id", "name", "state")


def scanner_counts(scanners: DataFrame, packages: DataFrame, by_state: bool = True) -> DataFrame:
    """Enabled, disabled and all scanners per package, counted before the package is looked up."""
    counted = scanners.groupBy("scanner_package_id").agg(
        F.count_if(is_true("state")).alias("enabled"),
        F.count_if(is_not_true("state")).alias("disabled"),
        F.count(F.lit(1)).alias("total"),
    )
    keys = ["package_name", "package_state"] if by_state else ["package_name"]
    sums = [F.sum(c).alias(c) for c in ("enabled", "disabled", "total")]
    return with_package(counted, packages).groupBy(*keys).agg(*sums).orderBy(F.col("package_name").asc_nulls_last())


# ---- configuration -------------------------------------------------------------------------------


def list_config(config: DataFrame, name: str | None = "ENABLED") -> DataFrame:
    """Running and set values; all configuration names when ``name`` is None."""
    kept = config if name is None else config.where(F.col("configuration_name") == name)
    return kept.select(
        "scanner_package_id", "scanner_id", "type", "configuration_name",
        "running_configuration_value", "set_configuration_value",
    ).orderBy("scanner_package_id", "scanner_id", "configuration_name")


def config_running_enabled(config: DataFrame) -> DataFrame:
    kept = config.where((F.col("configuration_name") == "ENABLED") & is_true("running_configuration_value"))
    return kept.select(
        "scanner_package_id", "scanner_id", "configuration_name", "running_configuration_value"
    ).orderBy("scanner_package_id", "scanner_id")


def config_mismatch(config: DataFrame) -> DataFrame:
    """Settings not yet in effect. A row with a NULL on either side does not count."""
    running, wanted = F.col("running_configuration_value"), F.col("set_configuration_value")
    return config.where((F.col("configuration_name") == "ENABLED") & (running != wanted)).select(
        "scanner_package_id", "scanner_id", "configuration_name", running, wanted
    )


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def list_notifications(history: DataFrame, n: int | None = 20) -> DataFrame:
    """Newest notifications; all of them when ``n`` is None."""
    rows = history.select(
        "scanner_package_id", "scanner_id", "sent_on", "notification_integration_name", "status", "error_message"
    ).orderBy(F.col("sent_on").desc_nulls_last(), "scanner_package_id", "scanner_id")
    return rows if n is None else rows.limit(n)


def overview_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric_name", "value")


# ---- findings ---------------------------------------------------------------------------------------


def open_findings(findings: DataFrame) -> DataFrame:
    counted = findings.where(is_open_finding()).groupBy("scanner_package_name", "severity").agg(
        F.count(F.lit(1)).alias("finding_count")
    )
    return counted.orderBy(F.col("scanner_package_name").asc_nulls_last(), severity_rank("severity"), "severity")


def findings_matrix(findings: DataFrame) -> DataFrame:
    """Open findings per package: one column per severity, their total and the entities at risk."""
    opened = findings.where(is_open_finding()).withColumn("level", F.upper("severity"))
    counts = [F.count_if(F.col("level") == name).alias(name.lower()) for name in SEVERITIES]
    return opened.groupBy("scanner_package_name").agg(
        *counts, F.count(F.lit(1)).alias("total"), F.sum("total_at_risk_count").alias("at_risk_entities")
    ).orderBy("scanner_package_name")


def findings_totals(findings: DataFrame) -> DataFrame:
    """Open findings and entities at risk per package and severity, per package, per severity and in all, in one pass.

    ``level`` tells what a row sums up: 0 one package and severity, 1 a package, 2 a severity, 3 everything.
    """
    opened = findings.where(is_open_finding()).select("scanner_package_name", F.upper("severity").alias("severity"), "total_at_risk_count")
    keys = [F.col("scanner_package_name"), F.col("severity")]
    sets = [keys, keys[:1], keys[1:], []]
    return opened.groupingSets(sets, *keys).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("total"), F.sum("total_at_risk_count").alias("at_risk_entities"))


def recent_findings_by_package(findings: DataFrame, as_of: Instant, days: int = 7) -> DataFrame:
    recent = findings.where(within("created_on", as_of, days=days))
    return recent.groupBy("scanner_package_name").agg(F.count(F.lit(1)).alias("recent_findings")).orderBy(
        F.col("recent_findings").desc()
    )


# ---- scan activity --------------------------------------------------------------------------------------


def is_paid() -> Column:
    """Package other than the free one; a NULL package name is not counted as paid."""
    return F.col("scanner_package_name") != FREE_PACKAGE_NAME


def recently_active(findings: DataFrame, as_of: Instant, days: int = 7) -> DataFrame:
    return _last_runs(findings.where(within("start_timestamp", as_of, days=days)))


def paid_recently_active(findings: DataFrame, as_of: Instant, days: int = 30) -> DataFrame:
    return _last_runs(findings.where(is_paid() & within("start_timestamp", as_of, days=days)))


def _last_runs(findings: DataFrame) -> DataFrame:
    last = findings.groupBy("scanner_package_name", "scanner_name").agg(F.max("start_timestamp").alias("last_run"))
    return last.orderBy(F.col("last_run").desc_nulls_last())


def paid_runs(findings: DataFrame, as_of: Instant, days: int = 30) -> DataFrame:
    runs = findings.where(is_paid() & within("start_timestamp", as_of, days=days))
    return runs.groupBy("scanner_package_name", "scanner_name").agg(
        F.count(F.lit(1)).alias("run_count"), F.min("start_timestamp").alias("first_run"),
        F.max("start_timestamp").alias("last_run"),
    ).orderBy(F.col("run_count").desc())


def free_runs(findings: DataFrame, as_of: Instant, days: int = 30) -> DataFrame:
    runs = findings.where((F.col("scanner_package_name") == FREE_PACKAGE_NAME) & within("start_timestamp", as_of, days=days))
    return runs.groupBy("scanner_name").agg(
        F.count(F.lit(1)).alias("run_count"), F.max("start_timestamp").alias("last_run")
    ).orderBy(F.col("last_run").desc_nulls_last())


def distinct_paid_scanners(findings: DataFrame, as_of: Instant, days: int = 30) -> DataFrame:
    runs = findings.where(is_paid() & within("start_timestamp", as_of, days=days))
    return runs.agg(F.count_distinct("scanner_name").alias("scanners"))


def paid_runs_after_change(findings: DataFrame, as_of: Instant, days: int = 1) -> DataFrame:
    runs = findings.where(is_paid() & within("start_timestamp", as_of, days=days))
    return runs.groupBy("scanner_package_name").agg(
        F.count(F.lit(1)).alias("runs"), F.max("start_timestamp").alias("last_run")
    )


def paid_scan_log(findings: DataFrame, as_of: Instant, days: int = 30, n: int = 20) -> DataFrame:
    runs = findings.where(is_paid() & within("start_timestamp", as_of, days=days))
    return runs.select("scanner_package_name", "scanner_name", "start_timestamp", "end_timestamp").orderBy(
        F.col("start_timestamp").desc_nulls_last(), "scanner_package_name", "scanner_name", F.col("end_timestamp").desc_nulls_last()
    ).limit(n)


def run_rate(findings: DataFrame) -> DataFrame:
    """Scanners, scan runs, active days and runs per day of each package; no rate when active for a day only."""
    package = "scanner_package_name"
    span = [F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run")]
    events = findings.groupBy(package, "event_id", "scanner_name").agg(
        F.min("start_timestamp").alias("first_run"), F.max("start_timestamp").alias("last_run"))
    # Both distinct counts are plain counts of groups, so no finding is multiplied.
    runs = events.groupBy(package, "event_id").agg(*span).groupBy(package).agg(F.count("event_id").alias("total_scan_runs"), *span)
    scanners = events.groupBy(package, "scanner_name").agg(F.lit(1)).groupBy(F.col(package).alias("package")).agg(
        F.count("scanner_name").alias("distinct_scanners"))
    rows = runs.join(scanners, F.col(package).eqNullSafe(F.col("package"))).select(
        package, "distinct_scanners", "total_scan_runs", "first_run", "last_run")
    days = days_between_marks(F.col("first_run"), F.col("last_run"))
    rate = F.round(F.try_divide(F.col("total_scan_runs"), F.col("days_active")), 1).cast("decimal(18,1)")
    return rows.withColumn("days_active", days).withColumn("runs_per_day", rate).orderBy(F.col("total_scan_runs").desc())


def scan_durations(findings: DataFrame) -> DataFrame:
    """Distinct runs, mean seconds and last run of every scanner with finished scans."""
    finished = findings.where(F.col("start_timestamp").isNotNull() & F.col("end_timestamp").isNotNull())
    seconds = seconds_between_marks(F.col("start_timestamp"), F.col("end_timestamp"))
    return finished.groupBy("scanner_package_name", "scanner_name").agg(
        F.count_distinct("event_id").alias("run_count"),
        F.round(F.avg(seconds), 1).cast("decimal(18,1)").alias("avg_duration_sec"),
        F.max("start_timestamp").alias("last_run"),
    )


def avg_scan_duration(findings: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` scanners that take longest."""
    return scan_durations(findings).orderBy(
        F.col("avg_duration_sec").desc(), "scanner_package_name", "scanner_name"
    ).limit(n)


def cost_tier_share(durations: DataFrame) -> DataFrame:
    """Scanners and seconds per duration tier, with the tier's share of all seconds."""
    tiers = durations.groupBy(duration_tier("avg_duration_sec").alias("tier")).agg(
        F.count(F.lit(1)).alias("scanners"), F.sum("avg_duration_sec").cast("decimal(28,1)").alias("seconds")
    )
    # The window holds the three tiers.
    whole = F.sum("seconds").over(Window.partitionBy())
    share = F.round(F.try_divide(F.col("seconds").cast("double"), whole.cast("double")), 4).cast("decimal(9,4)")
    return tiers.withColumn("share", share)


# ---- checks ---------------------------------------------------------------------------------------------


def paid_packages(packages: DataFrame) -> DataFrame:
    """Packages that are on and cost credits; a NULL state reads as off."""
    return packages.where(is_true_or_false("state") & (F.col("id") != FREE_PACKAGE_ID)).select("id", "name", "state", "schedule")


def paid_package_count(packages: DataFrame) -> DataFrame:
    return count_rows(paid_packages(packages), "paid_packages")


def orphan_scanners(scanners: DataFrame, packages: DataFrame) -> DataFrame:
    """Number of enabled scanners whose package, other than the free one, is off."""
    enabled = scanners.where(is_true("state") & (F.col("scanner_package_id") != FREE_PACKAGE_ID))
    return count_rows(with_package(enabled, packages, "inner").where(is_not_true("package_state")), "orphans")


def free_package_health(scanners: DataFrame) -> DataFrame:
    enabled = scanners.where((F.col("scanner_package_id") == FREE_PACKAGE_ID) & is_true("state"))
    return count_rows(enabled, "enabled")


def health_check(packages: DataFrame, findings: DataFrame, scanners: DataFrame, as_of: Instant) -> DataFrame:
    """Three checks with a value and a verdict each; each table is read once."""
    parts = [
        (paid_package_count(packages), HEALTH_PAID_PACKAGES, 0),
        (distinct_paid_scanners(findings, as_of), HEALTH_PAID_RUNS, 0),
        (free_package_health(scanners), HEALTH_FREE_PACKAGE, FREE_PACKAGE_SCANNERS),
    ]
    rows = [
        counted.select(
            F.lit(label).alias("check_name"), F.col(counted.columns[0]).alias("value"),
            F.when(F.col(counted.columns[0]) == expected, "PASS").otherwise(otherwise).alias("status"),
        )
        for counted, (label, otherwise), expected in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def validation_report(
    packages: DataFrame, scanners: DataFrame, findings: DataFrame, config: DataFrame, as_of: Instant
) -> DataFrame:
    """The checks run after a change. ``is_issue`` marks a value that needs attention."""
    checks = [
        (paid_package_count(packages), "paid packages enabled", True),
        (orphan_scanners(scanners, packages), "enabled scanners in disabled packages", True),
        (free_package_health(scanners), "free package scanners enabled", False),
        (distinct_paid_scanners(findings, as_of), "paid scanners run in 30 days", True),
        (count_rows(config_mismatch(config)), "configuration mismatches", True),
    ]
    report = None
    for counted, label, counts_as_issue in checks:
        value = F.col(counted.columns[0])
        row = counted.select(
            F.lit(label).alias("check_name"), value.alias("value"),
            ((value > 0) if counts_as_issue else F.lit(False)).alias("is_issue"),
        )
        report = row if report is None else report.unionByName(row)
    return report


def issue_count(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("is_issue").alias("issues"))


# ---- state before and after a change -----------------------------------------------------------------------


def state_snapshot(scanners: DataFrame, packages: DataFrame, as_of: Instant) -> DataFrame:
    """Scanner and package states at one time, to be kept for a rollback."""
    package = packages.select(
        F.col("id").alias("pkg_id"), F.col("name").alias("pkg_name"), F.col("state").alias("pkg_state")
    )
    joined = scanners.join(package, F.col("scanner_package_id") == F.col("pkg_id"), "left")
    return joined.select(
        F.col("id").alias("scanner_id"), F.col("name").alias("scanner_name"), "state", "schedule", "notification",
        "pkg_id", "pkg_name", "pkg_state", instant(as_of).alias("snapshot_time"),
    )


def state_diff(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Rows added, removed or changed between two states. Equal NULLs are no change."""
    old, new = before.alias("old"), after.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    differs = F.lit(False)
    for column in compared:
        differs = differs | ~F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))
    change = (
        F.when(F.col(f"old.{key}").isNull(), "added").when(F.col(f"new.{key}").isNull(), "removed").when(differs, "changed")
    )
    values = [F.col(f"{side}.{c}").alias(f"{c}_{label}") for c in compared for side, label in (("old", "before"), ("new", "after"))]
    return joined.select(
        F.coalesce(f"old.{key}", f"new.{key}").alias(key), change.alias("change"), *values
    ).where(F.col("change").isNotNull())
