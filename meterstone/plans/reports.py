"""Named sets of frames that are read together: the status, validation and cost reports of the scanners."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterstone.functions.time import Instant
from meterstone.operators import costmodel
from meterstone.operators import governance as g


def status_report(
    packages: DataFrame, scanners: DataFrame, findings: DataFrame, metrics: DataFrame, as_of: Instant
) -> dict[str, DataFrame]:
    return {
        "packages": g.list_packages(packages),
        "scanner counts": g.scanner_counts(scanners, packages),
        "open findings": g.open_findings(findings),
        "readiness": g.overview_metrics(metrics),
        "active in 7 days": g.recently_active(findings, as_of),
    }


def validation(
    packages: DataFrame, scanners: DataFrame, findings: DataFrame, config: DataFrame, metrics: DataFrame, as_of: Instant
) -> dict[str, DataFrame]:
    """The checks and their issue count, with the rows behind each warning."""
    report = g.validation_report(packages, scanners, findings, config, as_of)
    return {
        "checks": report,
        "issues": g.issue_count(report),
        "paid packages": g.paid_packages(packages),
        "paid scanners run": g.paid_recently_active(findings, as_of),
        "mismatches": g.config_mismatch(config),
        "readiness": g.overview_metrics(metrics),
    }


def switched_off_report(packages: DataFrame, scanners: DataFrame) -> dict[str, DataFrame]:
    """Whether everything that costs credits is off."""
    return {
        "paid packages": g.package_status(packages),
        "paid scanners still on": g.enabled_paid_scanners(scanners, packages),
        "free scanners on": g.free_package_scanners(scanners, enabled_only=True),
    }


def cost_check(findings: DataFrame, as_of: Instant) -> dict[str, DataFrame]:
    return {"paid runs": g.paid_runs(findings, as_of), "free runs": g.free_runs(findings, as_of)}


def cost_estimate(packages: DataFrame, scanners: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    return {
        "run rate": g.run_rate(findings),
        "slowest scanners": g.avg_scan_duration(findings),
        "scenarios": costmodel.scenario_cost(costmodel.package_share(scanners)),
        "paid packages on": g.paid_packages(packages),
        "paid packages on, count": g.paid_package_count(packages),
    }
