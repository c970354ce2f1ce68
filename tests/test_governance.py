import datetime as dt

import pytest

from meterstone.operators import governance as g
from tests.conftest import dec, rows, ts

AS_OF = dt.datetime(2024, 3, 31, 12)


@pytest.fixture
def packages(spark):
    data = [("SECURITY_ESSENTIALS", "Free", "TRUE"), ("CIS_BENCHMARKS", "Cis", "true"), ("THREAT_INTELLIGENCE", "Threat", None), ("X", "X", "FALSE")]
    return spark.createDataFrame([(i, n, s, "c", "p", None, None, None) for i, n, s in data],
                                 "id string, name string, state string, schedule string, provider string, notification string, "
                                 "last_enabled_timestamp timestamp, last_disabled_timestamp timestamp")


@pytest.fixture
def scanners(spark):
    data = [(1, "a", "TRUE", "SECURITY_ESSENTIALS"), (2, "b", "true", "CIS_BENCHMARKS"), (3, "c", None, "CIS_BENCHMARKS"),
            (4, "d", "FALSE", "X"), (5, "e", "True", "THREAT_INTELLIGENCE"), (6, "f", "TRUE", "GONE"), (7, "g", "TRUE", None)]
    return spark.createDataFrame([(i, n, "", s, "c", None, None, p) for i, n, s, p in data],
                                 "id bigint, name string, short_description string, state string, schedule string, notification string, "
                                 "last_scan_timestamp timestamp, scanner_package_id string")


FINDINGS = """event_id bigint, scanner_package_name string, scanner_name string, severity string, state string, total_at_risk_count bigint,
start_timestamp timestamp, end_timestamp timestamp, created_on timestamp"""


def finding(event, package="CIS Benchmarks", scanner="s", severity="HIGH", state="Open", risk=1, start="2024-03-30T00:00:00", seconds=5):
    begin = ts(start)
    end = None if seconds is None else begin + dt.timedelta(seconds=seconds)
    return (event, package, scanner, severity, state, risk, begin, end, begin)


def test_enabled_and_disabled_split_all_scanners(scanners, packages):
    on = {r.id for r in g.enabled_scanners(scanners, packages).collect()}
    off = {r.id for r in g.disabled_scanners(scanners, packages).collect()}
    assert on == {1, 2, 5, 6, 7} and off == {3, 4}
    assert rows(g.enabled_paid_scanners(scanners, packages), "id") == [(2,), (5,)]


def test_counts_put_unknown_packages_under_one_null_name(scanners, packages):
    counts = {r.package_name: (r.enabled, r.disabled, r.total) for r in g.scanner_counts(scanners, packages).collect()}
    assert counts == {"Free": (1, 0, 1), "Cis": (1, 1, 2), "X": (0, 1, 1), "Threat": (1, 0, 1), None: (2, 0, 2)}


def test_paid_package_checks(scanners, packages):
    assert rows(g.paid_package_count(packages)) == [(1,)]
    assert rows(g.orphan_scanners(scanners, packages)) == [(1,)]
    assert rows(g.free_package_health(scanners)) == [(1,)]
    assert rows(g.package_status(packages), "id") == [("CIS_BENCHMARKS",), ("THREAT_INTELLIGENCE",)]


def test_mismatch_ignores_null_on_either_side(spark):
    config = spark.createDataFrame(
        [("P", 1, "S", "ENABLED", "TRUE", "FALSE"), ("P", 2, "S", "ENABLED", None, "TRUE"), ("P", 3, "S", "ENABLED", "TRUE", None),
         ("P", 4, "S", "ENABLED", "TRUE", "TRUE"), ("P", 5, "S", "SCHEDULE", "a", "b")],
        "scanner_package_id string, scanner_id bigint, type string, configuration_name string, "
        "running_configuration_value string, set_configuration_value string")
    assert rows(g.config_mismatch(config), "scanner_id") == [(1,)]
    assert rows(g.config_running_enabled(config), "scanner_id") == [(1,), (3,), (4,)]
    assert g.list_config(config).count() == 4 and g.list_config(config, None).count() == 5


def test_open_findings_order_and_rules(spark):
    findings = spark.createDataFrame([
        finding(1, severity="low"), finding(2, severity="CRITICAL"), finding(3, severity="odd"), finding(4, severity="Medium", state=None),
        finding(5, severity="HIGH", state="RESOLVED"), finding(6, severity="HIGH", risk=0), finding(7, severity="high", state="OPEN"),
    ], FINDINGS)
    assert [r.severity for r in g.open_findings(findings).collect()] == ["CRITICAL", "high", "Medium", "low", "odd"]
    assert rows(g.findings_matrix(findings)) == [("CIS Benchmarks", 1, 1, 1, 1, 5, 5)]


def test_windows_include_their_lower_end_and_skip_the_free_package(spark):
    findings = spark.createDataFrame([
        finding(1, start="2024-03-01T12:00:00"), finding(2, start="2024-03-01T11:59:59"),
        finding(3, package="Security Essentials"), finding(4, package=None),
    ], FINDINGS)
    assert rows(g.paid_runs(findings, AS_OF), "run_count") == [(1,)]
    assert rows(g.distinct_paid_scanners(findings, AS_OF)) == [(1,)]
    assert rows(g.free_runs(findings, AS_OF), "run_count") == [(1,)]
    assert g.recently_active(findings, AS_OF).count() == 2


def test_run_rate_reproduces_the_known_figures(spark):
    def history(package, runs, days):
        first = ts("2023-01-01T00:00:00")
        return [finding(i, package, f"s{i % 3}", start=(first + dt.timedelta(days=days if i == 0 else (i - 1) % days)).isoformat()) for i in range(runs)]

    # 6547 runs in 132 days and 277 in 477 days are the published 49.6 and 0.6 runs per day.
    findings = spark.createDataFrame(
        history("CIS Benchmarks", 6547, 132) + history("Security Essentials", 277, 477) + [finding(1, "One day", seconds=None)], FINDINGS)
    rate = {r.scanner_package_name: (r.total_scan_runs, r.days_active, r.runs_per_day) for r in g.run_rate(findings).collect()}
    assert rate == {"CIS Benchmarks": (6547, 132, dec("49.6")), "Security Essentials": (277, 477, dec("0.6")), "One day": (1, 0, None)}


def test_durations_count_events_once_and_skip_unfinished(spark):
    findings = spark.createDataFrame([finding(1, seconds=3), finding(1, seconds=4), finding(2, seconds=None), finding(3, scanner="t", seconds=20)], FINDINGS)
    assert rows(g.scan_durations(findings), "scanner_name", "run_count", "avg_duration_sec") == [("s", 1, dec("3.5")), ("t", 1, dec("20.0"))]
    assert rows(g.cost_tier_share(g.scan_durations(findings)), "tier", "share") == [("HIGH", dec("0.8511")), ("LOW", dec("0.1489"))]


def test_health_and_validation(spark, packages, scanners):
    quiet = spark.createDataFrame([], FINDINGS)
    report = {r.check_name: (r.value, r.status) for r in g.health_check(packages, quiet, scanners, AS_OF).collect()}
    assert report == {"Paid packages enabled": (1, "FAIL - COST ALERT"), "Paid scanner runs (last 30d)": (0, "PASS"),
                      "Security Essentials active": (1, "WARN - CHECK SE")}
    config = spark.createDataFrame([], "scanner_package_id string, scanner_id bigint, type string, configuration_name string, "
                                       "running_configuration_value string, set_configuration_value string")
    validation = g.validation_report(packages, scanners, quiet, config, AS_OF)
    assert rows(g.issue_count(validation)) == [(2,)]


def test_state_diff_treats_equal_nulls_as_no_change(spark):
    before = spark.createDataFrame([(1, None), (2, "TRUE"), (3, "TRUE")], "id bigint, state string")
    after = spark.createDataFrame([(1, None), (2, None), (4, "TRUE")], "id bigint, state string")
    assert rows(g.state_diff(before, after, "id", ["state"]), "id", "change") == [(2, "changed"), (3, "removed"), (4, "added")]


def test_notifications_newest_first(spark):
    history = spark.createDataFrame([("P", i, ts(f"2024-01-{i:02d}"), "n", "SENT", None) for i in range(1, 26)],
                                    "scanner_package_id string, scanner_id bigint, sent_on timestamp, "
                                    "notification_integration_name string, status string, error_message string")
    assert [r.scanner_id for r in g.list_notifications(history).collect()] == list(range(25, 5, -1))
    assert g.list_notifications(history, None).count() == 25
