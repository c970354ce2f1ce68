import pytest

from meterstone.operators import costmodel as m
from tests.conftest import dec, rows


def shares(spark, cis, threat):
    data = [("SECURITY_ESSENTIALS", dec(1)), ("CIS_BENCHMARKS", dec(cis)), ("THREAT_INTELLIGENCE", dec(threat))]
    return spark.createDataFrame(data, "scanner_package_id string, share decimal(9,6)")


def test_everything_on_reproduces_the_published_ranges(spark):
    cost = {r.scenario: r for r in m.scenario_cost(shares(spark, 1, 1)).collect()}
    full = cost["everything daily"]
    assert (full.monthly_low, full.monthly_high) == (dec("21.000000"), dec("105.000000"))
    assert (full.annual_low, full.annual_high) == (255, 1278)
    assert (full.annual_cost_low, full.annual_cost_high) == (dec("765.00"), dec("3834.00"))
    assert cost["CIS weekly, threat daily"].monthly_low == dec("8.000000")
    assert cost["both off"].annual_cost_high == 0


def test_disabled_packages_cost_nothing(spark):
    assert {r.annual_high for r in m.scenario_cost(shares(spark, 0, 0)).collect()} == {0}


def test_recommendations(spark):
    durations = spark.createDataFrame([("CIS Benchmarks", n, dec(s)) for n, s in
                                       [("yes", 50.6), ("part_high", 18.7), ("part_low", 10.8), ("no_low", 3.2), ("no_high", 17.0), ("unlisted", 5.9)]]
                                      + [("Security Essentials", "free", dec(60))],
                                      "scanner_package_name string, scanner_name string, avg_duration_sec decimal(18,1)")
    listed = [("yes", "YES"), ("part_high", "PARTIAL"), ("part_low", "PARTIAL"), ("no_low", "NO"), ("no_high", "NO"), ("free", "YES")]
    overlap = spark.createDataFrame([("CIS Benchmarks", *pair) for pair in listed] + [("Threat Intelligence", "no_high", "YES")],
                                    "scanner_package_name string, scanner_name string, overlap string")
    advice = m.recommendations(durations, overlap)
    assert rows(advice, "scanner_name", "recommendation") == [
        ("free", "KEEP"), ("no_high", "KEEP"), ("no_low", "DISABLE, RARELY CHANGES"), ("part_high", "DISABLE IF MONITORED"),
        ("part_low", "DISABLE"), ("unlisted", "DISABLE, RARELY CHANGES"), ("yes", "DISABLE")]
    plan = m.savings_plan(advice).collect()
    assert sum(r.scanners for r in plan) == 7
    assert abs(sum(r.credits_low for r in plan) - dec("0.5")) < dec("0.001") and abs(sum(r.credits_high for r in plan) - dec("2")) < dec("0.001")


def days(spark, schedule, first="2024-01-01", last="2024-01-31"):
    found = m.run_days(spark.createDataFrame([(schedule,), (schedule,), (None,)], "schedule string"), first, last)
    return sorted(r.run_day.day for r in found.collect())


def test_schedules(spark):
    assert len(days(spark, "USING CRON 16 8 * * * UTC")) == 31
    assert days(spark, "0 6 * * 1") == [1, 8, 15, 22, 29]
    assert days(spark, "0 6 * * 7") == days(spark, "0 6 * * 0") == [7, 14, 21, 28]
    assert days(spark, "USING CRON 0 6 9,24 * * UTC") == [9, 24]
    assert days(spark, "0 6 1 * 3") == [1, 3, 10, 17, 24, 31]
    assert days(spark, "0 6 1 1 *") == [1] and days(spark, "0 6 * 2 *") == [] and days(spark, "0 6 */10 * *") == [1, 11, 21, 31]
    assert days(spark, "0 6 * * MON-FRI") == []


@pytest.mark.parametrize("schedule, runs", [
    ("0 6,18 * * *", 62), ("0 * * * *", 744), ("0 6 1 1 *", 0), ("*/20 8-10 * * 1-5", 9 * 22), ("16 8 * * *", 31), ("0 6 * * MON-FRI", None),
    ("61 6 * * *", None), ("0 6 * *", None), ("0 10-8 * * *", None), ("USING CRON 5/10 0 1-7/3 7 * UTC", 18),
])
def test_runs_of_a_month(spark, schedule, runs):
    scanners = spark.createDataFrame([(1, "P", "TRUE", schedule)], "id bigint, scanner_package_id string, state string, schedule string")
    assert rows(m.scheduled_runs(scanners, "2001-07-01", "2001-07-31"), "runs") == [(runs,)]


def test_only_enabled_scanners_are_due(spark):
    scanners = spark.createDataFrame([(1, "P", "TRUE", "0 6 * * *"), (2, "P", None, "0 6 * * *"), (3, "P", "true", None)],
                                     "id bigint, scanner_package_id string, state string, schedule string")
    assert rows(m.scheduled_runs(scanners, "2024-01-01", "2024-01-10"), "id", "runs") == [(1, 10), (3, 0)]
