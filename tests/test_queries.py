"""Every registered query against its SQL on the smallest tables, and against the plan rules."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from meterstone.operators import usage as u
from meterstone.plans import REGISTRY
from meterstone.plans.usage_queries import FIRST_DAY
from meterstone.sources.views import Views
from tests.conftest import plan_of, rows

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(tidy(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, checker, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = plan_of(df)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert banned not in plan
    columns = sorted(df.columns)
    got = sorted(repr(tuple(tidy(r[c]) for c in columns)) for r in df.collect())
    result = checker.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(tidy(r[i]) for i in order)) for r in result.fetchall())


def test_every_query_has_sql_and_every_item_a_query():
    assert set(REGISTRY) <= set(contract.queries()) and set(REGISTRY) <= set(contract.oracle_sql())
    covered = {item for q in REGISTRY.values() for item in q.covers}
    series = {"S": 21, "K": 4, "P": 18, "J": 10, "A": 40, "W": 4, "O": 7, "U": 5, "R": 9, "D": 13, "G": 7, "C": 4, "T": 9}
    wanted = {f"{letter}{n:02d}" for letter, last in series.items() for n in range(1, last + 1)}
    assert wanted - covered == set()


def test_flagship_runs(spark):
    assert contract.entry(spark).count() > 0


def test_large_user_table_is_shuffled_not_copied(spark):
    views = Views(spark, FOLDER)
    small = u.load_ai_functions(views.ai_usage, views.users, FIRST_DAY)
    assert "BroadcastHashJoin" in plan_of(small)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = u.load_ai_functions(views.ai_usage, views.users, FIRST_DAY)
        assert "BroadcastHashJoin" not in plan_of(large) and "SortMergeJoin" in plan_of(large)
        assert rows(large) == rows(small)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_known_to_differ_need_no_shuffle(spark):
    views = Views(spark, FOLDER)
    assert "Exchange" not in plan_of(u.ai_rows(views.ai_usage, FIRST_DAY, keep_copies=True))
    assert plan_of(u.ai_rows(views.ai_usage, FIRST_DAY)).count("Exchange hashpartitioning") <= 1


def test_report_sets(spark):
    from meterstone.plans import reports
    from meterstone.plans.governance_queries import SCAN_AS_OF

    v = Views(spark, FOLDER)
    sets = [
        reports.status_report(v.scanner_packages, v.scanners, v.findings, v.overview_metrics, SCAN_AS_OF),
        reports.validation(v.scanner_packages, v.scanners, v.findings, v.configuration_view, v.overview_metrics, SCAN_AS_OF),
        reports.switched_off_report(v.scanner_packages, v.scanners),
        reports.cost_check(v.findings, SCAN_AS_OF),
        reports.cost_estimate(v.scanner_packages, v.scanners, v.findings),
    ]
    assert all(frame.count() > 0 for frames in sets for frame in frames.values())


@pytest.mark.parametrize("name", ["load_analyst", "ai_by_user", "month_spend", "long_running", "summary_by_day", "runaway_detection"])
def test_time_bound_reaches_the_usage_scan(spark, name):
    pushed = [line for line in plan_of(contract.queries()[name](spark, FOLDER)).splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(ts,2024-01" in line for line in pushed)


def test_a_report_is_printed_whole(spark, capsys):
    from meterstone.sources.sinks import report_text

    report_text(spark.range(60))
    assert "|59 |" in capsys.readouterr().out
    report_text(spark.range(60), 50)
    assert "10 more rows" in capsys.readouterr().out


def test_month_spend_stops_at_the_moment_asked_for(spark):
    from decimal import Decimal

    from meterstone.operators import limits

    usage = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-05', 10BD), (TIMESTAMP '2024-01-25', 20BD), (TIMESTAMP '2024-02-02', 40BD) AS t(start_time, credits)")
    assert limits.month_spend(usage, "2024-01-15").first()[0] == Decimal(10)
