import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterstone.functions.time import cutoff_date
from meterstone.operators import usage as u
from tests.conftest import dec, rows, ts

USAGE = """start_time timestamp, end_time timestamp, function_name string, model_name string, query_id string, warehouse_id bigint,
credits decimal(38,6), is_completed boolean, user_id bigint, metrics array<struct<key:struct<metric:string>,value:bigint>>"""
DAY = dt.date(2024, 1, 1)


def metric(name, value):
    return {"key": {"metric": name}, "value": value}


def row(hour="2024-01-02T10:00:00", query="q1", user=1, credits=1, model="m", metrics=None, hours=1):
    start = ts(hour)
    return (start, start + dt.timedelta(hours=hours), "f", model, query, 7, dec(credits), True, user, metrics)


def usage(spark, *data):
    return spark.createDataFrame(list(data), USAGE)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "ann"), (4, None), (5, "")], "user_id bigint, name string")


def tokens(df):
    return rows(df, "query_id", "input_tokens", "output_tokens")


def test_tokens_fall_back_to_total_then_zero(spark, users):
    loaded = u.load_ai_functions(usage(
        spark,
        row(query="both", metrics=[metric("input", 3), metric("output", 4), metric("total", 7)]),
        row(query="total", metrics=[metric("total", 9)]),
        row(query="null", metrics=None), row(query="empty", metrics=[]),
        row(query="largest", metrics=[metric("input", 3), metric("input", 8)]),
        row(query="nullvalue", metrics=[metric("input", None)]),
    ), users, DAY)
    assert tokens(loaded) == [("both", 3, 4), ("empty", 0, 0), ("largest", 8, 0), ("null", 0, 0), ("nullvalue", 0, 0), ("total", 9, 0)]


def test_equal_rows_collapse_and_differing_metrics_merge(spark, users):
    data = usage(spark, row(metrics=[metric("input", 3)]), row(metrics=[metric("output", 5)]), row())
    assert tokens(u.load_ai_functions(data, users, DAY)) == [("q1", 3, 5)]
    assert u.load_ai_functions(data, users, DAY, keep_copies=True).count() == 3


def test_cutoff_day_is_included(spark, users):
    data = usage(spark, row("2024-01-01T00:00:00", "on"), row("2023-12-31T23:59:59", "before"))
    assert [r[0] for r in tokens(u.load_ai_functions(data, users, DAY))] == ["on"]
    assert cutoff_date(dt.date(2024, 1, 31), 30) == DAY
    for bad in (0, 366):
        with pytest.raises(ValueError):
            cutoff_date(DAY, bad)


def test_unknown_users_keep_a_null_name(spark, users):
    loaded = u.load_ai_functions(usage(spark, row(user=9), row(user=1), row(user=4)), users, DAY)
    assert rows(loaded, "username") == [("ann",), (None,), (None,)]


def test_per_user_sums_join_names_late_and_drop_null(spark, users):
    data = u.ai_rows(usage(spark, row(user=1, query="a"), row(user=3, query="a"), row(user=2, query="b"), row(user=9, query="c")), DAY)
    assert rows(u.credits_by_named_user(data, users)) == [("ann", dec("2.000000")), ("bob", dec("1.000000"))]
    # Two ids with one name share the query: it counts once.
    assert rows(u.ai_by_user(data, users), "username", "queries") == [("ann", 1), ("bob", 1)]
    assert rows(u.ai_kpi_row(data, users), "unique_users") == [(2,)]
    assert rows(u.ai_by_model_and_user(data, users), "username", "credits") == [
        ("ann", dec("2.000000")), ("bob", dec("1.000000")), (None, dec("1.000000"))
    ]


def test_metrics_from_text_and_variant(spark):
    text = spark.createDataFrame([('[{"key":{"metric":"input"},"value":3}]',), ("[]",), (None,), ("{}",)], "t string")
    parsed = text.select(u.parse_metrics("t").alias("a"), F.try_parse_json("t").alias("v"))
    parsed = parsed.withColumn("b", u.metrics_of_variant("v"))
    both = parsed.select(u.metric_value("a", "input").alias("a"), u.metric_value("b", "input").alias("b"))
    assert rows(both) == [(3, 3), (None, None), (None, None), (None, None)]


def services(spark, *data):
    return spark.createDataFrame(list(data), "service string, start_time timestamp, credits decimal(38,6)")


def test_price_classes_and_unknown_service(spark):
    data = services(spark, ("analyst", ts("2024-01-01"), dec(10)), ("agents", ts("2024-01-01"), dec(10)), ("other", ts("2024-01-01"), dec(10)))
    assert rows(u.blended_cost(data)) == [(dec("30.000000"), dec("88.00000000"))]
    assert rows(u.blended_cost(data, {"ai": Decimal("2.20")}), "total_cost") == [(dec("90.00000000"),)]


def test_share_is_rounded_half_even_as_fraction(spark):
    # 1/400 and 3/400 of the cost are 0.25 and 0.75 percent: half-even gives 0.2 and 0.8.
    data = services(spark, ("analyst", ts("2024-01-01"), dec(1)), ("search", ts("2024-01-01"), dec(3)),
                    ("ai_functions", ts("2024-01-01"), dec(396)), ("agents", ts("2024-01-01"), dec(0)))
    assert rows(u.service_breakdown(data), "service", "share") == [
        ("ai_functions", dec("0.990")), ("analyst", dec("0.002")), ("search", dec("0.008"))
    ]


def test_empty_usage_sums_to_zero(spark):
    empty = services(spark)
    assert rows(u.total_credits(empty)) == [(dec("0.000000"),)]
    assert rows(u.blended_cost(empty)) == [(dec("0.000000"), dec("0E-8"))]
    assert rows(u.service_breakdown(empty)) == []


def test_long_running_needs_two_windows_and_keeps_null_names(spark, users):
    data = usage(
        spark, row("2024-01-02T10:00:00", "two", 9), row("2024-01-02T12:00:00", "two", 9), row(query="one"),
        row("2024-01-02T10:00:00", "shared", 1), row("2024-01-02T11:00:00", "shared", 3),
    )
    found = u.long_running(data, users, DAY)
    assert rows(found, "query_id", "username", "window_count", "duration_minutes") == [("shared", "ann", 2, 120), ("two", None, 2, 180)]
    assert rows(u.long_running_kpis(found, 180), "queries", "max_duration_minutes") == [(1, 180)]
    assert rows(u.long_running_kpis(found, 181)) == [(0, dec("0.000000"), None, dec("0E-8"))]
    assert rows(u.long_running_by(found, 5, "username")) == [("ann", dec("2.000000"))]


def test_histogram_covers_every_query(spark):
    found = spark.createDataFrame([(m,) for m in list(range(5, 105)) + [5, 5]], "duration_minutes bigint")
    bins = u.duration_histogram(found, 5)
    assert sum(r.queries for r in bins.collect()) == 102
    assert bins.count() <= 20
    one = u.duration_histogram(found.where("duration_minutes = 5"), 5)
    assert rows(one) == [(5, 6, 3)]


def test_summary_by_day_reports_tokens_only_when_counted(spark):
    data = services(spark, ("agents", ts("2024-01-01"), dec(1)), ("agents", ts("2024-01-02"), dec(2)))
    assert u.summary_by_day(data).columns == ["usage_day", "credits"]
    with_tokens = u.summary_by_day(data.withColumn("tokens", F.lit(4)))
    assert [r.usage_day.day for r in with_tokens.collect()] == [2, 1]
    assert with_tokens.columns == ["usage_day", "credits", "tokens"]


def test_list_users_skips_null_and_blank(spark, users):
    assert rows(u.list_users(users)) == [("ann",), ("ann",), ("bob",)]
