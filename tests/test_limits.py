import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterstone.operators import limits as m
from tests.conftest import dec, rows, ts

USAGE = "query_id string, user_id bigint, function_name string, model_name string, credits decimal(38,6), is_completed boolean, start_time timestamp"
ACCESS = """user_name string, user_id bigint, granted_at timestamp, monthly_credit_limit decimal(38,6), is_active boolean,
revoked_at timestamp, revocation_reason string"""
AS_OF = dt.datetime(2024, 1, 31, 12)


def usage(spark, *data):
    return spark.createDataFrame([(q, u, "f", "m", dec(c), done, ts(t)) for q, u, c, done, t in data], USAGE)


def state(spark, *data):
    return spark.createDataFrame(list(data), "alert_name string, alert_month date")


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "ann"), (2, "bob"), (8, "cat"), (7, "cat")], "user_id bigint, name string")


@pytest.fixture
def access(spark):
    old = ts("2023-01-01")
    return spark.createDataFrame([
        ("ann", 1, old, dec(10), True, None, None), ("bob", 2, old, dec(10), True, None, None),
        ("off", 3, old, dec(1), False, old, "Monthly limit exceeded"), ("idle", 4, old, dec(0), True, None, None),
        ("unset", 5, old, dec(1), None, None, None),
    ], ACCESS)


def test_month_spend_counts_from_the_first_instant(spark):
    data = usage(spark, ("a", 1, 5, True, "2024-01-01T00:00:00"), ("b", 1, 7, True, "2023-12-31T23:59:59"))
    assert rows(m.month_spend(data, AS_OF)) == [(dec("5.000000"),)]
    assert m.month_spend_exceeds(data, AS_OF, Decimal(4)).count() == 1
    assert m.month_spend_exceeds(data, AS_OF, Decimal(5)).count() == 0
    empty = usage(spark)
    assert rows(m.month_spend(empty, AS_OF)) == [(dec("0.000000"),)]
    assert m.month_spend_exceeds(empty, AS_OF, Decimal(-1)).count() == 0


@pytest.mark.parametrize("sent,threshold,verdict", [
    (("monthly_spend", dt.date(2024, 1, 1)), 1, "already sent"), (("monthly_spend", dt.date(2023, 12, 1)), 1, "sent"),
    (("other", dt.date(2024, 1, 1)), 1, "sent"), (("other", dt.date(2024, 1, 1)), 5, "not exceeded"),
])
def test_three_verdicts(spark, sent, threshold, verdict):
    data = usage(spark, ("a", 1, 5, True, "2024-01-02T00:00:00"))
    assert rows(m.spend_alert(data, state(spark, sent), AS_OF, Decimal(threshold)), "verdict") == [(verdict,)]


def test_alerts_are_added_once_per_month(spark):
    data = usage(spark, ("a", 1, 5, True, "2024-01-02T00:00:00"), ("b", 1, 5, True, "2024-02-02T00:00:00"), ("c", 1, 1, True, "2024-03-02T00:00:00"))
    new = m.new_alerts(m.month_totals(data), state(spark, ("monthly_spend", dt.date(2024, 1, 1))), Decimal(2), F.current_timestamp())
    assert rows(new, "alert_month") == [(dt.date(2024, 2, 1),)]


def test_first_breach_is_the_first_hour_above_the_threshold(spark):
    data = usage(spark, ("a", 1, 5, True, "2024-01-02T01:10:00"), ("b", 1, 5, True, "2024-01-02T01:50:00"),
                 ("c", 1, 1, True, "2024-01-02T03:00:00"), ("d", 1, 10, True, "2024-02-01T00:00:00"))
    assert rows(m.first_breach(data, Decimal(10))) == [(dt.date(2024, 1, 1), ts("2024-01-02T03:00:00"), dec("11.000000"))]


def test_enforcement_is_strict_and_only_for_active_users(spark, access):
    data = usage(spark, ("a", 1, 10, True, "2024-01-02"), ("b", 2, "10.000001", True, "2024-01-02"), ("c", 3, 99, True, "2024-01-02"),
                 ("d", 5, 99, True, "2024-01-02"))
    spend = m.user_month_spend(data, AS_OF)
    assert rows(m.limit_enforcement(access, spend)) == [("bob", dec("10.000001"), dec("10.000000"), "REVOKED")]
    after = {r.user_name: (r.is_active, r.revoked_at, r.revocation_reason) for r in m.enforced_access(access, spend, AS_OF).collect()}
    assert after["bob"] == (False, AS_OF, "Monthly limit exceeded")
    assert after["ann"] == (True, None, None) and after["off"][1] == ts("2023-01-01") and after["unset"][0] is None
    assert len(after) == 5


def test_grants_update_insert_and_leave_others(spark, access, users):
    grants = spark.createDataFrame([
        ("off", dec(5), ts("2024-01-01")), ("off", dec(6), ts("2024-01-02")), ("cat", None, ts("2024-01-02")), ("who", dec(1), ts("2024-01-02")),
    ], "user_name string, monthly_credit_limit decimal(38,6), requested_at timestamp")
    after = {r.user_name: r for r in m.grant_upsert(access, grants, users, AS_OF).collect()}
    assert (after["off"].monthly_credit_limit, after["off"].is_active, after["off"].revoked_at) == (dec("6.000000"), True, None)
    assert after["off"].user_id is None
    assert (after["cat"].user_id, after["cat"].monthly_credit_limit) == (7, dec("100.000000"))
    assert after["who"].user_id is None and after["ann"].granted_at == ts("2023-01-01") and len(after) == 7


def test_reinstatement_reaches_every_listed_user(spark, access, users):
    assert m.monthly_reinstate(access).count() == 5
    after = m.reinstated_access(access, users, AS_OF)
    assert after.where("is_active and revoked_at is null and revocation_reason is null").count() == 5
    assert rows(after.where("user_name = 'ann'"), "monthly_credit_limit", "granted_at") == [(dec("10.000000"), AS_OF)]


def test_runaway_is_per_row_unless_asked_per_query(spark, users):
    data = usage(spark, ("big", 1, 51, False, "2024-01-30T12:00:00"), ("edge", 1, 50, False, "2024-01-31T00:00:00"),
                 ("done", 1, 99, True, "2024-01-31T00:00:00"), ("null", 1, 99, None, "2024-01-31T00:00:00"),
                 ("old", 1, 99, False, "2024-01-29T11:59:59"), ("first", 9, 99, False, "2024-01-29T12:00:00"),
                 ("split", 2, 30, False, "2024-01-31T00:00:00"), ("split", 2, 30, False, "2024-01-31T01:00:00"))
    found = m.runaway_detection(data, users, AS_OF, Decimal(50))
    assert rows(found, "query_id", "user_name", "action") == [("big", "ann", "CANCELLED"), ("first", None, "CANCELLED")]
    assert rows(m.runaway_detection(data, users, AS_OF, Decimal(50), per="query"), "query_id") == [("big",), ("first",), ("split",)]
    body = {r.query_id: r.body for r in m.runaway_messages(found).collect()}
    assert body["first"].splitlines() == [
        "Query cancelled due to excessive cost.", "Query ID: first", "User: Unknown", "Function: f", "Model: m",
        "Credits: 99.000000", "Start Time: 2024-01-29 12:00:00"]


def test_daily_limits_prefer_the_user_over_the_account(spark):
    day = ts("2024-01-02T05:00:00")
    used = spark.createDataFrame([(u, s, day, dec(5)) for u, s in [(1, "code_cli"), (2, "code_cli"), (3, "code_cli"), (4, "code_cli"), (5, "code_web")]],
                                 "user_id bigint, surface string, usage_time timestamp, token_credits decimal(38,6)")
    own = spark.createDataFrame([(1, "code_cli", dec(-1)), (2, "code_cli", dec(0)), (3, "code_cli", dec(5))], "user_id bigint, surface string, daily_limit decimal(38,6)")
    account = spark.createDataFrame([("code_cli", dec(1))], "surface string, daily_limit decimal(38,6)")
    status = rows(m.daily_limit_check(used, own, account), "user_id", "status")
    assert status == [(1, "NO_LIMIT"), (2, "BLOCKED"), (3, "WITHIN_LIMIT"), (4, "OVER_LIMIT"), (5, "NO_LIMIT")]


def test_limit_listings_tolerate_missing_columns(spark):
    one = spark.createDataFrame([("k", "1", 3)], "KEY string, VALUE string, OTHER int")
    two = spark.createDataFrame([("k2", "2", "d")], "key string, value string, description string")
    merged = m.daily_limits_scan(one, two)
    assert merged.columns == ["key", "value", "description"]
    assert rows(merged) == [("k", "1", None), ("k2", "2", "d")]


def test_budget_actions_and_month_reset(spark):
    spend = spark.createDataFrame([("a", dt.date(2024, 1, 1), dec(100)), ("a", dt.date(2024, 2, 1), dec(1)), ("b", dt.date(2024, 1, 1), dec(80)),
                                   ("c", dt.date(2024, 1, 1), dec("79.999999"))], "tag_value string, month date, credits decimal(38,6)")
    budgets = spark.createDataFrame([(t, dec(100)) for t in "abc"], "tag_value string, monthly_limit decimal(38,6)")
    got = rows(m.budget_thresholds(spend, budgets), "tag_value", "action")
    assert got == [("a", "NONE"), ("a", "REVOKE"), ("b", "NOTIFY"), ("c", "NONE")]
    for bad in (0, 501):
        with pytest.raises(ValueError):
            m.budget_thresholds(spend, budgets, notify_percent=bad)


def test_budget_usage_includes_both_months(spark):
    data = spark.createDataFrame([("s", ts(t), dec(1)) for t in ("2023-11-30T23:59:59", "2023-12-01", "2024-02-29T23:59:59", "2024-03-01")],
                                 "service string, start_time timestamp, credits decimal(38,6)")
    assert rows(m.budget_usage(data, "2023-12", "2024-02"), "month") == [("2023-12",), ("2024-02",)]


def test_recipients_are_trimmed(spark):
    df = spark.createDataFrame([("a@x, b@x ,c@x",)], "r string")
    assert df.select(m.recipients("r")).first()[0] == ["a@x", "b@x", "c@x"]
