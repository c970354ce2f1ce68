import datetime as dt

import pytest

from meterstone.operators import compliance as c
from meterstone.operators import detect as d
from tests.conftest import rows, ts

LOGINS = """login_id bigint, ts timestamp, user_id bigint, client_ip string, client_app string, client_kind string, client_version string,
is_success boolean, first_factor string, second_factor string"""
START = ts("2024-01-01T08:00:00")


def login(days, user=1, ip="a", app="x", ok=True, kind="k", version=5, first="PASSWORD", second=None, minutes=0):
    return (0, START + dt.timedelta(days=days, minutes=minutes), user, ip, app, kind, version, ok, first, second)


def logins(spark, *data):
    return spark.createDataFrame(list(data), LOGINS)


ACCOUNTS = """user_id bigint, name string, kind string, has_password boolean, has_mfa boolean, has_key_pair boolean, key_set_at timestamp,
last_login_at timestamp, default_role string, email string, network_policy string, is_disabled boolean"""


def account(user, kind="PERSON", password=True, mfa=True, key=True, key_at=None, seen="2024-01-30", role="R", email="e", policy="p", off=False):
    return (user, f"u{user}", kind, password, mfa, key, key_at and ts(key_at), seen and ts(seen), role, email, policy, off)


def test_account_detectors(spark):
    accounts = spark.createDataFrame([account(1, mfa=False), account(2), account(3, mfa=False, off=True), account(4, "SERVICE"),
                                      account(5, "LEGACY_SERVICE", off=True), account(6, "SERVICE", password=False)], ACCOUNTS)
    assert rows(d.non_mfa_persons(accounts), "user_id") == [(1,)]
    assert rows(d.password_service_users(accounts), "user_id") == [(4,)]


def test_admin_grants_in_last_day(spark):
    grants = spark.createDataFrame([(1, "ACCOUNTADMIN", ts("2024-01-30T12:00:00")), (2, "ACCOUNTADMIN", ts("2024-01-30T11:59:59")),
                                    (3, "OTHER", ts("2024-01-31"))], "user_id bigint, role_name string, granted_on timestamp")
    assert rows(d.new_admin_grants(grants, "2024-01-31 12:00:00"), "user_id") == [(1,)]


def test_failures_per_window(spark):
    data = logins(spark, *[login(0, ok=False, minutes=i * 10) for i in range(5)], login(0, ok=False, minutes=60), login(0, user=2, ok=False))
    assert rows(d.auth_failures(data, 5), "user_id", "failures") == [(1, 5)]
    queries = spark.createDataFrame([(1, START, True), (1, START, True), (1, START, False)], "user_id bigint, start_time timestamp, is_error boolean")
    assert rows(d.job_errors(queries, 2), "errors") == [(2,)]


def test_outliers_per_entity(spark):
    data = [("a", i, 1, START, 10) for i in range(50)] + [("a", 99, 1, START, 500), ("b", 1, 1, START, 500), ("b", 2, 1, START, None)]
    queries = spark.createDataFrame(data, "entity string, query_id bigint, user_id bigint, start_time timestamp, duration_seconds bigint")
    assert rows(d.long_query_outliers(queries), "query_id") == [(99,)]


def test_dormant_login_gap_is_inclusive_and_spans_failures(spark):
    data = logins(spark, login(0), login(89, ok=False), login(90), login(179, minutes=1439), login(269, minutes=1439), login(0, user=2))
    assert rows(d.dormant_login(data), "user_id", "login_at") == [(1, START + dt.timedelta(days=90)), (1, START + dt.timedelta(days=269, minutes=1439))]
    with pytest.raises(ValueError):
        d.dormant_login(data, 0)


def test_new_apps_and_addresses(spark):
    data = logins(spark, login(0, ip="a", app="x"), login(10, ip="a", app="x"), login(10, ip="b", app="y"), login(11, ip="b", app="y"),
                  login(10, ip="c", app="z", ok=False))
    since = ts("2024-01-10")
    assert rows(d.unusual_ip_login(data, since), "client_ip", "logins") == [("b", 2)]
    assert rows(d.unusual_app(data, since), "client_app") == [("y",)]
    assert rows(d.unusual_app(data, since, at_most=1), "client_app") == [("x",), ("y",)]


def test_change_detectors(spark):
    data = [("ALTER", "AUTHENTICATION POLICY", "p"), ("SHOW", "AUTHENTICATION POLICY", "p"), ("CREATE", "NETWORK POLICY", "p"),
            ("ALTER", "PARAMETER", "NETWORK_POLICY"), ("ALTER", "PARAMETER", "OTHER"), ("DROP", "PASSWORD POLICY", "p"), ("ALTER", "SESSION POLICY", "p"),
            ("CREATE", "ROLE GRANT", "ACCOUNTADMIN"), ("CREATE", "ROLE GRANT", "R"), ("CREATE", "PRIVILEGE GRANT", "MANAGE GRANTS"), ("CREATE", "SHARE", "s")]
    events = spark.createDataFrame(data, "action string, object_kind string, object_name string")
    assert [f(events).count() for f in (d.auth_policy_changes, d.network_policy_changes, d.sensitive_param_changes, d.policy_changes)] == [1, 1, 1, 2]
    assert rows(c.change_monitor(events), "rule") == [("CIS 2.1",), ("CIS 2.2",), ("CIS 2.6",), ("CIS 2.8",)]


def test_parameter_rules_fail_when_missing_null_or_not_a_number(spark):
    data = [(1, "PASSWORD_MIN_LENGTH", "14"), (1, "DATA_RETENTION_TIME_IN_DAYS", "91"), (1, "NETWORK_POLICY", " "), (1, "EVENT_TABLE", "t"),
            (1, "TRI_SECRET_SECURE", "true"), (1, "MIN_DATA_RETENTION_TIME_IN_DAYS", "many"), (2, "UNRELATED", "x")]
    verdicts = c.param_rules(spark.createDataFrame(data, "account_id bigint, parameter string, value string"))
    assert verdicts.count() == 28
    passed = verdicts.where("status = 'PASS'")
    assert rows(passed, "account_id", "rule") == [(1, "CIS 1.5"), (1, "CIS 4.9"), (1, "SE EVENTS")]


def test_user_hygiene(spark):
    accounts = spark.createDataFrame([
        account(1, mfa=False, seen=None), account(2, "LEGACY_SERVICE", key=False, policy=None), account(3, key_at="2023-08-03", seen="2023-11-01"),
        account(4, key_at="2023-08-05", seen="2023-11-03"), account(5, seen=None, off=True),
    ], ACCOUNTS)
    assert rows(c.user_hygiene(accounts, "2024-01-31")) == [
        (1, "CIS 1.4"), (1, "CIS 1.8"), (2, "CIS 1.6"), (2, "CIS 3.2"), (3, "CIS 1.7"), (3, "CIS 1.8")]


def test_admin_roles_follow_inheritance(spark):
    accounts = spark.createDataFrame([account(1, email=None), account(2, role="SECURITYADMIN"), account(3, email=None)], ACCOUNTS)
    grants = spark.createDataFrame([(1, "ACCOUNTADMIN"), (1, "ACCOUNTADMIN"), (2, "ACCOUNTADMIN"), (3, "SECURITYADMIN")], "user_id bigint, role_name string")
    hierarchy = spark.createDataFrame([("ACCOUNTADMIN", "ops"), ("ops", "night"), ("plain", "other"), ("SECURITYADMIN", "ACCOUNTADMIN")],
                                      "granted_role string, grantee_role string")
    assert rows(c.roles_with_admin(hierarchy)) == [("night", 2), ("ops", 1)]
    assert rows(c.admin_roles(grants, accounts, hierarchy, max_users=1)) == [
        ("CIS 1.10", "ACCOUNTADMIN"), ("CIS 1.11", "u1"), ("CIS 1.12", "u2"), ("CIS 1.13", "night"), ("CIS 1.13", "ops")]


def test_privileged_code_runs_as_owner_by_default(spark):
    objects = spark.createDataFrame([(1, "TASK", "ACCOUNTADMIN", None), (2, "PROCEDURE", "R", "SECURITYADMIN"), (3, "PROCEDURE", "ACCOUNTADMIN", "R"), (4, "TASK", "R", None)],
                                    "object_id bigint, object_kind string, owner_role string, run_as_role string")
    assert rows(c.privileged_code(objects), "object_id", "rule") == [(1, "CIS 1.14"), (1, "CIS 1.15"), (2, "CIS 1.17"), (3, "CIS 1.16")]


def test_sessions_and_objects(spark):
    data = logins(spark, login(0), login(0, second="MFA"), login(0, ok=False), login(0, first="KEY_PAIR", version=2), login(0, first="KEY_PAIR", kind="odd", version=0))
    assert rows(c.session_monitor(data, {"k": "3"}), "rule") == [("CIS 2.4",), ("CIS 2.9",)]
    stages = spark.createDataFrame([("i1", "INTERNAL", None, None), ("i2", "INTERNAL", "AES-256", None), ("e1", "EXTERNAL", None, None), ("e2", "EXTERNAL", None, "s")],
                                   "object_name string, stage_kind string, encryption string, storage_integration string")
    columns = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("v", "a", True), ("w", "a", False)], "table_name string, column_name string, is_sensitive boolean")
    policies = spark.createDataFrame([("t", "a", "MASKING"), ("v", None, "ROW_ACCESS"), ("v", "a", "MASKING")], "table_name string, column_name string, policy_kind string")
    assert rows(c.object_coverage(stages, columns, policies)) == [("e1", "CIS 4.7"), ("i1", "CIS 4.2"), ("t", "CIS 4.11"), ("t.b", "CIS 4.10")]
