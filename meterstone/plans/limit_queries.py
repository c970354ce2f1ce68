"""Spend alert, limit and budget queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterstone.fixed_values import DEFAULT_RUNAWAY_CREDITS, DEFAULT_SPEND_THRESHOLD
from meterstone.operators import limits as m
from meterstone.operators import usage as u
from meterstone.plans.registry import query
from meterstone.plans.usage_queries import AS_OF, services, services_sql
from meterstone.session import work_folder
from meterstone.sources import buckets, sinks

THRESHOLD = DEFAULT_SPEND_THRESHOLD
RUNAWAY = DEFAULT_RUNAWAY_CREDITS
MID_MONTH = "2024-01-20"


def month_to(as_of) -> str:
    return f"start_time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{as_of}'"


MTD = month_to(AS_OF)
# Access rows with what each user has spent in the month.
SPENT = f"""spent AS (SELECT *, ifnull((SELECT sum(x.credits) FROM ai_usage x WHERE x.user_id = access_control.user_id AND x.{MTD}), 0) AS used
FROM access_control)"""


@query("A32 P08", f"SELECT coalesce(sum(credits), 0) AS credits FROM ai_usage WHERE {MTD}")
def month_spend(v):
    return m.month_spend(v.ai_usage, AS_OF)


@query("A32 P08 P07", f"SELECT ifnull(sum(credits), 0) AS credits FROM ai_usage WHERE {month_to(MID_MONTH)}")
def month_spend_mid_month(v):
    """Usage after the moment asked for does not count."""
    return m.month_spend(v.ai_usage, MID_MONTH)


@query("A33 J07 P11", f"SELECT 1 AS exceeded FROM ai_usage WHERE {MTD} HAVING sum(credits) > 1000")
def month_spend_exceeds(v):
    return m.month_spend_exceeds(v.ai_usage, AS_OF, THRESHOLD)


@query("A34 P08", f"SELECT user_id, sum(credits) AS total_credits FROM ai_usage WHERE {MTD} GROUP BY 1")
def user_month_spend(v):
    return m.user_month_spend(v.ai_usage, AS_OF)


def sent_alerts(v, years_later: int):
    """Alert state with an alert for every month that has orders, moved on by whole years."""
    month = F.add_months(F.trunc(F.col("o_orderdate").cast("timestamp"), "month"), 12 * years_later)
    return v.table("orders").groupBy(month.alias("alert_month")).agg(
        F.max("o_orderdate").cast("timestamp").alias("sent_at"), F.sum("o_totalprice").cast("decimal(38,6)").alias("credits_at_alert")
    ).select(F.lit("monthly_spend").alias("alert_name"), "alert_month", "sent_at", "credits_at_alert")


def sent_sql(years_later: int) -> str:
    return f"(SELECT DISTINCT CAST(date_trunc('month', o_orderdate + INTERVAL {years_later} YEAR) AS DATE) FROM orders)"


# Orders run over some seven years from 1995; moved on by 10 years they end before 2024, by 28 they cover its start.
LONG_AGO, RECENT = 10, 28


def verdict_sql(years_later: int) -> str:
    return f"""WITH s AS (SELECT sum(credits) AS credits, DATE '2024-01-01' IN {sent_sql(years_later)} AS known FROM ai_usage WHERE {MTD})
SELECT 'monthly_spend' AS alert_name, DATE '2024-01-01' AS alert_month, credits,
CASE WHEN known THEN 'already sent' WHEN credits > 1000 THEN 'sent' ELSE 'not exceeded' END AS verdict,
CASE WHEN known THEN 'Alert already sent for this month' WHEN credits > 1000 THEN concat('Alert sent. Credits: ', credits)
ELSE concat('Threshold not exceeded. Current: ', credits, ' / 1000') END AS message FROM s"""


@query("R02 F04 A32", verdict_sql(LONG_AGO))
def spend_alert(v):
    return m.spend_alert(v.ai_usage, sent_alerts(v, LONG_AGO), AS_OF, THRESHOLD)


@query("R02 F04 J07", verdict_sql(RECENT))
def spend_alert_repeated(v):
    return m.spend_alert(v.ai_usage, sent_alerts(v, RECENT), AS_OF, THRESHOLD)


@query("K02 R02", f"""SELECT 'monthly_spend' AS alert_name, month AS alert_month, TIMESTAMP '2024-01-31' AS sent_at, total AS credits_at_alert
FROM (SELECT CAST(date_trunc('month', start_time) AS DATE) AS month, sum(credits) AS total FROM ai_usage GROUP BY 1)
WHERE total > 1000 AND month NOT IN {sent_sql(LONG_AGO)}""")
def alert_state_append(v):
    return m.new_alerts(m.month_totals(v.ai_usage), sent_alerts(v, LONG_AGO), THRESHOLD, m.instant(AS_OF))


@query("K02 R02", verdict_sql(LONG_AGO).replace("known THEN 'already sent'", "known OR credits > 1000 THEN 'already sent'").replace(
    "known THEN 'Alert already", "known OR credits > 1000 THEN 'Alert already"))
def alert_after_append(v):
    """The alert rows are appended to the stored state, and the next check reads them there."""
    folder = work_folder(v.spark, "alert-state")
    state = sent_alerts(v, LONG_AGO)
    sinks.append_alert_state(state, folder)
    sinks.append_alert_state(m.new_alerts(m.month_totals(v.ai_usage), state, THRESHOLD, m.instant(AS_OF)).select(*state.columns), folder)
    return m.spend_alert(v.ai_usage, v.spark.read.schema(state.schema).parquet(folder), AS_OF, THRESHOLD)


@query("R02", f"""SELECT CAST(date_trunc('month', start_time) AS DATE) AS alert_month, 'AI Functions Monthly Spend Alert' AS subject,
'Monthly AI Function credit consumption has exceeded the threshold.' || chr(10) || chr(10) || 'Current spend: ' || CAST(sum(credits) AS VARCHAR)
|| ' credits' || chr(10) || 'Threshold: 1000 credits' AS body FROM ai_usage
WHERE CAST(date_trunc('month', start_time) AS DATE) NOT IN {sent_sql(LONG_AGO)} GROUP BY 1 HAVING sum(credits) > 1000""")
def alert_mail(v):
    new = m.new_alerts(m.month_totals(v.ai_usage), sent_alerts(v, LONG_AGO), THRESHOLD, m.instant(AS_OF))
    return m.alert_mail(new, THRESHOLD)


@query("R06", """SELECT user_name, 'Access granted to ' || user_name || ' with limit ' || CAST(coalesce(monthly_credit_limit, CAST(100 AS DECIMAL(38,6))) AS VARCHAR)
|| ' credits' AS message FROM grant_requests""")
def grant_messages(v):
    return m.grant_messages(v.grant_requests)


@query("W04", """WITH h AS (SELECT start_time AS hour, CAST(date_trunc('month', start_time) AS DATE) AS month, sum(credits) AS credits
FROM ai_usage GROUP BY 1, 2), r AS (SELECT month, hour, sum(credits) OVER (PARTITION BY month ORDER BY hour) AS spent FROM h)
SELECT month, min(hour) AS breach_hour, min(spent) AS spent_at_breach FROM r WHERE spent > 1000 GROUP BY month""")
def first_breach(v):
    return m.first_breach(v.ai_usage, THRESHOLD)


@query("R03 J05 A34 P12", f"""WITH {SPENT} SELECT user_name, used AS credits_used, monthly_credit_limit AS credit_limit, 'REVOKED' AS action
FROM spent WHERE used > monthly_credit_limit AND is_active""")
def limit_enforcement(v):
    return m.limit_enforcement(v.access_control, m.user_month_spend(v.ai_usage, AS_OF))


@query("R03 J05", f"""WITH {SPENT}, j AS (SELECT *, used > monthly_credit_limit AND is_active AS hit FROM spent)
SELECT user_name, user_id, granted_at, monthly_credit_limit, is_active AND NOT hit AS is_active,
CASE WHEN hit THEN TIMESTAMP '2024-01-31' ELSE revoked_at END AS revoked_at,
CASE WHEN hit THEN 'Monthly limit exceeded' ELSE revocation_reason END AS revocation_reason FROM j""")
def enforced_access(v):
    return m.enforced_access(v.access_control, m.user_month_spend(v.ai_usage, AS_OF), AS_OF)


@query("S20", "SELECT * FROM access_control")
def access_control_status(v):
    return m.access_control_status(v.access_control)


@query("R04", "SELECT user_name, monthly_credit_limit AS credit_limit, 'GRANTED' AS action FROM access_control")
def monthly_reinstate(v):
    return m.monthly_reinstate(v.access_control)


@query("R04 J09", """SELECT user_name, user_id, TIMESTAMP '2024-02-01' AS granted_at, monthly_credit_limit, TRUE AS is_active,
CAST(NULL AS TIMESTAMP) AS revoked_at, CAST(NULL AS VARCHAR) AS revocation_reason FROM access_control""")
def reinstated_access(v):
    return m.reinstated_access(v.access_control, v.users, "2024-02-01")


UPSERT = """SELECT coalesce(a.user_name, g.user_name) AS user_name,
CASE WHEN g.user_name IS NULL THEN a.user_id ELSE u.user_id END AS user_id,
CASE WHEN g.user_name IS NULL THEN a.granted_at ELSE TIMESTAMP '2024-01-31' END AS granted_at,
CASE WHEN g.user_name IS NULL THEN a.monthly_credit_limit ELSE coalesce(g.monthly_credit_limit, 100) END AS monthly_credit_limit,
g.user_name IS NOT NULL OR a.is_active AS is_active,
CASE WHEN g.user_name IS NULL THEN a.revoked_at END AS revoked_at,
CASE WHEN g.user_name IS NULL THEN a.revocation_reason END AS revocation_reason
FROM access_control a FULL JOIN grant_requests g ON a.user_name = g.user_name LEFT JOIN users u ON g.user_name = u.name"""


@query("R06 J09", UPSERT)
def grant_upsert(v):
    return m.grant_upsert(v.access_control, v.grant_requests, v.users, AS_OF)


@query("R06 J09", UPSERT)
def stored_grant_upsert(v):
    """Grants merged into the bucketed access table in two batches; the table's rows are not moved."""
    table = "access_" + work_folder(v.spark, "t").rpartition("-")[2]
    buckets.save_buckets(v.access_control, table, 8, path=work_folder(v.spark, "access"))
    half = F.pmod(F.hash("user_name"), F.lit(2)) == 0
    for part in (half, ~half):
        buckets.grant(table, v.grant_requests.where(part), v.users, AS_OF)
    return buckets.read_buckets(v.spark, table)


TWO_DAYS = "start_time BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-31'"
RUNAWAY_SQL = f"""WITH r AS (SELECT * FROM ai_usage WHERE {TWO_DAYS} AND NOT is_completed AND credits > 50)
SELECT query_id, (SELECT name FROM users WHERE users.user_id = r.user_id) AS user_name, function_name, model_name, credits, start_time,
'CANCELLED' AS action FROM r"""


@query("R05 P07 P11 P12 P13 J01", RUNAWAY_SQL)
def runaway_detection(v):
    return m.runaway_detection(v.ai_usage, v.users, AS_OF, RUNAWAY)


@query("R05", f"""WITH q AS (SELECT query_id, user_id, function_name, model_name, sum(credits) AS credits, min(start_time) AS start_time FROM ai_usage
WHERE {TWO_DAYS} AND NOT is_completed GROUP BY ALL) SELECT * EXCLUDE (user_id), (SELECT name FROM users WHERE users.user_id = q.user_id) AS user_name,
'CANCELLED' AS action FROM q WHERE credits > 50""")
def runaway_by_query(v):
    return m.runaway_detection(v.ai_usage, v.users, AS_OF, RUNAWAY, per="query")


@query("R05", f"""SELECT query_id, 'Runaway AI Query Cancelled - ' || query_id AS subject,
'Query cancelled due to excessive cost.' || chr(10) || 'Query ID: ' || query_id || chr(10) || 'User: ' || coalesce(user_name, 'Unknown') || chr(10)
|| 'Function: ' || function_name || chr(10) || 'Model: ' || model_name || chr(10) || 'Credits: ' || CAST(credits AS VARCHAR) || chr(10)
|| 'Start Time: ' || strftime(start_time, '%Y-%m-%d %H:%M:%S') AS body FROM ({RUNAWAY_SQL})""")
def runaway_messages(v):
    return m.runaway_messages(m.runaway_detection(v.ai_usage, v.users, AS_OF, RUNAWAY))


@query("R02", """SELECT user_id, CASE WHEN email IS NULL THEN 'admin@example.com' ELSE 'admin@example.com|' || email END AS recipients FROM accounts""")
def alert_recipients(v):
    """Addresses of a comma-separated list with stray blanks."""
    listed = F.concat(F.lit(" admin@example.com"), F.coalesce(F.concat(F.lit(" , "), "email"), F.lit("")))
    return v.accounts.withColumn("listed", listed).select("user_id", F.array_join(m.recipients("listed"), "|").alias("recipients"))


@query("S18 U03 P14", """SELECT 'CODE_CLI_DAILY_LIMIT' AS key, CAST(c_custkey AS VARCHAR) AS value, '1' AS "default",
CASE WHEN c_custkey % 2 = 0 THEN 'ACCOUNT' ELSE 'USER' END AS level, 'command line' AS description FROM customer
UNION ALL SELECT 'CODE_WEB_DAILY_LIMIT', CAST(c_custkey AS VARCHAR), '1', CASE WHEN c_custkey % 2 = 0 THEN 'ACCOUNT' ELSE 'USER' END, NULL FROM customer""")
def daily_limits_scan(v):
    return m.daily_limits_scan(*v.limit_parameters)


def code_usage(v):
    return v.code_cli_usage.withColumn("surface", F.lit("code_cli")).unionByName(
        v.code_web_usage.withColumn("surface", F.lit("code_web"))
    )


@query("R07", """WITH d AS (SELECT user_id, 'code_cli' AS surface, CAST(usage_time AS DATE) AS usage_day, sum(token_credits) AS credits
  FROM code_cli_usage GROUP BY ALL UNION ALL SELECT user_id, 'code_web', CAST(usage_time AS DATE), sum(token_credits) FROM code_web_usage GROUP BY ALL),
e AS (SELECT d.*, coalesce(o.daily_limit, a.daily_limit, -1) AS daily_limit FROM d
  LEFT JOIN user_daily_limits o ON d.user_id = o.user_id AND d.surface = o.surface LEFT JOIN account_daily_limits a ON d.surface = a.surface)
SELECT *, CASE WHEN daily_limit < 0 THEN 'NO_LIMIT' WHEN daily_limit = 0 THEN 'BLOCKED' WHEN credits > daily_limit THEN 'OVER_LIMIT' ELSE 'WITHIN_LIMIT' END AS status FROM e""")
def daily_limit_check(v):
    return m.daily_limit_check(code_usage(v), v.user_daily_limits, v.account_daily_limits)


TAG_SPEND = """SELECT t.tag_value, CAST(date_trunc('month', a.start_time) AS DATE) AS month, sum(a.token_credits) AS credits
FROM agent_usage a JOIN agent_tags t ON a.agent_name = t.agent_name GROUP BY ALL"""


@query("R09", TAG_SPEND)
def tag_spend(v):
    return m.tag_spend(v.agent_usage, v.agent_tags)


@query("R08", f"""SELECT s.tag_value, s.month, s.credits, b.monthly_limit,
CAST(round(CAST(s.credits AS DOUBLE) * 100 / CAST(b.monthly_limit AS DOUBLE), 2) AS DECIMAL(18,2)) AS percent_used,
CASE WHEN s.credits * 100 >= b.monthly_limit * 100 THEN 'REVOKE' WHEN s.credits * 100 >= b.monthly_limit * 80 THEN 'NOTIFY' ELSE 'NONE' END AS action
FROM ({TAG_SPEND}) s JOIN tag_budgets b ON s.tag_value = b.tag_value""")
def budget_thresholds(v):
    return m.budget_thresholds(m.tag_spend(v.agent_usage, v.agent_tags), v.tag_budgets)


BUDGET_ACTIONS = f"""WITH used AS (SELECT s.tag_value, s.month, s.credits / b.monthly_limit AS part FROM ({TAG_SPEND}) s JOIN tag_budgets b ON s.tag_value = b.tag_value)
SELECT tag_value, month, 'NOTIFY' AS action FROM used WHERE part >= 0.8 UNION ALL SELECT tag_value, month, 'REVOKE' FROM used WHERE part >= 1
UNION ALL SELECT tag_value, CAST(month + INTERVAL 1 MONTH AS DATE), 'REINSTATE' FROM used WHERE part >= 1"""


@query("R08", BUDGET_ACTIONS)
def budget_actions(v):
    """Notify and revoke are separate actions; access comes back when the next month starts."""
    return m.budget_actions(m.tag_spend(v.agent_usage, v.agent_tags), v.tag_budgets)


@query("S21", f"""WITH {services_sql("DATE '2023-12-01'")} SELECT strftime(start_time, '%Y-%m') AS month, service, sum(credits) AS credits FROM services
WHERE start_time >= TIMESTAMP '2023-12-01' AND start_time < TIMESTAMP '2024-02-01' GROUP BY 1, 2""")
def budget_usage(v):
    return m.budget_usage(services(v, dt.date(2023, 12, 1)), "2023-12", "2024-01")
