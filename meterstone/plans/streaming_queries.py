"""The streaming jobs, each run over all files of its table and compared with the batch answer."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from meterstone.operators import detect
from meterstone.plans.limit_queries import BUDGET_ACTIONS, MTD, RUNAWAY_SQL, SPENT
from meterstone.plans.registry import query
from meterstone.session import work_folder
from meterstone.sources import buckets
from meterstone.sources import views as w
from meterstone.streaming import jobs
from meterstone.streaming.tables import run_closed, run_to_end, state_partitions, stream_table

BUCKETS = 8


def stamp():
    return F.lit("2024-01-31").cast("timestamp")


def event_stream(v):
    return w.event_columns(stream_table(v.spark, v.folder, "events"))


def event_partitions(v):
    return state_partitions(v.spark, f"{v.folder}/events.parquet")


def closed(v, label, build, **values):
    """All results of a stream over the events, none held back."""
    return run_closed(build, event_stream(v), work_folder(v.spark, label), "ts", event_partitions(v), **values)


@query("R01", """SELECT date_trunc('hour', ts) AS start_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_time, event_type AS function_name,
'm' || (user_id % 4) AS model_name, sum(credits) AS credits, count(*) AS requests FROM ev GROUP BY ALL""")
def hourly_usage(v):
    def build(events):
        return jobs.hourly_usage(events.select("ts", F.col("event_type").alias("function_name"), w.text("m", F.col("user_id") % 4).alias("model_name"), "credits"))

    return closed(v, "hourly", build)


@query("R02 K02", """WITH h AS (SELECT start_time, CAST(date_trunc('month', start_time) AS DATE) AS month, sum(credits) AS credits FROM ai_usage GROUP BY 1, 2)
SELECT 'monthly_spend' AS alert_name, month AS alert_month, TIMESTAMP '2024-01-31' AS sent_at, min(spent) AS credits_at_alert
FROM (SELECT month, sum(credits) OVER (PARTITION BY month ORDER BY start_time) AS spent FROM h) WHERE spent > 1000 GROUP BY month""")
def spend_alert_stream(v):
    return closed(v, "alerts", lambda events: jobs.spend_alerts(w.ai_usage_of(events), Decimal("1000"), stamp()))


REVOKED = f"""WITH h AS (SELECT user_id, start_time, sum(credits) AS credits FROM ai_usage WHERE {MTD} GROUP BY 1, 2),
r AS (SELECT user_id, sum(credits) OVER (PARTITION BY user_id ORDER BY start_time) AS used FROM h)
SELECT user_name, DATE '2024-01-01' AS month, min(used) AS credits_used, monthly_credit_limit AS credit_limit, 'REVOKED' AS action
FROM r JOIN access_control USING (user_id) WHERE used > monthly_credit_limit AND is_active GROUP BY ALL"""


@query("R03", REVOKED)
def limit_enforcement_stream(v):
    return closed(v, "limits", lambda events: jobs.limit_actions(w.ai_usage_of(events), v.access_control, stamp()), user_id=1)


@query("R03 J05", f"""WITH {SPENT}, j AS (SELECT *, used > monthly_credit_limit AND is_active AS hit FROM spent)
SELECT user_name, user_id, granted_at, monthly_credit_limit, is_active AND NOT hit AS is_active,
CASE WHEN hit THEN TIMESTAMP '2024-01-31' ELSE revoked_at END AS revoked_at,
CASE WHEN hit THEN 'Monthly limit exceeded' ELSE revocation_reason END AS revocation_reason FROM j""")
def enforced_access_stream(v):
    """The bucketed access table after the streams have taken access away, bucket by bucket."""
    return access_after(v, reinstate=False)


@query("R03 R04", f"""WITH {SPENT}, j AS (SELECT *, used > monthly_credit_limit AS hit FROM spent)
SELECT user_name, user_id, CASE WHEN hit THEN TIMESTAMP '2024-02-01' ELSE granted_at END AS granted_at, monthly_credit_limit, is_active OR hit AS is_active,
CASE WHEN NOT hit THEN revoked_at END AS revoked_at, CASE WHEN NOT hit THEN revocation_reason END AS revocation_reason FROM j""")
def reinstated_access_stream(v):
    """Over the limit in January, active again from the first of February, though no usage tells the stream that it has come."""
    return access_after(v, reinstate=True)


def access_after(v, reinstate):
    table = "access_" + work_folder(v.spark, "t").rpartition("-")[2]
    buckets.save_buckets(v.access_control, table, BUCKETS, path=work_folder(v.spark, "access"))
    folder = work_folder(v.spark, "enforced")

    def build(events):
        return jobs.limit_actions(w.ai_usage_of(events), buckets.read_buckets(v.spark, table), stamp(), reinstate=reinstate)

    run_closed(build, event_stream(v), folder, "ts", event_partitions(v), user_id=1)
    jobs.apply_actions(v.spark, folder, table, stamp())
    return buckets.read_buckets(v.spark, table)


@query("R05", f"SELECT DISTINCT * FROM ({RUNAWAY_SQL})")
def runaway_stream(v):
    return run_to_end(jobs.runaway_work(w.ai_usage_of(event_stream(v)), v.users, Decimal("50"), stamp()), work_folder(v.spark, "runaway"), event_partitions(v))


@query("R08", BUDGET_ACTIONS)
def budget_action_stream(v):
    """Reinstatement comes from a timer: the last month with usage is followed by none."""
    return closed(v, "budgets", lambda events: jobs.budget_actions(v.agent_usage_of(events), v.agent_tags, v.tag_budgets), event_type="signup")


@query("D04", """SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS failures
FROM logins WHERE NOT is_success GROUP BY ALL HAVING count(*) >= 2""")
def auth_failures_stream(v):
    return closed(v, "failures", lambda events: jobs.auth_failures(w.logins_of(events), 2, "1 day"), event_type="error")


@query("D05", """SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS errors
FROM ev WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2""")
def job_errors_stream(v):
    def build(events):
        return jobs.job_errors(events.select("user_id", F.col("ts").alias("start_time"), (F.col("event_type") == "error").alias("is_error")), 2)

    return closed(v, "errors", build, event_type="error")


@query("D09", """SELECT user_id, previous_login, ts AS login_at FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS previous_login
FROM logins WHERE is_success) WHERE ts >= previous_login + INTERVAL 2 DAY""")
def dormant_login_stream(v):
    return closed(v, "dormant", lambda events: jobs.dormant_logins(w.logins_of(events), 2))


@query("D10", """SELECT user_id, client_ip, min(ts) AS login_at FROM logins l WHERE is_success
AND NOT EXISTS (SELECT 1 FROM logins p WHERE p.user_id = l.user_id AND p.client_ip = l.client_ip AND p.ts < TIMESTAMP '2024-01-20') GROUP BY ALL""")
def unusual_ip_stream(v):
    """The addresses known before a day are the state the stream begins with."""
    known = v.logins.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy("user_id", "client_ip").agg(F.max("ts").alias("last_seen"))
    return closed(v, "addresses", lambda events: jobs.unusual_ip_logins(w.logins_of(events), known))


@query("D08 D11 D12 D13", """SELECT event_id, ts, user_id, action, object_kind, object_name FROM change_events WHERE action IN ('CREATE', 'ALTER', 'DROP')
AND (object_kind IN ('AUTHENTICATION POLICY', 'NETWORK POLICY', 'PASSWORD POLICY', 'SESSION POLICY')
OR (object_kind = 'PARAMETER' AND object_name IN ('NETWORK_POLICY', 'PREVENT_UNLOAD_TO_INLINE_URL')))""")
def policy_change_stream(v):
    events = w.change_events_of(event_stream(v))
    found = detect.auth_policy_changes(events).unionByName(detect.network_policy_changes(events)).unionByName(
        detect.sensitive_param_changes(events)
    ).unionByName(detect.policy_changes(events))
    return run_to_end(found, work_folder(v.spark, "changes"))
