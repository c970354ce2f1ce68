"""The periodic checks as streaming jobs.

The detectors that only filter (``operators.detect``: policy, parameter and network changes, and
``operators.compliance.change_monitor``) take a stream as they are. The jobs here need state.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterstone.fixed_values import DEFAULT_NOTIFY_PERCENT, DEFAULT_REVOKE_PERCENT, SPEND_ALERT_NAME
from meterstone.operators import detect, limits
from meterstone.operators.governance import is_paid
from meterstone.sources import buckets
from meterstone.streaming import keyed
from meterstone.streaming.tables import run_batches


def hourly_usage(usage: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Usage arriving row by row, summed per hour, function and model.

    An hour is given out once no more rows for it are expected (``late`` after its end).
    """
    hours = usage.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "function_name", "model_name")
    return hours.agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("requests")).select(
        F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "function_name", "model_name", "credits", "requests"
    )


def spend_alerts(usage: DataFrame, threshold: Decimal, sent_at: Column | None = None, late: str = "2 hours") -> DataFrame:
    """One alert row per month whose spend goes above the threshold, for the table of alerts sent."""
    hours = keyed.hourly_spend(usage.withWatermark("start_time", late), F.lit(SPEND_ALERT_NAME)).withColumn("credit_limit", F.lit(threshold).cast("decimal(38,6)"))
    stamp = F.current_timestamp() if sent_at is None else sent_at
    return keyed.spend_watch(hours, [("ALERT", 100)]).select(
        F.col("subject").alias("alert_name"), F.col("month").alias("alert_month"), stamp.alias("sent_at"), F.col("credits").alias("credits_at_alert"))


def limit_actions(usage: DataFrame, access: DataFrame, at: Column | None = None, late: str = "2 hours", reinstate: bool = False) -> DataFrame:
    """One REVOKED row per active user whose spend of the month of the check passes their limit.

    With ``reinstate`` a GRANTED row follows when the next month starts, for every user over the limit, with or without access then. A
    timer gives it out, so it needs no usage.

    Usage of other months, and usage later than the check, does not count, whenever it arrives. Each month starts anew. Who is granted
    access again during the month is checked again with the hours that follow. The access table is read as it is when the
    job starts, so a job that follows changes is run to its end as often as the check is due, and ``apply_actions`` after it.
    """
    stamp = F.current_timestamp() if at is None else at
    counted = usage.withWatermark("start_time", late).where(F.col("start_time").between(F.date_trunc("month", stamp), stamp))
    hours = keyed.hourly_spend(counted, F.col("user_id"))
    # Spend of users without access counts on, for the time they get it back. Access rows grow with the users, however small
    # their compressed files look, so they are not copied through the driver.
    named = access.select(
        F.col("user_id").alias("subject"), "user_name", F.col("monthly_credit_limit").cast("decimal(38,6)").alias("credit_limit"), F.col("granted_at").alias("since"), "is_active")
    found = keyed.spend_watch(hours.join(named.drop("user_name", "is_active").hint("merge"), "subject"), [("REVOKED", 100)], at_end="GRANTED" if reinstate else None)
    known = found.drop("credit_limit").join(named.drop("since").hint("merge"), "subject").where((F.col("action") == "GRANTED") | F.col("is_active"))
    return known.select("user_name", "month", F.col("credits").alias("credits_used"), "credit_limit", "action")


def apply_actions(spark: SparkSession, folder: str, table: str, at: Column | None = None) -> StreamingQuery:
    """Carries out the actions written to ``folder/rows`` (``limit_actions``) in the bucketed table of access rights.

    The stream follows the written actions, so each counts once. Only the buckets of these users are written, and a batch
    that is repeated finds nothing left to change.
    """
    stamp = F.current_timestamp() if at is None else at

    def apply(batch: DataFrame, batch_id: int) -> None:
        # Of several actions for a user the last counts; within a month access is granted before it is taken away.
        order = F.struct("month", (F.col("action") == "REVOKED").alias("revoked"))
        last = batch.groupBy("user_name").agg(F.max(order).alias("o")).select("user_name", "o.month", "o.revoked")
        buckets.update_rows(table, last.where("revoked"), limits.revoked_access, stamp)
        buckets.update_rows(table, last.where("not revoked"), limits.granted_access, stamp)

    schema = spark.read.parquet(f"{folder}/rows").schema
    return run_batches(spark.readStream.schema(schema).parquet(f"{folder}/rows"), f"{folder}/applied", apply)


def budget_actions(usage: DataFrame, tags: DataFrame, budgets: DataFrame, notify_percent: int = DEFAULT_NOTIFY_PERCENT,
                   revoke_percent: int = DEFAULT_REVOKE_PERCENT, late: str = "2 hours") -> DataFrame:
    """NOTIFY and REVOKE when a tag's spend of a month reaches its percentages, and REINSTATE when the next month starts.

    A timer gives out REINSTATE, so it comes without any usage in the new month.
    """
    tagged = usage.select("agent_name", "start_time", F.col("token_credits").alias("credits")).withWatermark("start_time", late)
    hours = keyed.hourly_spend(tagged.join(tags, "agent_name"), F.col("tag_value"))
    limited = hours.join(budgets.select(F.col("tag_value").alias("subject"), F.col("monthly_limit").cast("decimal(38,6)").alias("credit_limit")), "subject")
    found = keyed.spend_watch(limited, [("NOTIFY", notify_percent), ("REVOKE", revoke_percent)], strict=False, at_end="REINSTATE")
    return found.select(F.col("subject").alias("tag_value"), "month", "action")


def runaway_work(usage: DataFrame, users: DataFrame, threshold: Decimal, at: Column | None = None, hours: int = 48) -> DataFrame:
    """One action row per runaway usage row of the ``hours`` before the check; an equal row that comes again gives none.

    Equal rows are remembered as long as they can still be in the window.
    """
    stamp = F.current_timestamp() if at is None else at
    recent = usage.where(F.col("start_time").between(stamp - F.make_dt_interval(F.lit(0), F.lit(hours)), stamp))
    rows = limits.runaway_rows(recent.withWatermark("start_time", f"{hours} hours"), users, threshold)
    return rows.dropDuplicatesWithinWatermark(["query_id", "user_name", "function_name", "model_name", "start_time", "credits"])


def auth_failures(logins: DataFrame, n: int, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return detect.auth_failures(logins.withWatermark("ts", late), n, window)


def job_errors(queries: DataFrame, n: int, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    return detect.job_errors(queries.withWatermark("start_time", late), n, window)


def active_scanners(findings: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Paid scanners seen per window. A stream cannot keep exact distinct sets for ever, so this count is approximate."""
    runs = findings.where(is_paid()).withWatermark("start_timestamp", late)
    return runs.groupBy(F.window("start_timestamp", window).alias("w")).agg(
        F.approx_count_distinct("scanner_name", 0.01).alias("scanners")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "scanners")


def unusual_ip_logins(logins: DataFrame, known: DataFrame | None = None, forget_days: int = 400) -> DataFrame:
    """First login of each user from an address that is neither in the known table (user_id, client_ip, last_seen) nor seen since.

    The state is keyed by user and address, so one busy user is spread over all tasks. A pair not seen for ``forget_days`` is forgotten.
    """
    good = logins.where("is_success").select("user_id", "client_ip", "ts")
    return keyed.last_seen(good, ["user_id", "client_ip"], "ts", None, forget_days, known).select("user_id", "client_ip", F.col("seen_at").alias("login_at"))


def dormant_logins(logins: DataFrame, days: int = 90, known: DataFrame | None = None, forget_days: int = 1100) -> DataFrame:
    """Logins after ``days`` or more days without one.

    ``known`` (user_id, last_seen) is the last login of each user before the stream. Who has not logged in for ``forget_days`` is forgotten.
    """
    if not 1 <= days <= forget_days:
        raise ValueError("days must lie between 1 and forget_days")
    good = logins.where("is_success").select("user_id", "ts")
    return keyed.last_seen(good, ["user_id"], "ts", days, forget_days, known).select(
        "user_id", F.col("previous_seen").alias("previous_login"), F.col("seen_at").alias("login_at"))
