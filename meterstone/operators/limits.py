"""Spend checks: month spend, alerts, per-user limits, runaway work, daily limits and tag budgets.

State tables (alerts already sent, who holds access) are plain frames. Each check takes the current
state and returns action rows or the next state; writing is left to ``sources.sinks``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.fixed_values import (
    ACCESS_GRANTED, ALERT_ALREADY_SENT, ALERT_BODY, ALERT_NOT_EXCEEDED, ALERT_SENT, ALERT_SUBJECT, DEFAULT_MONTHLY_LIMIT,
    DEFAULT_NOTIFY_PERCENT, DEFAULT_REVOKE_PERCENT, LIMIT_REASON, RUNAWAY_BODY, RUNAWAY_SUBJECT, SPEND_ALERT_NAME, UNKNOWN_USER,
)
from meterstone.functions.amounts import CREDITS, fill, sum_or_zero
from meterstone.functions.time import Instant, before, day, instant, month_of, month_start, since
from meterstone.operators.usage import name_users

ACCESS_COLUMNS = [
    "user_name", "user_id", "granted_at", "monthly_credit_limit", "is_active", "revoked_at", "revocation_reason",
]

# ---- month spend and the spend alert -------------------------------------------------------------


def month_usage(usage: DataFrame, as_of: Instant) -> DataFrame:
    """Usage from the start of the month up to ``as_of``."""
    return since(usage, "start_time", month_start(as_of), as_of)


def month_spend(usage: DataFrame, as_of: Instant) -> DataFrame:
    """Credits since the start of the month, 0 when there are none."""
    return month_usage(usage, as_of).agg(sum_or_zero("credits").alias("credits"))


def month_spend_exceeds(usage: DataFrame, as_of: Instant, threshold: Decimal) -> DataFrame:
    """One row when month spend is above the threshold, none otherwise (also none without usage)."""
    spent = month_usage(usage, as_of).agg(F.sum("credits").alias("credits"))
    return spent.where(F.col("credits") > threshold).select(F.lit(1).alias("exceeded"))


def spend_alert(usage: DataFrame, alert_state: DataFrame, as_of: Instant, threshold: Decimal) -> DataFrame:
    """Verdict of one check: alert already sent this month, threshold not exceeded, or alert sent."""
    month = F.trunc(day(as_of), "month")
    sent = alert_state.where((F.col("alert_name") == SPEND_ALERT_NAME) & (F.col("alert_month") == month)).exists()
    above = F.col("credits") > threshold
    verdict = (
        F.when(sent, "already sent").when(~above, "not exceeded").otherwise("sent")
    )
    message = (
        F.when(sent, ALERT_ALREADY_SENT)
        .when(~above, fill(ALERT_NOT_EXCEEDED, F.col("credits"), F.lit(str(threshold))))
        .otherwise(fill(ALERT_SENT, F.col("credits")))
    )
    return month_spend(usage, as_of).select(
        F.lit(SPEND_ALERT_NAME).alias("alert_name"), month.alias("alert_month"), "credits",
        verdict.alias("verdict"), message.alias("message"),
    )


def alert_mail(alerts: DataFrame, threshold: Decimal) -> DataFrame:
    """Subject and body for each alert row (of ``new_alerts``)."""
    body = fill(ALERT_BODY, F.col("credits_at_alert"), F.lit(str(threshold)))
    return alerts.select("alert_month", F.lit(ALERT_SUBJECT).alias("subject"), body.alias("body"))


def new_alerts(month_totals: DataFrame, alert_state: DataFrame, threshold: Decimal, sent_at: Column) -> DataFrame:
    """Rows to add to the alert state: months above the threshold that have no alert yet."""
    above = month_totals.where(F.col("credits") > threshold).select(
        F.lit(SPEND_ALERT_NAME).alias("alert_name"), "alert_month", sent_at.alias("sent_at"),
        F.col("credits").alias("credits_at_alert"),
    )
    return above.join(alert_state.select("alert_name", "alert_month"), ["alert_name", "alert_month"], "left_anti")


def month_totals(usage: DataFrame) -> DataFrame:
    """Credits of every calendar month."""
    month = F.to_date(F.date_trunc("month", "start_time"))
    return usage.groupBy(month.alias("alert_month")).agg(F.sum("credits").alias("credits"))


def first_breach(usage: DataFrame, threshold: Decimal) -> DataFrame:
    """The first hourly check of each month that finds spend above the threshold.

    Usage is summed per hour first, so the running sum sees at most 744 rows per month.
    """
    hour = F.date_trunc("hour", "start_time")
    hourly = usage.groupBy(hour.alias("hour")).agg(F.sum("credits").alias("credits"))
    month = F.to_date(F.date_trunc("month", "hour"))
    so_far = F.sum("credits").over(
        Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = hourly.withColumn("month", month).withColumn("spent", so_far)
    return running.where(F.col("spent") > threshold).groupBy("month").agg(
        F.min("hour").alias("breach_hour"), F.min_by("spent", "hour").alias("spent_at_breach")
    )


# ---- per-user monthly limits --------------------------------------------------------------------------


def user_month_spend(usage: DataFrame, as_of: Instant) -> DataFrame:
    return month_usage(usage, as_of).groupBy("user_id").agg(F.sum("credits").alias("total_credits"))


def _with_spend(access: DataFrame, spend: DataFrame) -> DataFrame:
    joined = access.join(spend, "user_id", "left")
    return joined.withColumn("credits_used", F.coalesce("total_credits", F.lit(0)).cast(CREDITS)).drop("total_credits")


def _over_limit() -> Column:
    return F.coalesce(F.col("is_active") & (F.col("credits_used") > F.col("monthly_credit_limit")), F.lit(False))


def limit_enforcement(access: DataFrame, spend: DataFrame) -> DataFrame:
    """One REVOKED row per active user who spent more than their limit."""
    return _with_spend(access, spend).where(_over_limit()).select(
        "user_name", "credits_used", F.col("monthly_credit_limit").alias("credit_limit"), F.lit("REVOKED").alias("action")
    )


def enforced_access(access: DataFrame, spend: DataFrame, as_of: Instant) -> DataFrame:
    """Access table after enforcement: over-limit users inactive, with time and reason."""
    over = _over_limit()
    return _with_spend(access, spend).withColumns({
        "is_active": F.when(over, F.lit(False)).otherwise(F.col("is_active")),
        "revoked_at": F.when(over, instant(as_of)).otherwise(F.col("revoked_at")),
        "revocation_reason": F.when(over, LIMIT_REASON).otherwise(F.col("revocation_reason")),
    }).select(*ACCESS_COLUMNS)


def revoked_access(access: DataFrame, users: DataFrame, as_of: Instant | Column) -> DataFrame:
    """Access rows of ``users`` (user_name) that are still active, as they are once revoked."""
    stamp = as_of if isinstance(as_of, Column) else instant(as_of)
    hit = access.where("is_active").join(users.select("user_name").hint("merge"), "user_name", "left_semi")
    return hit.withColumns({"is_active": F.lit(False), "revoked_at": stamp, "revocation_reason": F.lit(LIMIT_REASON)}).select(*ACCESS_COLUMNS)


def granted_access(access: DataFrame, users: DataFrame, as_of: Instant | Column) -> DataFrame:
    """Access rows of ``users`` (user_name, month) as they are once reinstated at the start of the month."""
    back = users.groupBy("user_name").agg(F.max("month").cast("timestamp").alias("since"))
    hit = access.join(back.hint("merge"), "user_name")
    none = F.lit(None)
    return hit.withColumns({"is_active": F.lit(True), "granted_at": F.col("since"), "revoked_at": none.cast("timestamp"), "revocation_reason": none.cast("string")}).select(*ACCESS_COLUMNS)


def access_control_status(access: DataFrame) -> DataFrame:
    return access.select(*ACCESS_COLUMNS).orderBy("user_name")


def grant_upsert(
    access: DataFrame, grants: DataFrame, users: DataFrame, as_of: Instant, default_limit: Decimal = DEFAULT_MONTHLY_LIMIT
) -> DataFrame:
    """Access table after a batch of grants (user_name, monthly_credit_limit, requested_at).

    A granted user becomes active with the limit of the newest request (of equally new ones the highest), and loses any revocation;
    a new name gets a row. All other rows stay as they are.
    """
    newest = grants.groupBy("user_name").agg(
        F.max(F.struct("requested_at", "monthly_credit_limit"))["monthly_credit_limit"].alias("asked")
    )
    ids = users.groupBy(F.col("name").alias("user_name")).agg(F.min("user_id").alias("found_id"))
    asked = newest.join(ids, "user_name", "left").select(
        "user_name", "found_id", F.coalesce("asked", F.lit(default_limit)).cast(CREDITS).alias("asked_limit"),
        F.lit(True).alias("granted"),
    )
    joined = access.join(asked, "user_name", "full_outer")
    granted = F.coalesce("granted", F.lit(False))
    return joined.select(
        "user_name",
        F.when(granted, F.col("found_id")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(granted, instant(as_of)).otherwise(F.col("granted_at")).alias("granted_at"),
        F.when(granted, F.col("asked_limit")).otherwise(F.col("monthly_credit_limit")).alias("monthly_credit_limit"),
        F.when(granted, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(~granted, F.col("revoked_at")).alias("revoked_at"),
        F.when(~granted, F.col("revocation_reason")).alias("revocation_reason"),
    )


def grant_messages(grants: DataFrame, default_limit: Decimal = DEFAULT_MONTHLY_LIMIT) -> DataFrame:
    limit = F.coalesce("monthly_credit_limit", F.lit(default_limit)).cast(CREDITS)
    return grants.select("user_name", fill(ACCESS_GRANTED, F.col("user_name"), limit).alias("message"))


def monthly_reinstate(access: DataFrame) -> DataFrame:
    """One GRANTED row per listed user, with the user's own limit."""
    return access.select("user_name", F.col("monthly_credit_limit").alias("credit_limit"), F.lit("GRANTED").alias("action"))


def reinstated_access(access: DataFrame, users: DataFrame, as_of: Instant) -> DataFrame:
    """Access table at the start of a month: every listed user active again, revocations cleared."""
    own = access.select("user_name", "monthly_credit_limit", instant(as_of).alias("requested_at"))
    return grant_upsert(access, own, users, as_of)


# ---- runaway work ----------------------------------------------------------------------------------------


def runaway_rows(usage: DataFrame, users: DataFrame, threshold: Decimal) -> DataFrame:
    """Unfinished usage rows above the credit threshold, as CANCELLED action rows.

    Filters only and a lookup, so the same function serves tables and streams.
    """
    unfinished = usage.where((F.col("credits") > threshold) & ~F.col("is_completed"))
    return name_users(unfinished, users).select(
        "query_id", F.col("username").alias("user_name"), "function_name", "model_name", "credits", "start_time",
        F.lit("CANCELLED").alias("action"),
    )


def runaway_detection(
    usage: DataFrame, users: DataFrame, as_of: Instant, threshold: Decimal, hours: int = 48, per: str = "row"
) -> DataFrame:
    """Runaway work of the last hours. ``per='query'`` compares the sum of a query's windows instead of each row."""
    recent = since(usage, "start_time", before(as_of, hours=hours), as_of)
    if per == "query":
        recent = recent.where(~F.col("is_completed")).groupBy(
            "query_id", "user_id", "function_name", "model_name", "is_completed"
        ).agg(F.sum("credits").alias("credits"), F.min("start_time").alias("start_time"))
    return runaway_rows(recent, users, threshold)


def runaway_messages(actions: DataFrame) -> DataFrame:
    """Subject and body of the message sent for each cancelled query; a NULL part makes the body NULL."""
    body = fill(
        RUNAWAY_BODY, F.col("query_id"), F.coalesce("user_name", F.lit(UNKNOWN_USER)), F.col("function_name"), F.col("model_name"),
        F.col("credits"), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"),
    )
    return actions.select("query_id", fill(RUNAWAY_SUBJECT, F.col("query_id")).alias("subject"), body.alias("body"))


def recipients(text_column: str) -> Column:
    """Addresses of a comma-separated list, blanks around each removed."""
    return F.transform(F.split(text_column, ","), lambda part: F.trim(part))


# ---- daily limits of the code assistants -----------------------------------------------------------------


def daily_limits_scan(*listings: DataFrame) -> DataFrame:
    """Parameter listings put together: lower-case names, and only the known columns that occur."""
    combined = None
    for listing in listings:
        lower = listing.toDF(*[c.lower() for c in listing.columns])
        combined = lower if combined is None else combined.unionByName(lower, allowMissingColumns=True)
    known = [c for c in ("key", "value", "default", "level", "description") if c in combined.columns]
    return combined.select(*known) if known else combined


def effective_daily_limit(user_limits: DataFrame, account_limits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Limit of each (user, surface): the user's own, else the account default, else none (-1)."""
    own = user_limits.select("user_id", "surface", F.col("daily_limit").alias("own_limit"))
    default = account_limits.select("surface", F.col("daily_limit").alias("account_limit"))
    joined = pairs.join(own, ["user_id", "surface"], "left").join(default, "surface", "left")
    limit = F.coalesce("own_limit", "account_limit", F.lit(-1)).cast(CREDITS)
    return joined.withColumn("daily_limit", limit).drop("own_limit", "account_limit")


def daily_limit_check(usage: DataFrame, user_limits: DataFrame, account_limits: DataFrame) -> DataFrame:
    """Daily credits per user and surface against the limit in force: -1 is no limit, 0 blocks all use."""
    daily = usage.groupBy("user_id", "surface", F.to_date("usage_time").alias("usage_day")).agg(
        F.sum("token_credits").alias("credits")
    )
    checked = effective_daily_limit(user_limits, account_limits, daily)
    limit = F.col("daily_limit")
    status = (
        F.when(limit < 0, "NO_LIMIT").when(limit == 0, "BLOCKED").when(F.col("credits") > limit, "OVER_LIMIT").otherwise("WITHIN_LIMIT")
    )
    return checked.select("user_id", "surface", "usage_day", "credits", "daily_limit", status.alias("status"))


# ---- budgets -----------------------------------------------------------------------------------------------


def tag_spend(usage: DataFrame, tags: DataFrame) -> DataFrame:
    """Credits per cost-center tag and month. Agents without a tag are left out.

    Usage is summed per agent before the tag lookup.
    """
    month = F.to_date(F.date_trunc("month", "start_time"))
    per_agent = usage.groupBy("agent_name", month.alias("month")).agg(F.sum("token_credits").alias("credits"))
    return per_agent.join(tags, "agent_name", "inner").groupBy("tag_value", "month").agg(F.sum("credits").alias("credits"))


def budget_thresholds(
    spend: DataFrame, budgets: DataFrame, notify_percent: int = DEFAULT_NOTIFY_PERCENT, revoke_percent: int = DEFAULT_REVOKE_PERCENT
) -> DataFrame:
    """Spend as percent of each budget, and the highest action it calls for in that month (``budget_actions`` lists all).

    Spend is per month, so a new month starts at zero again.
    """
    for percent in (notify_percent, revoke_percent):
        if not 1 <= percent <= 500:
            raise ValueError("a percent threshold must lie between 1 and 500")
    joined = spend.join(budgets, "tag_value", "inner")
    used, limit = F.col("credits"), F.col("monthly_limit")
    reached = lambda percent: used.cast("decimal(28,6)") * 100 >= limit.cast("decimal(28,6)") * percent
    action = F.when(reached(revoke_percent), "REVOKE").when(reached(notify_percent), "NOTIFY").otherwise("NONE")
    percent = F.round(F.try_divide(used.cast("double") * 100, limit.cast("double")), 2).cast("decimal(18,2)")
    return joined.select("tag_value", "month", "credits", "monthly_limit", percent.alias("percent_used"), action.alias("action"))


def budget_actions(
    spend: DataFrame, budgets: DataFrame, notify_percent: int = DEFAULT_NOTIFY_PERCENT, revoke_percent: int = DEFAULT_REVOKE_PERCENT
) -> DataFrame:
    """One row per action: NOTIFY and REVOKE when their own percentage is reached, and REINSTATE at the start of the month after a REVOKE."""
    rows = budget_thresholds(spend, budgets, notify_percent, revoke_percent)
    reached = lambda percent: F.col("credits").cast("decimal(28,6)") * 100 >= F.col("monthly_limit").cast("decimal(28,6)") * percent
    action = lambda name, month, test: F.when(test, F.struct(F.lit(name).alias("action"), month.alias("month")))
    listed = F.array_compact(F.array(
        action("NOTIFY", F.col("month"), reached(notify_percent)), action("REVOKE", F.col("month"), reached(revoke_percent)),
        action("REINSTATE", F.add_months("month", 1), reached(revoke_percent)),
    ))
    return rows.select("tag_value", F.explode(listed).alias("a")).select("tag_value", "a.month", "a.action")


def budget_usage(services: DataFrame, start_month: str, end_month: str) -> DataFrame:
    """Credits by month and service between two ``YYYY-MM`` months, both included."""
    first, last = month_of(start_month), month_of(end_month)
    after = (last.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    kept = services.where((F.col("start_time") >= F.lit(first)) & (F.col("start_time") < F.lit(after)))
    month = F.date_format("start_time", "yyyy-MM")
    return kept.groupBy(month.alias("month"), "service").agg(F.sum("credits").alias("credits"))
