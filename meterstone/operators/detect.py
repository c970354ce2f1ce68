"""Detectors over accounts, grants, logins, query runs and change events.

The detectors that only filter (changes) or count per time window (failures, errors) take a table or a
stream alike.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.fixed_values import ADMIN_ROLES
from meterstone.functions.time import Instant, instant, within

CHANGE_ACTIONS = ("CREATE", "ALTER", "DROP")
SENSITIVE_PARAMETERS = ("NETWORK_POLICY", "PREVENT_UNLOAD_TO_INLINE_URL")


# ---- accounts and grants ---------------------------------------------------------------------------


def non_mfa_persons(accounts: DataFrame) -> DataFrame:
    """Active people who sign in with a password and no second factor."""
    risky = (F.col("kind") == "PERSON") & F.col("has_password") & ~F.col("has_mfa") & ~F.col("is_disabled")
    return accounts.where(risky).select("user_id", "name")


def password_service_users(accounts: DataFrame) -> DataFrame:
    """Active service users of either kind that still have a password."""
    risky = F.col("kind").isin("SERVICE", "LEGACY_SERVICE") & F.col("has_password") & ~F.col("is_disabled")
    return accounts.where(risky).select("user_id", "name", "kind")


def new_admin_grants(grants: DataFrame, as_of: Instant, hours: int = 24, roles: tuple[str, ...] = ADMIN_ROLES) -> DataFrame:
    recent = grants.where(F.col("role_name").isin(*roles) & within("granted_on", as_of, hours=hours))
    return recent.select("user_id", "role_name", "granted_on")


# ---- counts per window -------------------------------------------------------------------------------


def _frequent(rows: DataFrame, ts: str, n: int, window: str, count: str) -> DataFrame:
    counted = rows.groupBy("user_id", F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias(count))
    return counted.where(F.col(count) >= n).select(
        "user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), count
    )


def auth_failures(logins: DataFrame, n: int, window: str = "1 hour") -> DataFrame:
    """Users with ``n`` or more failed logins in a window."""
    return _frequent(logins.where(~F.col("is_success")), "ts", n, window, "failures")


def job_errors(queries: DataFrame, n: int, window: str = "1 day") -> DataFrame:
    """Users with ``n`` or more failed queries in a window."""
    return _frequent(queries.where("is_error"), "start_time", n, window, "errors")


def long_query_outliers(queries: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Queries longer than their entity's mean by more than ``deviations`` standard deviations.

    The entity's figures come from exact integer sums, so they do not depend on the order of rows.
    """
    seconds = F.col("duration_seconds")
    exact = seconds.cast("decimal(19,0)")
    sums = queries.where(seconds.isNotNull()).groupBy("entity").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(exact).cast("double").alias("s"),
        F.sum((exact * exact).cast("decimal(38,0)")).cast("double").alias("q"),
    )
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    limits = sums.select("entity", (mean + F.lit(deviations) * spread).alias("limit"))
    # The limits are one row per entity. A hot entity is split on the query side when Spark shuffles.
    joined = queries.join(limits, "entity", "inner").where(seconds > F.col("limit"))
    return joined.select("entity", "query_id", "user_id", "start_time", "duration_seconds")


# ---- logins that differ from the past ---------------------------------------------------------------------


def _first_seen(logins: DataFrame, key: str, since: Instant, at_most: int | None) -> DataFrame:
    """One aggregation gives both the past count and the recent logins of each (user, key); all of them without ``at_most``."""
    recent = F.col("ts") >= instant(since)
    found = logins.where("is_success").groupBy("user_id", key).agg(
        F.count_if(~recent).alias("seen_before"), F.count_if(recent).alias("logins"),
        F.min(F.when(recent, F.col("ts"))).alias("first_seen"),
    )
    return found if at_most is None else found.where((F.col("logins") > 0) & (F.col("seen_before") <= at_most))


def unusual_app(logins: DataFrame, since: Instant, at_most: int = 0) -> DataFrame:
    """Apps a user has used since a time, and at most ``at_most`` times before it."""
    return _first_seen(logins, "client_app", since, at_most)


def rare_app(logins: DataFrame, since: Instant, share: Decimal = Decimal("0.05"), at_least: int = 10) -> DataFrame:
    """Apps a user has used since a time, and before it in less than ``share`` of at least ``at_least`` logins.

    Logins are counted per user and app first, so a busy user is a few rows when the user's own total is looked up.
    """
    seen = _first_seen(logins, "client_app", since, None)
    totals = seen.groupBy(F.col("user_id").alias("u")).agg(F.sum("seen_before").alias("logins_before"))
    rare = F.col("seen_before") < F.col("logins_before") * F.lit(share)
    return seen.join(totals, F.col("user_id").eqNullSafe(F.col("u"))).where((F.col("logins") > 0) & (F.col("logins_before") >= at_least) & rare).select(
        "user_id", "client_app", "seen_before", "logins_before", "logins", "first_seen")


def unusual_ip_login(logins: DataFrame, since: Instant) -> DataFrame:
    """Addresses a user logs in from since a time and never before."""
    return _first_seen(logins, "client_ip", since, 0).drop("seen_before")


def active_days(logins: DataFrame) -> DataFrame:
    """First and last login of each user on each day."""
    return logins.where("is_success").groupBy("user_id", F.to_date("ts").alias("login_day")).agg(
        F.min("ts").alias("first_login"), F.max("ts").alias("last_login")
    )


def dormant_login(logins: DataFrame, days: int = 90) -> DataFrame:
    """Logins after ``days`` or more days without one.

    A gap of a day or more always lies between two days, so one row per user and day is enough for an
    exact answer, and no user's logins are gathered in one task.
    """
    if days < 1:
        raise ValueError("days must be 1 or more")
    previous = F.lag("last_login").over(Window.partitionBy("user_id").orderBy("login_day"))
    gaps = active_days(logins).withColumn("previous_login", previous)
    return gaps.where(_gap_reached(F.col("previous_login"), F.col("first_login"), days)).select(
        "user_id", "previous_login", F.col("first_login").alias("login_at")
    )


def _gap_reached(before: Column, after: Column, days: int) -> Column:
    return after >= before + F.make_dt_interval(F.lit(days))


# ---- change events -----------------------------------------------------------------------------------------


def is_grant_event(*kinds: str) -> Column:
    """A grant was given, taken back or changed."""
    return F.col("object_kind").isin(*kinds) & F.col("action").isin("GRANT", "REVOKE", *CHANGE_ACTIONS)


def is_change(*kinds: str) -> Column:
    return F.col("object_kind").isin(*kinds) & F.col("action").isin(*CHANGE_ACTIONS)


def auth_policy_changes(events: DataFrame) -> DataFrame:
    return events.where(is_change("AUTHENTICATION POLICY"))


def network_policy_changes(events: DataFrame) -> DataFrame:
    return events.where(is_change("NETWORK POLICY"))


def sensitive_param_changes(events: DataFrame, names: tuple[str, ...] = SENSITIVE_PARAMETERS) -> DataFrame:
    return events.where(is_change("PARAMETER") & F.col("object_name").isin(*names))


def policy_changes(events: DataFrame) -> DataFrame:
    return events.where(is_change("PASSWORD POLICY", "SESSION POLICY"))
