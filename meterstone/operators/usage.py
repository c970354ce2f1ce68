"""Usage history: loading, token metrics, and credits by day, user, model, function and service.

User names live in a separate table. The per-user reports first sum by ``user_id`` and look names up
on the small result, so the usage rows themselves are never shuffled for a join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.fixed_values import DEFAULT_RATES
from meterstone.functions.amounts import cost, fraction, rate_of, sum_or_zero
from meterstone.functions.time import minutes_between_marks, since_date

ROW_KEY = [
    "start_time", "end_time", "function_name", "model_name", "query_id",
    "warehouse_id", "credits", "is_completed", "user_id",
]
METRICS_SCHEMA = "array<struct<key:struct<metric:string>,value:bigint>>"


# ---- loading ---------------------------------------------------------------------------------


def parse_metrics(text_column: str) -> Column:
    """Metric list kept as JSON text, turned into the array the other functions read."""
    return F.from_json(text_column, METRICS_SCHEMA)


def metrics_of_variant(column: str) -> Column:
    """Metric list kept as a variant; NULL when it has another shape."""
    return F.try_variant_get(F.col(column), "$", METRICS_SCHEMA)


def metric_value(metrics: str, name: str) -> Column:
    """Largest value of one metric in a row's list; NULL for a missing, empty or NULL list.

    The list is sorted by name and value, largest first, so the first entry of a name is the wanted one. All
    parts are plain expressions, which keeps the scan and the following aggregation in one generated stage.
    """
    items = F.col(metrics)
    pairs = F.sort_array(F.arrays_zip(items["key"]["metric"].alias("name"), items["value"].alias("value")), asc=False)
    return F.get(pairs["value"], F.array_position(pairs["name"], name) - 1)


def metric_pivot(usage: DataFrame, keep_copies: bool = False) -> DataFrame:
    """One row per distinct usage row, with its input, output and total token counts.

    Each list is read inside its row, so no row is multiplied before the shuffle. Rows equal in all
    nine columns become one. With ``keep_copies`` every row stays, and no shuffle
    is needed at all.
    """
    values = usage.select(
        *ROW_KEY,
        metric_value("metrics", "input").alias("input_tokens"),
        metric_value("metrics", "output").alias("output_tokens"),
        metric_value("metrics", "total").alias("total_tokens_raw"),
    )
    if keep_copies:
        return values
    return values.groupBy(*ROW_KEY).agg(
        F.max("input_tokens").alias("input_tokens"),
        F.max("output_tokens").alias("output_tokens"),
        F.max("total_tokens_raw").alias("total_tokens_raw"),
    )


def ai_rows(usage: DataFrame, first_day: dt.date, keep_copies: bool = False) -> DataFrame:
    """AI-function usage since a day, tokens filled in, users still by id."""
    rows = metric_pivot(since_date(usage, "start_time", first_day), keep_copies)
    return rows.select(
        *ROW_KEY,
        F.coalesce("input_tokens", "total_tokens_raw", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
    )


def name_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``username``; a user missing from the table gets NULL.

    No broadcast is forced: Spark copies the user table when it is small enough and otherwise
    shuffles both sides, splitting a user that holds very many rows.
    """
    return df.join(users.select("user_id", F.col("name").alias("username")), "user_id", "left")


def load_ai_functions(usage: DataFrame, users: DataFrame, first_day: dt.date, keep_copies: bool = False) -> DataFrame:
    named = name_users(ai_rows(usage, first_day, keep_copies), users)
    return named.select(
        "start_time", "end_time", "function_name", "model_name", "query_id", "warehouse_id",
        "credits", "is_completed", "username", "input_tokens", "output_tokens",
    )


def load_analyst(usage: DataFrame, first_day: dt.date) -> DataFrame:
    return since_date(usage, "start_time", first_day).select(
        "start_time", "end_time", "username", "credits", "request_count"
    )


def load_search(usage: DataFrame, first_day: dt.date) -> DataFrame:
    return since_date(usage, "start_time", first_day).select(
        "start_time", "end_time", "database_name", "schema_name", "service_name", "credits"
    )


def load_intelligence(usage: DataFrame, first_day: dt.date) -> DataFrame:
    return since_date(usage, "start_time", first_day).select(
        "start_time", "end_time", F.col("user_name").alias("username"), "workspace_name",
        "agent_database_name", "agent_schema_name", "agent_name", F.col("token_credits").alias("credits"), "tokens",
    )


def load_agents(usage: DataFrame, first_day: dt.date) -> DataFrame:
    return since_date(usage, "start_time", first_day).select(
        "start_time", "end_time", F.col("user_name").alias("username"),
        "agent_database_name", "agent_schema_name", "agent_name", F.col("token_credits").alias("credits"), "tokens",
    )


def load_code(usage: DataFrame, users: DataFrame, first_day: dt.date) -> DataFrame:
    """Per-request usage of either code assistant surface."""
    recent = since_date(usage, "usage_time", first_day)
    return name_users(recent, users).select(
        "user_id", "username", "request_id", F.col("usage_time").alias("start_time"),
        F.col("token_credits").alias("credits"), "tokens",
    )


def newest_first(df: DataFrame, ts: str = "start_time") -> DataFrame:
    """Detail rows in the order of a listing. Loaders leave rows as the scan gives them: only what is shown needs an order.

    The other columns order rows of one time, so a busy hour is sorted by several tasks.
    """
    return df.orderBy(F.col(ts).desc_nulls_last(), *[c for c in df.columns if c != ts])


def list_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("name") != "").select("name")


# ---- totals over one or all services -----------------------------------------------------------


# Time and credit columns of each service's usage table; AI functions go through ``ai_rows``.
SERVICE_COLUMNS = {
    "ai_functions": ("start_time", "credits"),
    "analyst": ("start_time", "credits"),
    "search": ("start_time", "credits"),
    "intelligence": ("start_time", "token_credits"),
    "agents": ("start_time", "token_credits"),
    "code_cli": ("usage_time", "token_credits"),
    "code_web": ("usage_time", "token_credits"),
}


def all_services(tables: Mapping[str, DataFrame], first_day: dt.date) -> DataFrame:
    """Rows of every service in one frame (service, start_time, credits), unsorted and without names."""
    parts = []
    for service, table in tables.items():
        ts, amount = SERVICE_COLUMNS[service]
        rows = ai_rows(table, first_day) if service == "ai_functions" else since_date(table, ts, first_day)
        parts.append(rows.select(F.lit(service).alias("service"), F.col(ts).alias("start_time"), F.col(amount).alias("credits")))
    return reduce(DataFrame.unionByName, parts)


def total_credits(df: DataFrame) -> DataFrame:
    return df.agg(sum_or_zero("credits").alias("total_credits"))


def blended_cost(services: DataFrame, rates: Mapping[str, Decimal] | None = None) -> DataFrame:
    """Total credits and dollars, each service at the price of its class."""
    by_service = services.groupBy("service").agg(F.sum("credits").alias("credits"))
    priced = by_service.withColumn("cost", cost(F.col("credits"), rate_of("service", rates)))
    return priced.agg(
        sum_or_zero("credits").alias("total_credits"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,8)").alias("total_cost"),
    )


def service_breakdown(services: DataFrame, rates: Mapping[str, Decimal] | None = None) -> DataFrame:
    """Credits, dollars and share of dollars per service that used any credits."""
    by_service = services.groupBy("service").agg(F.sum("credits").alias("credits")).where("credits > 0")
    priced = by_service.withColumn("cost", cost(F.col("credits"), rate_of("service", rates)))
    # The window holds one row per service, at most as many as there are services.
    whole = F.sum("cost").over(Window.partitionBy())
    return priced.withColumn("share", fraction(F.col("cost"), whole)).orderBy(F.col("credits").desc(), "service")


def daily_by_service(services: DataFrame) -> DataFrame:
    return services.groupBy(F.to_date("start_time").alias("usage_day"), "service").agg(F.sum("credits").alias("credits"))


# ---- one service --------------------------------------------------------------------------------


def daily_credits(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("start_time").alias("usage_day")).agg(F.sum("credits").alias("credits"))


def summary_by_day(df: DataFrame) -> DataFrame:
    """Credits per day, and tokens when the service counts them, newest day first."""
    sums = [F.sum("credits").alias("credits")]
    if "tokens" in df.columns:
        sums.append(F.sum("tokens").alias("tokens"))
    return df.groupBy(F.to_date("start_time").alias("usage_day")).agg(*sums).orderBy(F.col("usage_day").desc_nulls_last())


def credits_by(df: DataFrame, key: str) -> DataFrame:
    """Credits per value of one column, highest first; rows without a value are left out."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("credits").alias("credits"))
    return sums.orderBy(F.col("credits").desc_nulls_last(), key)


def credits_by_user(df: DataFrame) -> DataFrame:
    """For services whose rows already carry a user name."""
    return credits_by(df, "username")


def credits_by_named_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """For rows that carry a user id: sum by id, then look names up on the sums."""
    by_id = rows.groupBy("user_id").agg(F.sum("credits").alias("credits"))
    return credits_by(name_users(by_id, users), "username")


def credits_by_model(df: DataFrame) -> DataFrame:
    return credits_by(df, "model_name")


def credits_by_function(df: DataFrame) -> DataFrame:
    return credits_by(df, "function_name")


def credits_by_search_service(df: DataFrame) -> DataFrame:
    return credits_by(df, "service_name")


def daily_by_model(df: DataFrame) -> DataFrame:
    named = df.where(F.col("model_name").isNotNull())
    return named.groupBy(F.to_date("start_time").alias("usage_day"), "model_name").agg(F.sum("credits").alias("credits"))


def ai_by_day(rows: DataFrame) -> DataFrame:
    per_day = rows.groupBy(F.to_date("start_time").alias("usage_day")).agg(
        F.sum("credits").alias("credits"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count_distinct("query_id").alias("queries"),
    )
    return per_day.orderBy(F.col("usage_day").desc_nulls_last())


def ai_by_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Credits, tokens and distinct queries per user name, highest credits first."""
    per_query = rows.groupBy("user_id", "query_id").agg(
        F.sum("credits").alias("credits"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")
    )
    named = name_users(per_query, users).where(F.col("username").isNotNull())
    return named.groupBy("username").agg(
        F.sum("credits").alias("credits"), F.sum("tokens").alias("total_tokens"),
        F.count_distinct("query_id").alias("queries"),
    ).orderBy(F.col("credits").desc_nulls_last(), "username")


def ai_by_model(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("model_name").isNotNull()).groupBy("model_name").agg(
        F.sum("credits").alias("credits"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count_distinct("query_id").alias("queries"),
    ).orderBy(F.col("credits").desc_nulls_last(), "model_name")


def ai_by_model_and_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Credits and tokens per model and user; users without a name stay, as one NULL name."""
    sums = ["credits", "input_tokens", "output_tokens"]
    by_id = rows.groupBy("model_name", "user_id").agg(*[F.sum(c).alias(c) for c in sums])
    return name_users(by_id, users).groupBy("model_name", "username").agg(*[F.sum(c).alias(c) for c in sums])


def ai_detail(loaded: DataFrame) -> DataFrame:
    """Row listing of the loaded AI usage, newest day first."""
    return newest_first(loaded.select(
        F.to_date("start_time").alias("usage_day"), "function_name", "model_name", "username",
        "input_tokens", "output_tokens", "credits",
    ), "usage_day")


def detail(df: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns of any service, newest first."""
    return newest_first(df.select(*columns))


def kpi_row(df: DataFrame, rate: Decimal, tokens: tuple[str, ...] = (), distinct: Mapping[str, str] | None = None) -> DataFrame:
    """One row of headline figures: credits, dollars, token sums and distinct counts (NULL not counted)."""
    sums = [sum_or_zero("credits").alias("credits")]
    sums += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens]
    sums += [F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()]
    row = df.agg(*sums)
    return row.withColumn("cost", cost(F.col("credits"), rate))


def ai_kpi_row(rows: DataFrame, users: DataFrame, rate: Decimal = DEFAULT_RATES["standard"]) -> DataFrame:
    """Headline figures of AI functions; users are counted by name, on per-user sums."""
    sums = ["credits", "input_tokens", "output_tokens"]
    by_id = rows.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in sums])
    return kpi_row(name_users(by_id, users), rate, ("input_tokens", "output_tokens"), {"unique_users": "username"})


# ---- long-running queries -------------------------------------------------------------------------


def long_running(usage: DataFrame, users: DataFrame, first_day: dt.date) -> DataFrame:
    """Queries seen in more than one usage window, longest first. NULL names form a group here."""
    group = ["query_id", "function_name", "model_name"]
    by_id = since_date(usage, "start_time", first_day).groupBy(*group, "user_id").agg(
        F.min("start_time").alias("first_window"), F.max("end_time").alias("last_window"),
        F.count(F.lit(1)).alias("window_count"), F.sum("credits").alias("total_credits"),
    )
    by_name = name_users(by_id, users).groupBy(*group, "username").agg(
        F.min("first_window").alias("first_window"), F.max("last_window").alias("last_window"),
        F.sum("window_count").alias("window_count"), F.sum("total_credits").alias("total_credits"),
    )
    minutes = minutes_between_marks(F.col("first_window"), F.col("last_window"))
    return by_name.where("window_count > 1").withColumn("duration_minutes", minutes).orderBy(
        F.col("duration_minutes").desc_nulls_last(), *group, "username"
    )


def at_least(found: DataFrame, minutes: int) -> DataFrame:
    """Long-running queries of ``minutes`` or more."""
    return found.where(F.col("duration_minutes") >= minutes)


def long_running_kpis(found: DataFrame, minutes: int, rate: Decimal = DEFAULT_RATES["standard"]) -> DataFrame:
    row = at_least(found, minutes).agg(
        F.count(F.lit(1)).alias("queries"), sum_or_zero("total_credits").alias("total_credits"),
        F.max("duration_minutes").alias("max_duration_minutes"),
    )
    return row.withColumn("cost", cost(F.col("total_credits"), rate))


def long_running_by(found: DataFrame, minutes: int, key: str) -> DataFrame:
    kept = at_least(found, minutes).where(F.col(key).isNotNull())
    return kept.groupBy(key).agg(F.sum("total_credits").alias("credits"))


def duration_histogram(found: DataFrame, minutes: int, max_bins: int = 20) -> DataFrame:
    """Queries per duration bin, over at most ``max_bins`` bins of one whole-minute width.

    Durations are first counted per minute; the range is a one-row aggregate of these counts, read as a scalar.
    """
    counts = at_least(found, minutes).groupBy("duration_minutes").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("duration_minutes").alias("low"), F.max("duration_minutes").alias("high"))
    ranged = counts.select("duration_minutes", "n", ends.select(F.struct("low", "high")).scalar().alias("ends"))
    low = F.col("ends.low")
    width = F.floor((F.col("ends.high") - low) / max_bins) + 1
    bin_start = low + F.floor((F.col("duration_minutes") - low) / width) * width
    bins = ranged.select(bin_start.alias("bin_start"), (bin_start + width).alias("bin_end"), "n")
    return bins.groupBy("bin_start", "bin_end").agg(F.sum("n").alias("queries"))

