"""Usage and cost queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterstone.fixed_values import DEFAULT_RATES
from meterstone.functions.amounts import with_commas
from meterstone.functions.time import cutoff_date
from meterstone.operators import sketches
from meterstone.operators import usage as u
from meterstone.plans.registry import query
from meterstone.session import work_folder
from meterstone.sources import sinks
from meterstone.sources.views import Views

AS_OF = dt.date(2024, 1, 31)
FIRST_DAY = cutoff_date(AS_OF, 21)
MINUTES = 5
STANDARD, AI = DEFAULT_RATES["standard"], DEFAULT_RATES["ai"]

SINCE = "DATE '2024-01-10'"



def metric(name: str) -> str:
    """Largest value of a metric over the copies of a row."""
    return f"max(list_max([m.value for m in metrics if m.metric = '{name}']))"


def ai_rows_sql(since: str) -> str:
    return f"""base AS (
  SELECT start_time, end_time, function_name, model_name, query_id, warehouse_id, credits, is_completed, user_id,
    {metric('input')} AS i, {metric('output')} AS o, {metric('total')} AS t
  FROM ai_usage WHERE start_time >= {since} GROUP BY ALL
), ai AS (
  SELECT * EXCLUDE (user_id, i, o, t), (SELECT name FROM users WHERE users.user_id = base.user_id) AS username,
    CASE WHEN i IS NOT NULL THEN i WHEN t IS NOT NULL THEN t ELSE 0 END AS input_tokens, ifnull(o, 0) AS output_tokens
  FROM base
)"""


AI_ROWS = ai_rows_sql(SINCE)

CODE = """SELECT c.user_id, u.name AS username, c.request_id, c.usage_time AS start_time, c.token_credits AS credits, c.tokens
  FROM {table} c LEFT JOIN users u ON c.user_id = u.user_id WHERE CAST(c.usage_time AS DATE) >= """ + SINCE

# Table, time column and amount column of each service beside the AI functions.
PLAIN_SERVICES = {
    "analyst": ("analyst_usage", "start_time", "credits"), "search": ("search_usage", "start_time", "credits"),
    "intelligence": ("intelligence_usage", "start_time", "token_credits"), "agents": ("agent_usage", "start_time", "token_credits"),
    "code_cli": ("code_cli_usage", "usage_time", "token_credits"), "code_web": ("code_web_usage", "usage_time", "token_credits"),
}


def services_sql(since: str) -> str:
    parts = [f"SELECT '{service}', {ts}, {amount} FROM {table} WHERE {ts} >= {since}" for service, (table, ts, amount) in PLAIN_SERVICES.items()]
    return ai_rows_sql(since) + ", services(service, start_time, credits) AS (SELECT 'ai_functions', start_time, credits FROM ai UNION ALL " + " UNION ALL ".join(parts) + ")"


SERVICES = services_sql(SINCE) + """, priced AS (
  SELECT service, sum(credits) AS credits, CAST(CAST(sum(credits) AS DECIMAL(28,6)) * CAST(CASE WHEN service IN
    ('ai_functions', 'analyst', 'search') THEN 3.40 ELSE 2.00 END AS DECIMAL(8,2)) AS DECIMAL(38,8)) AS cost
  FROM services GROUP BY service
)"""

LONG = f"""windows AS (
  SELECT query_id, function_name, model_name, (SELECT name FROM users WHERE users.user_id = ai_usage.user_id) AS username,
    list(start_time) AS starts, list(end_time) AS ends, list(credits) AS amounts
  FROM ai_usage WHERE start_time >= {SINCE} GROUP BY ALL
), found AS (
  SELECT query_id, function_name, model_name, username, list_min(starts) AS first_window, list_max(ends) AS last_window,
    len(starts) AS window_count, CAST(list_sum(amounts) AS DECIMAL(38,6)) AS total_credits,
    date_diff('minute', list_min(starts), list_max(ends)) AS duration_minutes
  FROM windows WHERE len(starts) > 1
)"""


def ai(v: Views):
    return u.ai_rows(v.ai_usage, FIRST_DAY)


def found(v: Views):
    return u.long_running(v.ai_usage, v.users, FIRST_DAY)


def services(v: Views, first_day: dt.date = FIRST_DAY):
    return u.all_services({
        "ai_functions": v.ai_usage, "analyst": v.analyst_usage, "search": v.search_usage,
        "intelligence": v.intelligence_usage, "agents": v.agent_usage,
        "code_cli": v.code_cli_usage, "code_web": v.code_web_usage,
    }, first_day)


@query("S01 A01 J01 J04 P01 P17", f"WITH {AI_ROWS} SELECT model_name, username, sum(credits) AS credits, "
       "CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM ai GROUP BY 1, 2")
def ai_by_model_and_user(v):
    return u.ai_by_model_and_user(ai(v), v.users)


@query("S01 J01 J04 P02", f"WITH {AI_ROWS} SELECT * FROM ai")
def load_ai_functions(v):
    return u.load_ai_functions(v.ai_usage, v.users, FIRST_DAY)


@query("A01", f"""WITH {AI_ROWS} SELECT start_time, end_time, function_name, model_name, query_id, warehouse_id, credits,
is_completed, user_id, i AS input_tokens, o AS output_tokens, t AS total_tokens_raw FROM base""")
def metric_pivot(v):
    return u.metric_pivot(u.since_date(v.ai_usage, "start_time", FIRST_DAY))


FROM_BASE = """start_time, end_time, function_name, model_name, query_id, warehouse_id, credits, is_completed, user_id,
i AS input_tokens, o AS output_tokens, t AS total_tokens_raw FROM base"""


@query("A01 J04", f"WITH {AI_ROWS} SELECT {FROM_BASE}")
def metric_pivot_from_text(v):
    """The same, with the metric lists kept as JSON text."""
    kept = u.since_date(v.ai_usage, "start_time", FIRST_DAY).withColumn("metrics", F.to_json("metrics"))
    return u.metric_pivot(kept.withColumn("metrics", u.parse_metrics("metrics")))


@query("A01 J04", f"WITH {AI_ROWS} SELECT {FROM_BASE}")
def metric_pivot_from_variant(v):
    """The same, with the metric lists kept as variants."""
    kept = u.since_date(v.ai_usage, "start_time", FIRST_DAY).withColumn("metrics", F.parse_json(F.to_json("metrics")))
    return u.metric_pivot(kept.withColumn("metrics", u.metrics_of_variant("metrics")))


@query("A01", f"""SELECT model_name, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, sum(credits) AS credits FROM (
SELECT model_name, c.credits, (SELECT max(m.value) FROM (SELECT unnest(c.metrics) AS m) WHERE m.metric = 'input') AS i
FROM ai_usage c WHERE CAST(start_time AS DATE) >= {SINCE}) GROUP BY 1""")
def metric_pivot_all_copies(v):
    """Copies stay, and nothing is shuffled before the sums."""
    rows = u.metric_pivot(u.since_date(v.ai_usage, "start_time", FIRST_DAY), keep_copies=True)
    return rows.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("credits").alias("credits")
    )


@query("A02 A03 A16", f"""WITH {SERVICES} SELECT service, format('{{:,.6f}}', CAST(credits AS DOUBLE)) AS credits_text,
format('{{:,.2f}}', CAST(cost AS DOUBLE)) AS cost_text FROM priced WHERE credits > 0""")
def service_breakdown_text(v):
    """Headline figures as text."""
    rows = u.service_breakdown(services(v))
    return rows.select(
        "service", with_commas(F.col("credits"), 6).alias("credits_text"), with_commas(F.col("cost"), 2).alias("cost_text")
    )


@query("K04 P02 A04", f"SELECT CAST(start_time AS DATE) AS usage_day, sum(credits) AS credits FROM ai_usage WHERE CAST(start_time AS DATE) >= {SINCE} GROUP BY 1")
def stored_usage_by_day(v):
    """Usage written as a table partitioned by day, then read for the days of the report only."""
    folder = work_folder(v.spark, "usage")
    sinks.write_usage_table(v.ai_usage, folder)
    return u.daily_credits(u.since_date(v.spark.read.parquet(folder), "start_time", FIRST_DAY))


@query("P02 A05 K04", "SELECT user_id, model_name, sum(credits) AS credits FROM ai_usage WHERE user_id BETWEEN 20 AND 24 GROUP BY ALL")
def z_ordered_usage_by_user(v):
    """Usage written along a curve through hour, user and model; the user filter skips row groups inside every day."""
    folder = work_folder(v.spark, "curve")
    sinks.write_z_ordered_usage(v.ai_usage, folder)
    kept = v.spark.read.parquet(folder).where(F.col("user_id").between(20, 24))
    return kept.groupBy("user_id", "model_name").agg(F.sum("credits").alias("credits"))


@query("A13 A14 A15 A16", """SELECT model_name, count(DISTINCT user_id) AS users, count(DISTINCT query_id) AS queries FROM ai_usage
WHERE CAST(start_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' GROUP BY ALL""")
def model_users_over_span(v):
    """Different users and queries of each model, merged from the daily sketches of the span."""
    folder = work_folder(v.spark, "daily-usage")
    sketches.daily_usage(v.ai_usage, 18).write.parquet(folder)
    return sketches.usage_over(v.spark.read.parquet(folder), "2024-01-05", "2024-01-18", ["model_name"])


@query("S02 P02 O02", f"SELECT start_time, end_time, username, credits, request_count FROM analyst_usage WHERE CAST(start_time AS DATE) >= {SINCE}")
def load_analyst(v):
    return u.newest_first(u.load_analyst(v.analyst_usage, FIRST_DAY))


@query("S03 P02 O02", f"SELECT * FROM search_usage WHERE CAST(start_time AS DATE) >= {SINCE}")
def load_search(v):
    return u.newest_first(u.load_search(v.search_usage, FIRST_DAY))


@query("S04 P01", f"SELECT * EXCLUDE (user_name, token_credits), user_name AS username, token_credits AS credits FROM intelligence_usage WHERE CAST(start_time AS DATE) >= {SINCE}")
def load_intelligence(v):
    return u.newest_first(u.load_intelligence(v.intelligence_usage, FIRST_DAY))


@query("S05 P01", f"SELECT * EXCLUDE (user_name, token_credits), user_name AS username, token_credits AS credits FROM agent_usage WHERE CAST(start_time AS DATE) >= {SINCE}")
def load_agents(v):
    return u.newest_first(u.load_agents(v.agent_usage, FIRST_DAY))


@query("S06 J01", CODE.format(table="code_cli_usage"))
def load_code_cli(v):
    return u.newest_first(u.load_code(v.code_cli_usage, v.users, FIRST_DAY))


@query("S07 J01", CODE.format(table="code_web_usage"))
def load_code_web(v):
    return u.newest_first(u.load_code(v.code_web_usage, v.users, FIRST_DAY))


@query("S19", "SELECT name FROM users WHERE name <> ''")
def list_users(v):
    return u.list_users(v.users)


@query("A02 U02", f"WITH {SERVICES} SELECT coalesce(sum(credits), 0) AS total_credits FROM services")
def total_credits(v):
    return u.total_credits(services(v))


@query("A03 J06 P17", f"WITH {SERVICES} SELECT sum(credits) AS total_credits, CAST(sum(cost) AS DECIMAL(38,8)) AS total_cost FROM priced")
def blended_cost(v):
    return u.blended_cost(services(v))


@query("A11 P15 W02 J06", f"""WITH {SERVICES} SELECT service, credits, cost,
CAST(round_even(CAST(cost AS DOUBLE) / CAST(sum(cost) OVER () AS DOUBLE) * 100, 1) / 100 AS DECIMAL(9,3)) AS share
FROM priced WHERE credits > 0""")
def service_breakdown(v):
    return u.service_breakdown(services(v))


@query("A10 U02 P13", f"WITH {SERVICES} SELECT CAST(start_time AS DATE) AS usage_day, service, sum(credits) AS credits FROM services GROUP BY 1, 2")
def daily_by_service(v):
    return u.daily_by_service(services(v))


@query("A04", f"WITH {AI_ROWS} SELECT CAST(start_time AS DATE) AS usage_day, sum(credits) AS credits FROM ai GROUP BY 1")
def daily_credits(v):
    return u.daily_credits(ai(v))


@query("A05", f"WITH {AI_ROWS} SELECT username, sum(credits) AS credits FROM ai WHERE username IS NOT NULL GROUP BY 1")
def credits_by_user(v):
    return u.credits_by_named_user(ai(v), v.users)


@query("A05", f"SELECT username, sum(credits) AS credits FROM analyst_usage WHERE CAST(start_time AS DATE) >= {SINCE} AND username IS NOT NULL GROUP BY 1")
def credits_by_analyst_user(v):
    return u.credits_by_user(u.load_analyst(v.analyst_usage, FIRST_DAY))


@query("A06", f"WITH {AI_ROWS} SELECT model_name, sum(credits) AS credits FROM ai WHERE model_name IS NOT NULL GROUP BY 1")
def credits_by_model(v):
    return u.credits_by_model(ai(v))


@query("A07", f"WITH {AI_ROWS} SELECT function_name, sum(credits) AS credits FROM ai GROUP BY 1")
def credits_by_function(v):
    return u.credits_by_function(ai(v))


@query("A08", f"SELECT service_name, sum(credits) AS credits FROM search_usage WHERE CAST(start_time AS DATE) >= {SINCE} GROUP BY 1")
def credits_by_search_service(v):
    return u.credits_by_search_service(u.load_search(v.search_usage, FIRST_DAY))


@query("A09", f"WITH {AI_ROWS} SELECT CAST(start_time AS DATE) AS usage_day, model_name, sum(credits) AS credits FROM ai GROUP BY 1, 2")
def daily_by_model(v):
    return u.daily_by_model(ai(v))


@query("A12", f"""SELECT CAST(start_time AS DATE) AS usage_day, sum(token_credits) AS credits, CAST(sum(tokens) AS BIGINT) AS tokens
FROM agent_usage WHERE CAST(start_time AS DATE) >= {SINCE} GROUP BY 1""")
def summary_by_day(v):
    return u.summary_by_day(u.load_agents(v.agent_usage, FIRST_DAY))


@query("A12", f"SELECT CAST(start_time AS DATE) AS usage_day, sum(credits) AS credits FROM search_usage WHERE CAST(start_time AS DATE) >= {SINCE} GROUP BY 1")
def search_summary_by_day(v):
    return u.summary_by_day(u.load_search(v.search_usage, FIRST_DAY))


@query("A13", f"""WITH {AI_ROWS} SELECT CAST(start_time AS DATE) AS usage_day, sum(credits) AS credits,
CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
count(DISTINCT query_id) AS queries FROM ai GROUP BY 1""")
def ai_by_day(v):
    return u.ai_by_day(ai(v))


@query("A14 P17", f"""WITH {AI_ROWS} SELECT username, sum(credits) AS credits, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
count(DISTINCT query_id) AS queries FROM ai WHERE username IS NOT NULL GROUP BY 1""")
def ai_by_user(v):
    return u.ai_by_user(ai(v), v.users)


@query("A15", f"""WITH {AI_ROWS} SELECT model_name, sum(credits) AS credits, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(DISTINCT query_id) AS queries FROM ai WHERE model_name IS NOT NULL GROUP BY 1""")
def ai_by_model(v):
    return u.ai_by_model(ai(v))


@query("P01 O02", f"""WITH {AI_ROWS} SELECT CAST(start_time AS DATE) AS usage_day, function_name, model_name, username,
input_tokens, output_tokens, credits FROM ai""")
def ai_detail(v):
    return u.ai_detail(u.load_ai_functions(v.ai_usage, v.users, FIRST_DAY))


@query("P01 O02", f"SELECT start_time, username, credits, request_count FROM analyst_usage WHERE CAST(start_time AS DATE) >= {SINCE}")
def analyst_detail(v):
    return u.detail(u.load_analyst(v.analyst_usage, FIRST_DAY), ["start_time", "username", "credits", "request_count"])


@query("A16 P17", f"""WITH {AI_ROWS} SELECT sum(credits) AS credits, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(DISTINCT username) AS unique_users,
CAST(CAST(sum(credits) AS DECIMAL(28,6)) * CAST(3.40 AS DECIMAL(8,2)) AS DECIMAL(38,8)) AS cost FROM ai""")
def kpi_row(v):
    return u.ai_kpi_row(ai(v), v.users)


@query("A16", f"""SELECT sum(credits) AS credits, count(DISTINCT service_name) AS services,
CAST(CAST(sum(credits) AS DECIMAL(28,6)) * CAST(3.40 AS DECIMAL(8,2)) AS DECIMAL(38,8)) AS cost
FROM search_usage WHERE CAST(start_time AS DATE) >= {SINCE}""")
def search_kpi_row(v):
    return u.kpi_row(u.load_search(v.search_usage, FIRST_DAY), STANDARD, distinct={"services": "service_name"})


@query("A16", f"""SELECT sum(token_credits) AS credits, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT user_name) AS unique_users,
CAST(CAST(sum(token_credits) AS DECIMAL(28,6)) * CAST(2.00 AS DECIMAL(8,2)) AS DECIMAL(38,8)) AS cost
FROM agent_usage WHERE CAST(start_time AS DATE) >= {SINCE}""")
def agent_kpi_row(v):
    return u.kpi_row(u.load_agents(v.agent_usage, FIRST_DAY), AI, ("tokens",), {"unique_users": "username"})


@query("A17 P16 J01", f"WITH {LONG} SELECT * FROM found")
def long_running(v):
    return found(v)


@query("A18 P11", f"""WITH {LONG} SELECT count(*) AS queries, coalesce(sum(total_credits), 0) AS total_credits, max(duration_minutes) AS max_duration_minutes,
CAST(CAST(coalesce(sum(total_credits), 0) AS DECIMAL(28,6)) * CAST(3.40 AS DECIMAL(8,2)) AS DECIMAL(38,8)) AS cost FROM found WHERE duration_minutes >= {MINUTES}""")
def long_running_kpis(v):
    return u.long_running_kpis(found(v), MINUTES)


@query("A19", f"WITH {LONG} SELECT model_name, sum(total_credits) AS credits FROM found WHERE duration_minutes >= {MINUTES} AND model_name IS NOT NULL GROUP BY 1")
def long_running_by_model(v):
    return u.long_running_by(found(v), MINUTES, "model_name")


@query("A19", f"WITH {LONG} SELECT username, sum(total_credits) AS credits FROM found WHERE duration_minutes >= {MINUTES} AND username IS NOT NULL GROUP BY 1")
def long_running_by_user(v):
    return u.long_running_by(found(v), MINUTES, "username")


@query("A20", f"""WITH {LONG}, kept AS (SELECT duration_minutes AS d FROM found WHERE duration_minutes >= {MINUTES}),
r AS (SELECT min(d) AS low, (max(d) - min(d)) // 20 + 1 AS width FROM kept)
SELECT low + ((d - low) // width) * width AS bin_start, low + ((d - low) // width) * width + width AS bin_end, count(*) AS queries
FROM kept, r GROUP BY 1, 2""")
def duration_histogram(v):
    return u.duration_histogram(found(v), MINUTES)
