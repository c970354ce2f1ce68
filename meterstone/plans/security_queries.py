"""Detector, compliance and cost model queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterstone.operators import compliance as c
from meterstone.operators import costmodel as m
from meterstone.operators import detect as d
from meterstone.operators import governance as g
from meterstone.operators import sketches
from meterstone.plans.governance_queries import DURATIONS, RATES
from meterstone.plans.registry import query
from meterstone.session import work_folder

AS_OF = dt.date(2024, 1, 31)
GRANTS_AS_OF = dt.date(2001, 7, 1)
SINCE = dt.date(2024, 1, 24)
MINIMUM_VERSIONS = {"connector-a": "3.10", "connector-b": "5.2.1"}
ADMIN = "('ACCOUNTADMIN', 'SECURITYADMIN')"


@query("D01", "SELECT user_id, name FROM accounts WHERE kind = 'PERSON' AND has_password AND NOT has_mfa AND NOT is_disabled")
def non_mfa_persons(v):
    return d.non_mfa_persons(v.accounts)


@query("D02", "SELECT user_id, name, kind FROM accounts WHERE kind IN ('SERVICE', 'LEGACY_SERVICE') AND has_password AND NOT is_disabled")
def password_service_users(v):
    return d.password_service_users(v.accounts)


@query("D03", f"""SELECT user_id, role_name, granted_on FROM role_grants WHERE role_name IN {ADMIN}
AND granted_on BETWEEN TIMESTAMP '2001-06-30' AND TIMESTAMP '2001-07-01'""")
def new_admin_grants(v):
    return d.new_admin_grants(v.role_grants, GRANTS_AS_OF)


@query("D04", """SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS failures
FROM logins WHERE NOT is_success GROUP BY ALL HAVING count(*) >= 2""")
def auth_failures(v):
    return d.auth_failures(v.logins, 2, "1 day")


@query("D05", """SELECT user_id, date_trunc('day', start_time) AS window_start, date_trunc('day', start_time) + INTERVAL 1 DAY AS window_end,
count(*) AS errors FROM query_history WHERE is_error GROUP BY ALL HAVING count(*) >= 2""")
def job_errors(v):
    return d.job_errors(v.query_history, 2)


@query("D06", """SELECT q.entity, query_id, user_id, start_time, duration_seconds FROM query_history q JOIN (
SELECT entity, s / n + 3.0 * sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS lim FROM (SELECT entity, CAST(count(*) AS DOUBLE) AS n,
CAST(sum(duration_seconds) AS DOUBLE) AS s, CAST(sum(duration_seconds * duration_seconds) AS DOUBLE) AS q FROM query_history GROUP BY 1)) l
ON q.entity = l.entity WHERE duration_seconds > l.lim""")
def long_query_outliers(v):
    return d.long_query_outliers(v.query_history)


@query("D06", """WITH q AS (SELECT *, CAST(start_time AS DATE) AS day FROM query_history WHERE duration_seconds IS NOT NULL),
d AS (SELECT DISTINCT entity, day FROM q),
l AS (SELECT d.entity, d.day, list_sort(list(p.duration_seconds)) AS x FROM d JOIN q p ON p.entity = d.entity AND p.day BETWEEN d.day - INTERVAL 30 DAY AND d.day - INTERVAL 1 DAY GROUP BY ALL)
SELECT q.entity, query_id, user_id, start_time, duration_seconds, x[CAST(ceil(0.99 * len(x)) AS INTEGER)] AS "limit"
FROM q JOIN l ON q.entity = l.entity AND q.day = l.day WHERE duration_seconds > x[CAST(ceil(0.99 * len(x)) AS INTEGER)]""")
def long_query_outliers_by_quantile(v):
    """Longer than 99 percent of the entity's queries of the 30 days before, from daily sketches."""
    folder = work_folder(v.spark, "durations")
    sketches.daily_durations(v.query_history).write.parquet(folder)
    return sketches.long_query_outliers(v.query_history, v.spark.read.parquet(folder))


FIRST_SEEN = """SELECT user_id, {key}, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS seen_before,
count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS logins, min(ts) FILTER (ts >= TIMESTAMP '2024-01-24') AS first_seen
FROM logins WHERE is_success GROUP BY 1, 2"""


@query("D07", f"SELECT * FROM ({FIRST_SEEN.format(key='client_app')}) WHERE logins > 0 AND seen_before <= 1")
def unusual_app(v):
    return d.unusual_app(v.logins, SINCE, at_most=1)


@query("D07", """WITH a AS (SELECT user_id, client_app, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS seen_before, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS logins,
min(ts) FILTER (ts >= TIMESTAMP '2024-01-24') AS first_seen FROM logins WHERE is_success GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(seen_before) OVER (PARTITION BY user_id) AS BIGINT) AS logins_before FROM a)
SELECT user_id, client_app, seen_before, logins_before, logins, first_seen FROM t WHERE logins > 0 AND logins_before >= 10 AND seen_before < logins_before * 0.05""")
def rare_app(v):
    """Rare as a share of the user's own logins."""
    return d.rare_app(v.logins, SINCE)


@query("D10", """SELECT user_id, client_ip, count(*) AS logins, min(ts) AS first_seen FROM logins l WHERE is_success AND ts >= TIMESTAMP '2024-01-24'
AND NOT EXISTS (SELECT 1 FROM logins p WHERE p.is_success AND p.user_id = l.user_id AND p.client_ip = l.client_ip
AND p.ts < TIMESTAMP '2024-01-24') GROUP BY 1, 2""")
def unusual_ip_login(v):
    return d.unusual_ip_login(v.logins, SINCE)


@query("D09", """SELECT user_id, previous_login, ts AS login_at FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS previous_login
FROM logins WHERE is_success) WHERE ts >= previous_login + INTERVAL 2 DAY""")
def dormant_login(v):
    return d.dormant_login(v.logins, 2)


CHANGES = "SELECT * FROM change_events WHERE action IN ('CREATE', 'ALTER', 'DROP')"


@query("D08", f"{CHANGES} AND object_kind = 'AUTHENTICATION POLICY'")
def auth_policy_changes(v):
    return d.auth_policy_changes(v.change_events)


@query("D11", f"{CHANGES} AND object_kind = 'NETWORK POLICY'")
def network_policy_changes(v):
    return d.network_policy_changes(v.change_events)


@query("D12", f"{CHANGES} AND object_kind = 'PARAMETER' AND object_name IN ('NETWORK_POLICY', 'PREVENT_UNLOAD_TO_INLINE_URL')")
def sensitive_param_changes(v):
    return d.sensitive_param_changes(v.change_events)


@query("D13", f"{CHANGES} AND object_kind IN ('PASSWORD POLICY', 'SESSION POLICY')")
def policy_changes(v):
    return d.policy_changes(v.change_events)


def _rule_values() -> str:
    rows = ", ".join(f"('{r.rule}', '{r.parameter}', '{r.test}', {r.bound or 'NULL'})" for r in c.PARAMETER_RULES)
    return f"(VALUES {rows}) AS r(rule, parameter, test, bound)"


@query("G01", f"""SELECT a.account_id, r.rule, r.parameter, p.value, CASE WHEN (r.test = 'set' AND trim(p.value) <> '')
OR (r.test = 'true' AND upper(p.value) = 'TRUE') OR (r.test = 'equal' AND TRY_CAST(p.value AS BIGINT) = r.bound)
OR (r.test = 'at least' AND TRY_CAST(p.value AS BIGINT) >= r.bound) THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT DISTINCT account_id FROM parameters) a CROSS JOIN {_rule_values()}
LEFT JOIN parameters p ON a.account_id = p.account_id AND r.parameter = p.parameter""")
def param_rules(v):
    return c.param_rules(v.parameters)


@query("G02", """SELECT user_id, 'CIS 1.4' AS rule FROM accounts WHERE kind = 'PERSON' AND has_password AND NOT has_mfa
UNION ALL SELECT user_id, 'CIS 1.6' FROM accounts WHERE kind = 'LEGACY_SERVICE' AND NOT has_key_pair
UNION ALL SELECT user_id, 'CIS 1.7' FROM accounts WHERE key_set_at < TIMESTAMP '2024-01-31' - INTERVAL 180 DAY
UNION ALL SELECT user_id, 'CIS 1.8' FROM accounts WHERE NOT is_disabled AND (last_login_at IS NULL OR last_login_at < TIMESTAMP '2024-01-31' - INTERVAL 90 DAY)
UNION ALL SELECT user_id, 'CIS 3.2' FROM accounts WHERE kind LIKE '%SERVICE' AND network_policy IS NULL""")
def user_hygiene(v):
    return c.user_hygiene(v.accounts, AS_OF)


INHERIT = """walk AS (SELECT grantee_role AS role_name, 1 AS depth FROM role_hierarchy WHERE granted_role IN ('ACCOUNTADMIN', 'SECURITYADMIN')
UNION SELECT h.grantee_role, w.depth + 1 FROM walk w JOIN role_hierarchy h ON h.granted_role = w.role_name),
inherited AS (SELECT role_name, min(depth) AS depth FROM walk GROUP BY 1)"""


@query("G03", f"WITH RECURSIVE {INHERIT} SELECT * FROM inherited")
def roles_with_admin(v):
    return c.roles_with_admin(v.role_hierarchy)


@query("G03", f"""WITH RECURSIVE {INHERIT}
SELECT 'CIS 1.10' AS rule, role_name AS subject FROM role_grants WHERE role_name IN {ADMIN} GROUP BY role_name HAVING count(DISTINCT user_id) > 3
UNION ALL SELECT 'CIS 1.11', name FROM accounts WHERE email IS NULL AND user_id IN (SELECT user_id FROM role_grants WHERE role_name = 'ACCOUNTADMIN')
UNION ALL SELECT 'CIS 1.12', name FROM accounts WHERE default_role IN {ADMIN}
UNION ALL SELECT 'CIS 1.13', role_name FROM inherited""")
def admin_roles(v):
    return c.admin_roles(v.role_grants, v.accounts, v.role_hierarchy)


@query("G04", f"""SELECT object_id, object_kind, CASE object_kind WHEN 'TASK' THEN 'CIS 1.14' ELSE 'CIS 1.16' END AS rule FROM code_objects WHERE owner_role IN {ADMIN}
UNION ALL SELECT object_id, object_kind, CASE object_kind WHEN 'TASK' THEN 'CIS 1.15' ELSE 'CIS 1.17' END FROM code_objects
WHERE coalesce(run_as_role, owner_role) IN {ADMIN}""")
def privileged_code(v):
    return c.privileged_code(v.code_objects)


GRANT_RULES = f"""SELECT *, CASE WHEN object_kind = 'ROLE GRANT' AND object_name IN {ADMIN} THEN 'CIS 2.1'
WHEN object_kind = 'PRIVILEGE GRANT' AND object_name = 'MANAGE GRANTS' THEN 'CIS 2.2' END AS rule FROM change_events WHERE action <> 'SHOW'"""


@query("G05", f"""SELECT * FROM ({GRANT_RULES} UNION ALL SELECT *, CASE object_kind WHEN 'SECURITY INTEGRATION' THEN 'CIS 2.5'
WHEN 'NETWORK POLICY' THEN 'CIS 2.6' WHEN 'PROVISIONING TOKEN' THEN 'CIS 2.7' WHEN 'SHARE' THEN 'CIS 2.8' END FROM ({CHANGES})) WHERE rule IS NOT NULL""")
def change_monitor(v):
    return c.change_monitor(v.change_events)


@query("G06", """SELECT login_id, ts, user_id, 'CIS 2.4' AS rule FROM logins WHERE is_success AND first_factor = 'PASSWORD' AND second_factor IS NULL
UNION ALL SELECT login_id, ts, user_id, 'CIS 2.9' FROM logins WHERE (client_kind = 'connector-a' AND CAST(string_split(client_version, '.') AS INTEGER[]) < [3, 10])
OR (client_kind = 'connector-b' AND CAST(string_split(client_version, '.') AS INTEGER[]) < [5, 2, 1])""")
def session_monitor(v):
    return c.session_monitor(v.logins, MINIMUM_VERSIONS)


@query("G07", """SELECT object_name AS subject, 'CIS 4.2' AS rule FROM stages WHERE stage_kind = 'INTERNAL' AND encryption IS DISTINCT FROM 'AES-256'
UNION ALL SELECT object_name, 'CIS 4.7' FROM stages WHERE stage_kind = 'EXTERNAL' AND storage_integration IS NULL
UNION ALL SELECT table_name || '.' || column_name, 'CIS 4.10' FROM sensitive_columns s WHERE is_sensitive AND NOT EXISTS (SELECT 1 FROM policy_references p
  WHERE p.policy_kind = 'MASKING' AND p.table_name = s.table_name AND p.column_name = s.column_name)
UNION ALL SELECT DISTINCT table_name, 'CIS 4.11' FROM sensitive_columns s WHERE is_sensitive AND NOT EXISTS (SELECT 1 FROM policy_references p
  WHERE p.policy_kind = 'ROW_ACCESS' AND p.table_name = s.table_name)""")
def object_coverage(v):
    return c.object_coverage(v.stages, v.sensitive_columns, v.policy_references)


SCENARIOS = """WITH share AS (SELECT scanner_package_id AS package, CAST(CAST(count(*) FILTER (upper(s.state) = 'TRUE'{on}) AS DOUBLE) / count(*) AS DECIMAL(9,6)) AS share
FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id GROUP BY 1),
rate AS (SELECT * FROM (VALUES ('everything daily', 'CIS_BENCHMARKS', 30, 365), ('everything daily', 'THREAT_INTELLIGENCE', 30, 365),
('CIS weekly, threat daily', 'CIS_BENCHMARKS', 4, 52), ('CIS weekly, threat daily', 'THREAT_INTELLIGENCE', 30, 365),
('CIS monthly, threat weekly', 'CIS_BENCHMARKS', 1, 12), ('CIS monthly, threat weekly', 'THREAT_INTELLIGENCE', 4, 52),
('both off', 'CIS_BENCHMARKS', 0, 0), ('both off', 'THREAT_INTELLIGENCE', 0, 0),
('free package only', 'CIS_BENCHMARKS', 0, 0), ('free package only', 'THREAT_INTELLIGENCE', 0, 0)) AS t(scenario, package, m, y)),
credit AS (SELECT * FROM (VALUES ('CIS_BENCHMARKS', 0.5, 2.0), ('THREAT_INTELLIGENCE', 0.2, 1.5)) AS t(package, low, high)),
s AS (SELECT scenario, CAST(sum(low * m * share) AS DECIMAL(28,6)) AS monthly_low, CAST(sum(high * m * share) AS DECIMAL(28,6)) AS monthly_high,
CAST(floor(CAST(sum(low * y * share) AS DECIMAL(28,6))) AS BIGINT) AS annual_low, CAST(ceil(CAST(sum(high * y * share) AS DECIMAL(28,6))) AS BIGINT) AS annual_high
FROM rate JOIN share USING (package) JOIN credit USING (package) GROUP BY 1)
SELECT *, CAST(annual_low * 3 AS DECIMAL(28,2)) AS annual_cost_low, CAST(annual_high * 3 AS DECIMAL(28,2)) AS annual_cost_high FROM s"""


@query("C01", SCENARIOS.format(on=""))
def scenario_cost(v):
    """All packages taken as switched on."""
    return m.scenario_cost(m.package_share(v.scanners))


@query("C01", SCENARIOS.format(on=" AND upper(p.state) = 'TRUE'"))
def current_scenario_cost(v):
    """Packages that are off cost nothing."""
    return m.scenario_cost(m.package_share(v.scanners, v.scanner_packages))


ADVICE = f"""SELECT scanner_package_name, d.scanner_name, avg_duration_sec, tier, overlap, CASE WHEN scanner_package_name = 'Security Essentials' THEN 'KEEP'
WHEN overlap = 'YES' THEN 'DISABLE' WHEN overlap = 'PARTIAL' AND tier = 'HIGH' THEN 'DISABLE IF MONITORED' WHEN overlap = 'PARTIAL' THEN 'DISABLE'
WHEN tier = 'LOW' THEN 'DISABLE, RARELY CHANGES' ELSE 'KEEP' END AS recommendation FROM (SELECT t.*, coalesce(o.overlap, 'NO') AS overlap FROM (
SELECT *, CASE WHEN avg_duration_sec >= 17 THEN 'HIGH' WHEN avg_duration_sec >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ({DURATIONS})) t
LEFT JOIN monitoring_overlap o ON t.scanner_name = o.scanner_name AND t.scanner_package_name = o.scanner_package_name) d"""


@query("C02", ADVICE)
def scanner_recommendations(v):
    return m.recommendations(g.scan_durations(v.findings), v.monitoring_overlap)


@query("C02", f"""WITH a AS (SELECT upper(replace(scanner_package_name, ' ', '_')) AS package, recommendation, avg_duration_sec AS s FROM ({ADVICE})),
prices(package, low, high) AS (VALUES ('SECURITY_ESSENTIALS', 0, 0), ('CIS_BENCHMARKS', 0.5, 2), ('THREAT_INTELLIGENCE', 0.1, 0.5)),
parts AS (SELECT a.*, CAST(s AS DOUBLE) / sum(CAST(s AS DOUBLE)) OVER (PARTITION BY package) AS part, low, high FROM a JOIN prices USING (package))
SELECT recommendation, count(*) AS scanners, CAST(sum(s) AS DECIMAL(28,1)) AS seconds, CAST(round(sum(part * low), 4) AS DECIMAL(18,4)) AS credits_low,
CAST(round(sum(part * high), 4) AS DECIMAL(18,4)) AS credits_high FROM parts GROUP BY 1""")
def savings_plan(v):
    return m.savings_plan(m.recommendations(g.scan_durations(v.findings), v.monitoring_overlap))


# Every minute of the month is tested; one schedule cannot be read, and one has no run in it.
SCHEDULED = """SELECT id, scanner_package_id, schedule, CASE WHEN schedule LIKE '%MON-FRI%' THEN NULL ELSE (SELECT count(*) FROM
(SELECT unnest(generate_series(TIMESTAMP '2001-07-01', TIMESTAMP '2001-07-31 23:59:00', INTERVAL 1 MINUTE)) AS t) WHERE CASE schedule
WHEN 'USING CRON 16 8 * * * UTC' THEN hour(t) = 8 AND minute(t) = 16 WHEN 'USING CRON 0 6 * * 1 UTC' THEN dayofweek(t) = 1 AND hour(t) = 6 AND minute(t) = 0
WHEN 'USING CRON 0 6 7 * * UTC' THEN day(t) = 7 AND hour(t) = 6 AND minute(t) = 0
WHEN 'USING CRON 0 6 9,24 * * UTC' THEN day(t) IN (9, 24) AND hour(t) = 6 AND minute(t) = 0 WHEN 'USING CRON 0 * * * * UTC' THEN minute(t) = 0
WHEN 'USING CRON 0 6,18 * * * UTC' THEN hour(t) IN (6, 18) AND minute(t) = 0
WHEN 'USING CRON */20 8-10 * * 1-5 UTC' THEN dayofweek(t) BETWEEN 1 AND 5 AND hour(t) BETWEEN 8 AND 10 AND minute(t) % 20 = 0 ELSE FALSE END) END AS runs
FROM scanners WHERE upper(state) = 'TRUE'"""
JULY = "start_timestamp >= TIMESTAMP '2001-07-01' AND start_timestamp < TIMESTAMP '2001-08-01'"


@query("C03", SCHEDULED)
def scheduled_runs(v):
    return m.scheduled_runs(v.scanners, dt.date(2001, 7, 1), dt.date(2001, 7, 31))


@query("C04", f"""WITH e AS (SELECT scanner_package_id, CAST(sum(runs) AS BIGINT) AS scheduled_runs FROM ({SCHEDULED}) GROUP BY 1),
a AS (SELECT upper(replace(scanner_package_name, ' ', '_')) AS scanner_package_id, total_scan_runs, runs_per_day
FROM ({RATES.replace("FROM findings", f"FROM findings WHERE {JULY}")}))
SELECT scanner_package_id, scheduled_runs, CAST(round(scheduled_runs / 31, 1) AS DECIMAL(18,1)) AS scheduled_per_day, total_scan_runs, runs_per_day
FROM e LEFT JOIN a USING (scanner_package_id)""")
def expected_vs_actual_runs(v):
    first, last = dt.date(2001, 7, 1), dt.date(2001, 7, 31)
    seen = v.findings.where((F.col("start_timestamp") >= F.lit(first)) & (F.col("start_timestamp") < F.lit(last + dt.timedelta(days=1))))
    return m.expected_vs_actual_runs(m.scheduled_runs(v.scanners, first, last), g.run_rate(seen), 31)
