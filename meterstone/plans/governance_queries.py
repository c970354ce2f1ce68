"""Scanner inventory, finding and check queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterstone.operators import governance as g
from meterstone.operators import sketches
from meterstone.plans.registry import query
from meterstone.session import work_folder
from meterstone.sources import sinks
from meterstone.sources import views as w
from meterstone.streaming.tables import run_closed, state_partitions, stream_table

SCAN_AS_OF = dt.date(2001, 8, 1)
NOW = "TIMESTAMP '2001-08-01'"
PAID = "scanner_package_name <> 'Security Essentials'"


def last(days: int, ts: str = "start_timestamp") -> str:
    return f"{ts} BETWEEN {NOW} - INTERVAL {days} DAY AND {NOW}"


@query("S08 O01", "SELECT * FROM scanner_packages")
def list_packages(v):
    return g.list_packages(v.scanner_packages)


@query("S09 J02 O01", """SELECT s.id, s.name AS scanner_name, s.short_description, s.state, s.schedule, s.notification,
s.last_scan_timestamp, p.name AS package_name FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id""")
def list_scanners(v):
    return g.list_scanners(v.scanners, v.scanner_packages)


@query("P03 J02", """SELECT s.id, s.name AS scanner_name, s.short_description, s.schedule, s.last_scan_timestamp, p.name AS package_name
FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id WHERE upper(s.state) = 'TRUE'""")
def enabled_scanners(v):
    return g.enabled_scanners(v.scanners, v.scanner_packages)


@query("P04 J02", """SELECT s.id, s.name AS scanner_name, s.short_description, p.name AS package_name, p.state AS package_state
FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id WHERE s.state IS NULL OR upper(s.state) <> 'TRUE'""")
def disabled_scanners(v):
    return g.disabled_scanners(v.scanners, v.scanner_packages)


@query("J03 P03", """SELECT s.id, s.name AS scanner_name, s.state, s.schedule, p.name AS package_name
FROM scanners s JOIN scanner_packages p ON s.scanner_package_id = p.id WHERE upper(s.state) = 'TRUE'""")
def enabled_in_known_packages(v):
    return g.enabled_in_known_packages(v.scanners, v.scanner_packages)


@query("J03 P06", """SELECT s.id, s.name AS scanner_name, s.state, p.name AS package_name FROM scanners s
JOIN scanner_packages p ON s.scanner_package_id = p.id WHERE upper(s.state) = 'TRUE' AND p.id <> 'SECURITY_ESSENTIALS'""")
def enabled_paid_scanners(v):
    return g.enabled_paid_scanners(v.scanners, v.scanner_packages)


@query("P18", "SELECT id, name, state, schedule FROM scanners WHERE scanner_package_id = 'SECURITY_ESSENTIALS'")
def free_package_scanners(v):
    return g.free_package_scanners(v.scanners)


@query("P18 P03", "SELECT id, name, state, schedule FROM scanners WHERE scanner_package_id = 'SECURITY_ESSENTIALS' AND upper(state) = 'TRUE'")
def free_package_enabled(v):
    return g.free_package_scanners(v.scanners, enabled_only=True)


@query("P18", "SELECT id, name, state, schedule FROM scanner_packages WHERE id IN ('CIS_BENCHMARKS', 'THREAT_INTELLIGENCE')")
def package_status(v):
    return g.package_status(v.scanner_packages)


@query("P18 P03", "SELECT id, name, state FROM scanners WHERE scanner_package_id = 'CIS_BENCHMARKS' AND upper(state) = 'TRUE'")
def enabled_in_package(v):
    return g.enabled_in_package(v.scanners, "CIS_BENCHMARKS")


COUNTS = """WITH marked AS (SELECT scanner_package_id, ifnull(upper(state) = 'TRUE', FALSE) AS is_on FROM scanners),
sums AS (SELECT scanner_package_id, count_if(is_on) AS enabled, count_if(NOT is_on) AS disabled, count(*) AS total FROM marked GROUP BY 1)
SELECT name AS package_name, {state} CAST(sum(enabled) AS BIGINT) AS enabled, CAST(sum(disabled) AS BIGINT) AS disabled,
CAST(sum(total) AS BIGINT) AS total FROM sums LEFT JOIN scanner_packages ON id = scanner_package_id GROUP BY ALL"""


@query("A21 J02", COUNTS.format(state="state AS package_state,"))
def scanner_counts(v):
    return g.scanner_counts(v.scanners, v.scanner_packages)


@query("A21", COUNTS.format(state=""))
def scanner_counts_by_package(v):
    return g.scanner_counts(v.scanners, v.scanner_packages, by_state=False)


@query("S10", "SELECT * FROM configuration_view WHERE configuration_name = 'ENABLED'")
def list_config(v):
    return g.list_config(v.configuration_view)


@query("S10", "SELECT * FROM configuration_view")
def list_all_config(v):
    return g.list_config(v.configuration_view, None)


@query("S10 P03", """SELECT scanner_package_id, scanner_id, configuration_name, running_configuration_value FROM configuration_view
WHERE configuration_name = 'ENABLED' AND upper(running_configuration_value) = 'TRUE'""")
def config_running_enabled(v):
    return g.config_running_enabled(v.configuration_view)


MISMATCH = "FROM configuration_view WHERE running_configuration_value <> set_configuration_value AND configuration_name = 'ENABLED'"


@query("A38 P06", f"""SELECT scanner_package_id, scanner_id, configuration_name, running_configuration_value, set_configuration_value {MISMATCH}""")
def config_mismatch(v):
    return g.config_mismatch(v.configuration_view)


@query("A38", f"SELECT count(*) AS mismatches {MISMATCH}")
def config_mismatch_count(v):
    return g.count_rows(g.config_mismatch(v.configuration_view), "mismatches")


@query("S11 O04", "SELECT * FROM notification_history ORDER BY sent_on DESC LIMIT 20")
def list_notifications(v):
    return g.list_notifications(v.notification_history)


@query("S11 O02", "SELECT * FROM notification_history")
def list_all_notifications(v):
    return g.list_notifications(v.notification_history, None)


@query("S12", "SELECT metric_name, value FROM overview_metrics")
def overview_metrics(v):
    return g.overview_metrics(v.overview_metrics)


OPEN = "(state IS NULL OR upper(state) = 'OPEN') AND total_at_risk_count > 0"


@query("A22 P09 O03", f"SELECT scanner_package_name, severity, count(*) AS finding_count FROM findings WHERE {OPEN} GROUP BY 1, 2")
def open_findings(v):
    return g.open_findings(v.findings)


@query("A39", f"""SELECT scanner_package_name, count(*) FILTER (upper(severity) = 'CRITICAL') AS critical,
count(*) FILTER (upper(severity) = 'HIGH') AS high, count(*) FILTER (upper(severity) = 'MEDIUM') AS medium,
count(*) FILTER (upper(severity) = 'LOW') AS low, count(*) AS total, CAST(sum(total_at_risk_count) AS BIGINT) AS at_risk_entities
FROM findings WHERE {OPEN} GROUP BY 1""")
def findings_matrix(v):
    return g.findings_matrix(v.findings)


@query("A39", f"""SELECT scanner_package_name, upper(severity) AS severity, CAST(grouping(scanner_package_name, upper(severity)) AS INTEGER) AS level,
count(*) AS total, CAST(sum(total_at_risk_count) AS BIGINT) AS at_risk_entities FROM findings WHERE {OPEN}
GROUP BY CUBE (scanner_package_name, upper(severity))""")
def findings_totals(v):
    """Each package and severity, the totals of both, and the grand total."""
    return g.findings_totals(v.findings)


@query("A27", f"SELECT count(DISTINCT scanner_name) AS scanners FROM findings WHERE {PAID} AND CAST(start_timestamp AS DATE) BETWEEN DATE '1999-03-01' AND DATE '1999-06-15'")
def paid_scanners_over_span(v):
    """Merged from daily sketches, the findings are not read for the span."""
    daily = stored_daily(v, sketches.daily_scanners(v.findings), "scanners")
    return sketches.paid_scanners_over(daily, "1999-03-01", "1999-06-15")


@query("A27 A28", f"""SELECT CAST(start_timestamp AS DATE) AS day, scanner_package_name, count(DISTINCT scanner_name) AS scanners, count(DISTINCT event_id) AS runs
FROM findings GROUP BY ALL""")
def active_scanners_stream(v):
    """The daily sketch table written by a stream."""
    orders = stream_table(v.spark, v.folder, "orders")
    daily = run_closed(lambda rows: sketches.streamed_scanners(w.findings_of(rows)), orders, work_folder(v.spark, "daily"), "o_orderdate", state_partitions(v.spark, f"{v.folder}/orders.parquet"))
    return daily.select("day", "scanner_package_name", sketches.estimate("scanner_name").alias("scanners"), sketches.estimate("event_id").alias("runs"))


def stored_daily(v, rows, label):
    folder = work_folder(v.spark, label)
    rows.write.parquet(folder)
    return v.spark.read.parquet(folder)


@query("A23 U05 P07", f"SELECT scanner_package_name, scanner_name, max(start_timestamp) AS last_run FROM findings WHERE {last(7)} GROUP BY 1, 2")
def recently_active(v):
    return g.recently_active(v.findings, SCAN_AS_OF)


@query("A24 U05 P06", f"SELECT scanner_package_name, scanner_name, max(start_timestamp) AS last_run FROM findings WHERE {PAID} AND {last(30)} GROUP BY 1, 2")
def paid_recently_active(v):
    return g.paid_recently_active(v.findings, SCAN_AS_OF)


@query("A25", f"""SELECT scanner_package_name, scanner_name, count(*) AS run_count, min(start_timestamp) AS first_run,
max(start_timestamp) AS last_run FROM findings WHERE {PAID} AND {last(30)} GROUP BY 1, 2""")
def paid_runs(v):
    return g.paid_runs(v.findings, SCAN_AS_OF)


@query("A26", f"""SELECT scanner_name, count(*) AS run_count, max(start_timestamp) AS last_run FROM findings
WHERE scanner_package_name = 'Security Essentials' AND {last(30)} GROUP BY 1""")
def free_runs(v):
    return g.free_runs(v.findings, SCAN_AS_OF)


@query("A27", f"SELECT count(DISTINCT scanner_name) AS scanners FROM findings WHERE {PAID} AND {last(30)}")
def distinct_paid_scanners(v):
    return g.distinct_paid_scanners(v.findings, SCAN_AS_OF)


RATES = """SELECT *, CASE WHEN days_active > 0 THEN CAST(round(total_scan_runs / days_active, 1) AS DECIMAL(18,1)) END AS runs_per_day FROM (
SELECT scanner_package_name, len(list_distinct(flatten(list(names)))) AS distinct_scanners, count(*) AS total_scan_runs, min(a) AS first_run, max(z) AS last_run,
date_diff('day', min(a), max(z)) AS days_active FROM (SELECT scanner_package_name, event_id, list(scanner_name) AS names, min(start_timestamp) AS a,
max(start_timestamp) AS z FROM findings GROUP BY ALL) GROUP BY 1)"""


@query("A28", RATES)
def run_rate(v):
    return g.run_rate(v.findings)


DURATIONS = """SELECT scanner_package_name, scanner_name, count(*) AS run_count,
CAST(round(sum(seconds) / sum(scans), 1) AS DECIMAL(18,1)) AS avg_duration_sec, max(newest) AS last_run FROM (
SELECT scanner_package_name, scanner_name, event_id, sum(date_diff('second', start_timestamp, end_timestamp)) AS seconds, count(*) AS scans,
max(start_timestamp) AS newest FROM findings WHERE date_diff('second', start_timestamp, end_timestamp) IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


@query("A29 P10", DURATIONS)
def scan_durations(v):
    return g.scan_durations(v.findings)


@query("A29 O04", f"SELECT * FROM ({DURATIONS}) ORDER BY avg_duration_sec DESC, scanner_package_name, scanner_name LIMIT 20")
def avg_scan_duration(v):
    return g.avg_scan_duration(v.findings)


@query("A40", f"""WITH d AS ({DURATIONS}), t AS (SELECT CASE WHEN avg_duration_sec >= 17 THEN 'HIGH' WHEN avg_duration_sec >= 6 THEN 'MEDIUM'
ELSE 'LOW' END AS tier, count(*) AS scanners, CAST(sum(avg_duration_sec) AS DECIMAL(28,1)) AS seconds FROM d GROUP BY 1)
SELECT tier, scanners, seconds, CAST(round(CAST(seconds AS DOUBLE) / CAST(sum(seconds) OVER () AS DOUBLE), 4) AS DECIMAL(9,4)) AS share FROM t""")
def cost_tier_share(v):
    return g.cost_tier_share(g.scan_durations(v.findings))


@query("A30", f"SELECT scanner_package_name, count(*) AS recent_findings FROM findings WHERE {last(7, 'created_on')} GROUP BY 1")
def recent_findings_by_package(v):
    return g.recent_findings_by_package(v.findings, SCAN_AS_OF)


@query("A31", f"SELECT scanner_package_name, count(*) AS runs, max(start_timestamp) AS last_run FROM findings WHERE {PAID} AND {last(1)} GROUP BY 1")
def paid_runs_after_change(v):
    return g.paid_runs_after_change(v.findings, SCAN_AS_OF)


@query("O06 O04 P07", f"""SELECT scanner_package_name, scanner_name, start_timestamp, end_timestamp FROM findings WHERE {PAID} AND {last(30)}
ORDER BY start_timestamp DESC, scanner_package_name, scanner_name, end_timestamp DESC NULLS LAST LIMIT 20""")
def paid_scan_log(v):
    return g.paid_scan_log(v.findings, SCAN_AS_OF)


PAID_PACKAGES = "FROM scanner_packages WHERE upper(coalesce(state, 'FALSE')) = 'TRUE' AND id <> 'SECURITY_ESSENTIALS'"
ORPHANS = """FROM scanners s JOIN scanner_packages p ON s.scanner_package_id = p.id WHERE upper(s.state) = 'TRUE'
AND (p.state IS NULL OR upper(p.state) <> 'TRUE') AND p.id <> 'SECURITY_ESSENTIALS'"""
FREE_ENABLED = "FROM scanners WHERE scanner_package_id = 'SECURITY_ESSENTIALS' AND upper(state) = 'TRUE'"
PAID_SCANNERS = f"SELECT count(DISTINCT scanner_name) FROM findings WHERE {PAID} AND {last(30)}"


@query("P05 P06", f"SELECT id, name, state, schedule {PAID_PACKAGES}")
def paid_packages(v):
    return g.paid_packages(v.scanner_packages)


@query("A35 P05", f"SELECT count(*) AS paid_packages {PAID_PACKAGES}")
def paid_package_count(v):
    return g.paid_package_count(v.scanner_packages)


@query("A36 J03 P04", f"SELECT count(*) AS orphans {ORPHANS}")
def orphan_scanners(v):
    return g.orphan_scanners(v.scanners, v.scanner_packages)


@query("A37", f"SELECT count(*) AS enabled {FREE_ENABLED}")
def free_package_health(v):
    return g.free_package_health(v.scanners)


@query("U01 J08", f"""WITH n AS (SELECT (SELECT count(*) {PAID_PACKAGES}) AS packages, ({PAID_SCANNERS}) AS runs, (SELECT count(*) {FREE_ENABLED}) AS free),
tall AS (UNPIVOT n ON packages, runs, free INTO NAME kind VALUE value),
labels(kind, check_name, good, otherwise) AS (VALUES ('packages', 'Paid packages enabled', 0, 'FAIL - COST ALERT'),
('runs', 'Paid scanner runs (last 30d)', 0, 'FAIL - UNEXPECTED ACTIVITY'), ('free', 'Security Essentials active', 6, 'WARN - CHECK SE'))
SELECT check_name, value, CASE value WHEN good THEN 'PASS' ELSE otherwise END AS status FROM tall JOIN labels USING (kind)""")
def health_check(v):
    return g.health_check(v.scanner_packages, v.findings, v.scanners, SCAN_AS_OF)


@query("A35 A36 A37 A27 A38", f"""SELECT 'paid packages enabled' AS check_name, n AS value, n > 0 AS is_issue FROM (SELECT count(*) AS n {PAID_PACKAGES})
UNION ALL SELECT 'enabled scanners in disabled packages', n, n > 0 FROM (SELECT count(*) AS n {ORPHANS})
UNION ALL SELECT 'free package scanners enabled', n, FALSE FROM (SELECT count(*) AS n {FREE_ENABLED})
UNION ALL SELECT 'paid scanners run in 30 days', n, n > 0 FROM (SELECT count(DISTINCT scanner_name) AS n FROM findings WHERE {PAID} AND {last(30)})
UNION ALL SELECT 'configuration mismatches', n, n > 0 FROM (SELECT count(*) AS n {MISMATCH})""")
def validation_report(v):
    return g.validation_report(v.scanner_packages, v.scanners, v.findings, v.configuration_view, SCAN_AS_OF)


@query("K01 J02", """SELECT s.id AS scanner_id, s.name AS scanner_name, s.state, s.schedule, s.notification, p.id AS pkg_id, p.name AS pkg_name,
p.state AS pkg_state, TIMESTAMP '2001-08-01' AS snapshot_time FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id""")
def state_snapshot(v):
    return g.state_snapshot(v.scanners, v.scanner_packages, SCAN_AS_OF)


@query("K01", """SELECT s.id AS scanner_id, s.name AS scanner_name, s.state, p.state AS pkg_state, TIMESTAMP '2001-08-01' AS snapshot_time
FROM scanners s LEFT JOIN scanner_packages p ON s.scanner_package_id = p.id""")
def stored_state_snapshot(v):
    """The snapshot written once; the second, later one leaves the table as it is."""
    folder = work_folder(v.spark, "state")
    for as_of in (SCAN_AS_OF, SCAN_AS_OF + dt.timedelta(days=1)):
        sinks.create_if_absent(g.state_snapshot(v.scanners, v.scanner_packages, as_of), folder)
    return v.spark.read.parquet(folder).select("scanner_id", "scanner_name", "state", "pkg_state", "snapshot_time")


def _report_query(fmt: str):
    def build(v):
        folder = work_folder(v.spark, f"report-{fmt}")
        rows = g.scan_durations(v.findings)
        sinks.write_report(rows, folder, fmt)
        reader = v.spark.read.schema(rows.schema)
        return reader.option("header", True).csv(folder) if fmt == "csv" else reader.json(folder)

    return build


query("K04 A29", DURATIONS, name="report_csv")(_report_query("csv"))
query("K04 A29", DURATIONS, name="report_json")(_report_query("json"))


@query("U04", """WITH after_change AS (
  SELECT id + (CASE WHEN id % 10 = 5 THEN 1000000 ELSE 0 END) AS id, CASE WHEN id % 10 = 3 THEN 'FALSE' ELSE state END AS state, schedule
  FROM scanners WHERE id % 10 <> 4)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
o.state AS state_before, n.state AS state_after, o.schedule AS schedule_before, n.schedule AS schedule_after
FROM scanners o FULL JOIN after_change n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.state IS DISTINCT FROM n.state OR o.schedule IS DISTINCT FROM n.schedule""")
def state_diff(v):
    number = F.col("id") % 10
    changed = v.scanners.where(number != 4).select(
        (F.col("id") + F.when(number == 5, 1000000).otherwise(0)).alias("id"),
        F.when(number == 3, "FALSE").otherwise(F.col("state")).alias("state"), "schedule",
    )
    return g.state_diff(v.scanners, changed, "id", ["state", "schedule"])
