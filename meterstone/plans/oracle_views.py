"""The same views in the SQL of the checking engine, written apart from the Spark ones."""

from __future__ import annotations

import re


def pick(index: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INTEGER) + 1]"


PACKAGE_IDS = ("SECURITY_ESSENTIALS", "CIS_BENCHMARKS", "THREAT_INTELLIGENCE", "CUSTOM_A", "CUSTOM_B", "NO_SUCH_PACKAGE")

EVENT_NAME = "CASE WHEN user_id % 13 <> 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END"

AGENT = """'DB' || (user_id % 3) AS agent_database_name, 'SC' || (user_id % 2) AS agent_schema_name,
    'AGENT' || (user_id % 6) AS agent_name, credits AS token_credits, k AS tokens"""


def _service(event_type: str, columns: str) -> str:
    return f"""SELECT date_trunc('hour', ts) AS start_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_time, {columns}
    FROM ev WHERE event_type = '{event_type}'"""


def _code(surface: int) -> str:
    return f"""SELECT user_id, 'r' || event_id AS request_id, ts AS usage_time, credits AS token_credits, k AS tokens
    FROM ev WHERE event_type = 'error' AND event_id % 2 = {surface}"""


def _parameters() -> str:
    from meterstone.operators.compliance import NUMERIC_PARAMETERS, PARAMETERS

    names = PARAMETERS
    n = len(names)
    kinds = ["number" if name in NUMERIC_PARAMETERS else "text" for name in names]
    return f"""SELECT p_partkey // {n} AS account_id, {pick(f'p_partkey % {n}', *names)} AS parameter,
    CASE WHEN p_size % 11 = 0 THEN NULL
         WHEN {pick(f'p_partkey % {n}', *kinds)} = 'number' THEN CAST(CASE WHEN p_size % 3 = 0 THEN 90 ELSE p_size END AS VARCHAR)
         ELSE {pick('p_size % 3', 'TRUE', 'false', 'SET')} END AS value FROM part"""


VIEWS = {
    "ev": """SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(38,6)) AS credits,
    CAST(props->>'$.k' AS BIGINT) AS k FROM events""",
    "ai_usage": """SELECT date_trunc('hour', ts) AS start_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_time,
    event_type AS function_name, 'm' || (user_id % 4) AS model_name,
    user_id || '-' || event_type || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS query_id,
    user_id % 7 AS warehouse_id, credits, event_id % 10 <> 0 AS is_completed, user_id,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN []
         WHEN event_id % 5 = 0 THEN [{'metric': 'total', 'value': k}]
         ELSE [{'metric': 'input', 'value': k}, {'metric': 'output', 'value': event_id % 7}] END AS metrics
    FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 100 = 0)""",
    "users": "SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey % 13 <> 0",
    "analyst_usage": _service("click", f"{EVENT_NAME} AS username, credits, k AS request_count"),
    "search_usage": _service("view", """'DB' || (user_id % 3) AS database_name, 'SC' || (user_id % 2) AS schema_name,
    'SVC' || (user_id % 5) AS service_name, credits"""),
    "intelligence_usage": _service("purchase", f"{EVENT_NAME} AS user_name, 'WS' || (user_id % 4) AS workspace_name, {AGENT}"),
    "agent_usage": _service("signup", f"{EVENT_NAME} AS user_name, {AGENT}"),
    "code_cli_usage": _code(0),
    "code_web_usage": _code(1),
    "access_control": """SELECT name AS user_name, user_id, TIMESTAMP '2024-01-01' AS granted_at,
    CAST(1000 * (1 + user_id % 5) AS DECIMAL(38,6)) AS monthly_credit_limit, user_id % 6 <> 0 AS is_active,
    CASE WHEN user_id % 6 = 0 THEN TIMESTAMP '2023-12-15' END AS revoked_at,
    CASE WHEN user_id % 6 = 0 THEN 'Monthly limit exceeded' END AS revocation_reason FROM users""",
    "grant_requests": """SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'New#' || c_custkey END AS user_name,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(500 + c_custkey AS DECIMAL(38,6)) END AS monthly_credit_limit,
    TIMESTAMP '2024-01-30' AS requested_at FROM customer""",
    "account_daily_limits": """SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'code_cli' ELSE 'code_web' END AS surface,
    CAST(max(r_regionkey * 20) AS DECIMAL(38,6)) AS daily_limit FROM region GROUP BY 1""",
    "user_daily_limits": """SELECT c_custkey AS user_id,
    CASE WHEN c_custkey % 2 = 0 THEN 'code_cli' ELSE 'code_web' END AS surface,
    CAST(CASE WHEN c_custkey % 12 = 0 THEN -1 WHEN c_custkey % 20 = 0 THEN 0 ELSE c_custkey % 90 END AS DECIMAL(38,6)) AS daily_limit
    FROM customer""",
    "agent_tags": """SELECT DISTINCT 'AGENT' || (s_suppkey % 5) AS agent_name, 'CENTER' || (s_suppkey % 5 % 3) AS tag_value FROM supplier""",
    "tag_budgets": """SELECT 'CENTER' || r_regionkey AS tag_value, CAST(15000 * (r_regionkey + 1) AS DECIMAL(38,6)) AS monthly_limit FROM region""",
    "scanner_packages": f"""SELECT {pick('r_regionkey', *PACKAGE_IDS)} AS id, r_name AS name,
    {pick('r_regionkey', 'TRUE', 'true', 'FALSE', None, 'TRUE')} AS state,
    {pick('r_regionkey', '0 6 7 * *', '16 8 * * *', '34 4 * * *', '0 6 * * 1', '0 6 9,24 * *')} AS schedule,
    {pick('r_regionkey % 2', 'built-in', 'custom')} AS provider,
    {pick('r_regionkey % 3', 'mail', None, 'queue')} AS notification,
    TIMESTAMP '2000-01-01' + to_days(CAST(r_regionkey * 30 AS INTEGER)) AS last_enabled_timestamp,
    CASE WHEN r_regionkey % 2 = 0 THEN TIMESTAMP '2001-01-01' END AS last_disabled_timestamp FROM region""",
    "scanners": f"""SELECT p_partkey AS id, p_name AS name, p_type AS short_description,
    {pick('p_size % 4', 'TRUE', 'true', 'FALSE', None)} AS state,
    {pick('p_partkey % 9', 'USING CRON 16 8 * * * UTC', 'USING CRON 0 6 * * 1 UTC', 'USING CRON 0 6 7 * * UTC', 'USING CRON 0 6 9,24 * * UTC',
          'USING CRON 0 * * * * UTC', 'USING CRON 0 6,18 * * * UTC', 'USING CRON 0 6 1 1 * UTC', 'USING CRON */20 8-10 * * 1-5 UTC',
          'USING CRON 0 6 * * MON-FRI UTC')} AS schedule,
    {pick('p_partkey % 3', 'mail', None, 'queue')} AS notification,
    TIMESTAMP '2001-07-01' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS last_scan_timestamp,
    {pick('p_partkey % 6', *PACKAGE_IDS)} AS scanner_package_id FROM part""",
    "findings": f"""SELECT o_orderkey // 2 AS event_id,
    {pick('o_custkey % 3', 'Security Essentials', 'CIS Benchmarks', 'Threat Intelligence')} AS scanner_package_name,
    'S' || (o_custkey % 40) AS scanner_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'medium'
         WHEN '5-LOW' THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
    CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'RESOLVED' END AS state,
    o_orderkey % 4 AS total_at_risk_count, o_orderdate AS start_timestamp,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_seconds(o_custkey % 60) END AS end_timestamp,
    o_orderdate AS created_on FROM orders""",
    "configuration_view": f"""SELECT scanner_package_id, id AS scanner_id, 'SCANNER' AS type,
    CASE WHEN id % 10 = 9 THEN 'SCHEDULE' ELSE 'ENABLED' END AS configuration_name,
    state AS running_configuration_value,
    CASE WHEN id % 17 = 0 THEN 'FALSE' ELSE state END AS set_configuration_value FROM scanners""",
    "notification_history": f"""SELECT {pick('o_custkey % 3', *PACKAGE_IDS)} AS scanner_package_id, o_custkey % 40 AS scanner_id,
    o_orderdate + to_seconds(o_orderkey) AS sent_on, 'CHANNEL' || (o_custkey % 3) AS notification_integration_name,
    CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'SENT' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 'mailbox full' END AS error_message FROM orders""",
    "overview_metrics": """SELECT 'MFA_READINESS' AS metric_name, CAST(round(100.0 * count(*) FILTER (kind = 'PERSON' AND has_mfa)
      / count(*) FILTER (kind = 'PERSON'), 1) AS DECIMAL(9,1)) AS value FROM accounts
    UNION ALL SELECT 'PASSWORDLESS_READINESS', CAST(round(100.0 * count(*) FILTER (kind <> 'PERSON' AND NOT has_password)
      / count(*) FILTER (kind <> 'PERSON'), 1) AS DECIMAL(9,1)) FROM accounts""",
    "execution_history": """SELECT o_orderkey AS query_id, 'P' || (o_custkey % 5) AS object_name, o_orderdate AS query_start_time,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_seconds(o_custkey % 60) END AS query_end_time,
    CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'SUCCESS' ELSE 'RUNNING' END AS execution_status FROM orders""",
    "task_runs": """SELECT o_orderkey AS query_id, 'TASK' || (o_custkey % 4) AS name, o_orderdate AS scheduled_time,
    o_orderstatus AS state FROM orders""",
    "snapshot_history": """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderdate AS updated_at,
    o_orderdate AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM orders WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT o_orderkey, 'N', o_orderdate - INTERVAL 5 DAY, o_orderdate - INTERVAL 5 DAY, o_orderdate
    FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0""",
    "snapshot_source": """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 10 = 2 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS updated_at
    FROM orders WHERE o_orderkey % 10 <> 1""",
    "order_changes": """SELECT l_orderkey AS order_id, l_shipdate AS updated_at, max(l_linestatus) AS status
    FROM lineitem GROUP BY 1, 2""",
    "model_nodes": """SELECT 'm' || p_partkey AS model, 'proj' || (p_partkey % 3) AS project,
    CASE WHEN p_partkey = 0 THEN [] WHEN p_partkey // 2 = p_partkey // 3 THEN ['m' || (p_partkey // 2)]
         ELSE ['m' || (p_partkey // 2), 'm' || (p_partkey // 3)] END AS depends_on FROM part""",
    "external_edges": "SELECT 'm' || s_suppkey AS model, 'src' || (s_suppkey % 9) AS parent FROM supplier",
    "monitoring_overlap": """SELECT DISTINCT (['Security Essentials', 'CIS Benchmarks', 'Threat Intelligence'])[s_suppkey % 3 + 1] AS scanner_package_name,
    'S' || (s_suppkey % 40) AS scanner_name, (['YES', 'PARTIAL', 'NO', NULL])[(s_suppkey % 40 + s_suppkey % 3) % 4 + 1] AS overlap FROM supplier""",
    "accounts": """SELECT c_custkey AS user_id, c_name AS name,
    (['PERSON', 'PERSON', 'SERVICE', 'LEGACY_SERVICE'])[c_custkey % 4 + 1] AS kind,
    c_custkey % 3 <> 0 AS has_password, c_custkey % 5 < 2 AS has_mfa, c_custkey % 7 = 0 AS has_key_pair,
    CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 400 AS INTEGER)) END AS key_set_at,
    CASE WHEN c_custkey % 50 <> 0 THEN TIMESTAMP '2024-01-31' - to_days(CAST(c_custkey % 200 AS INTEGER)) END AS last_login_at,
    CASE WHEN c_custkey % 97 = 0 THEN 'ACCOUNTADMIN' WHEN c_custkey % 89 = 0 THEN 'SECURITYADMIN' ELSE 'ANALYST' END AS default_role,
    CASE WHEN c_custkey % 17 <> 0 THEN 'u' || c_custkey || '@example.com' END AS email,
    CASE WHEN c_custkey % 2 = 0 THEN 'NETWORK_POLICY' END AS network_policy, c_custkey % 29 = 0 AS is_disabled FROM customer""",
    "role_grants": """SELECT o_orderkey AS grant_id, o_custkey AS user_id,
    CASE o_orderkey % 50 WHEN 0 THEN 'ACCOUNTADMIN' WHEN 1 THEN 'SECURITYADMIN' ELSE 'ROLE' || (o_orderkey % 20) END AS role_name,
    o_orderdate + to_hours(o_orderkey % 24) AS granted_on FROM orders""",
    "role_hierarchy": """SELECT CASE p_partkey % 500 WHEN 1 THEN 'ACCOUNTADMIN' WHEN 2 THEN 'SECURITYADMIN'
    ELSE 'ROLE' || (p_partkey // 2) END AS granted_role, 'ROLE' || p_partkey AS grantee_role FROM part""",
    "logins": """SELECT event_id AS login_id, ts, user_id, '10.0.' || (user_id % 250) || '.' || (event_id // 50 % 9) AS client_ip,
    'app' || (k // 10) AS client_app, (['connector-a', 'connector-b', 'connector-c'])[k % 3 + 1] AS client_kind,
    concat(k % 9, '.', event_id % 12, '.', user_id % 3) AS client_version, event_type <> 'error' AS is_success,
    CASE WHEN event_id % 3 = 2 THEN 'KEY_PAIR' ELSE 'PASSWORD' END AS first_factor,
    CASE WHEN event_id % 4 = 0 THEN 'MFA' END AS second_factor FROM ev""",
    "query_history": """SELECT l_orderkey AS query_id, l_suppkey AS user_id, 'WH' || (l_suppkey % 20) AS entity, l_shipdate AS start_time,
    CAST(CASE WHEN l_linenumber = 7 THEN l_quantity * 10 ELSE l_quantity END AS BIGINT) AS duration_seconds,
    l_returnflag = 'R' AS is_error FROM lineitem""",
    "change_events": f"""SELECT event_id, ts, user_id, {pick('k % 5', 'CREATE', 'ALTER', 'DROP', 'SHOW', 'GRANT')} AS action,
    {pick('event_id % 10', 'AUTHENTICATION POLICY', 'NETWORK POLICY', 'PARAMETER', 'PASSWORD POLICY', 'SESSION POLICY',
          'SECURITY INTEGRATION', 'SHARE', 'ROLE GRANT', 'PRIVILEGE GRANT', 'PROVISIONING TOKEN')} AS object_kind,
    {pick('event_id // 10 % 5', 'ACCOUNTADMIN', 'MANAGE GRANTS', 'NETWORK_POLICY', 'PREVENT_UNLOAD_TO_INLINE_URL',
          'STATEMENT_TIMEOUT')} AS object_name FROM ev""",
    "code_objects": """SELECT p_partkey AS object_id, CASE WHEN p_partkey % 2 = 0 THEN 'TASK' ELSE 'PROCEDURE' END AS object_kind,
    CASE p_partkey % 40 WHEN 0 THEN 'ACCOUNTADMIN' WHEN 1 THEN 'SECURITYADMIN' ELSE 'ROLE' || (p_partkey % 9) END AS owner_role,
    CASE WHEN p_partkey % 30 = 2 THEN 'ACCOUNTADMIN' WHEN p_partkey % 6 = 0 THEN NULL ELSE 'ROLE' || (p_partkey % 9) END AS run_as_role
    FROM part""",
    "stages": f"""SELECT 'STAGE' || s_suppkey AS object_name, CASE WHEN s_suppkey % 2 = 0 THEN 'INTERNAL' ELSE 'EXTERNAL' END AS stage_kind,
    {pick('s_suppkey % 3', 'AES-256', 'NONE', None)} AS encryption,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'INT' || (s_suppkey % 4) END AS storage_integration FROM supplier""",
    "sensitive_columns": """SELECT 'TABLE' || (p_partkey // 4) AS table_name, 'COL' || (p_partkey % 4) AS column_name,
    p_size % 2 = 0 AS is_sensitive FROM part""",
    "policy_references": """SELECT 'TABLE' || (p_partkey // 4) AS table_name,
    CASE WHEN p_partkey // 4 % 3 <> 1 THEN 'COL' || (p_partkey % 4) END AS column_name,
    (['MASKING', 'ROW_ACCESS', 'PROJECTION'])[p_partkey // 4 % 3 + 1] AS policy_kind FROM part""",
}


def with_views(sql: str) -> str:
    """Put the views a query names, and the ones these name, in front of it."""
    if "parameters" not in VIEWS:
        VIEWS["parameters"] = _parameters()
    order: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in order)
    stripped = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", stripped):
        return f"WITH RECURSIVE {ctes},\n{stripped[len('WITH RECURSIVE'):].lstrip()}"
    if stripped.startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"
