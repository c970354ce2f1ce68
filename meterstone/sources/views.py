"""The relations the operators read, derived from the supplied Parquet tables.

Each view is a lazy, narrow projection of one table (two aggregates are marked), so a filter or a
column choice made by an operator still reaches the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.functions.amounts import credits
from meterstone.operators.compliance import NUMERIC_PARAMETERS, PARAMETERS
from meterstone.operators.usage import METRICS_SCHEMA


def pick(index: Column, *values: str | None) -> Column:
    """The value at a zero-based position of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def user_name(user_id: Column) -> Column:
    """Name a usage row carries; NULL for the users that are missing from the user table."""
    return F.when(user_id % 13 != 0, text("Customer#", F.lpad(user_id.cast("string"), 9, "0")))


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- usage -------------------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return event_columns(self.table("events"))

    @cached_property
    def ai_usage(self) -> DataFrame:
        return ai_usage_of(self.events)

    @cached_property
    def users(self) -> DataFrame:
        return (
            self.table("customer")
            .where(F.col("c_custkey") % 13 != 0)
            .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
        )

    def _service(self, event_type: str, events: DataFrame | None = None) -> DataFrame:
        hour = F.date_trunc("hour", "ts")
        return (self.events if events is None else events).where(F.col("event_type") == event_type).select(
            "*",
            hour.alias("start_time"),
            F.to_date("ts").alias("usage_date"),
            (hour + F.expr("interval 1 hour")).alias("end_time"),
            user_name(F.col("user_id")).alias("user_name"),
        )

    @cached_property
    def analyst_usage(self) -> DataFrame:
        return self._service("click").select(
            "start_time", "usage_date", "end_time", F.col("user_name").alias("username"), "credits",
            F.col("k").alias("request_count"),
        )

    @cached_property
    def search_usage(self) -> DataFrame:
        uid = F.col("user_id")
        return self._service("view").select(
            "start_time", "usage_date", "end_time",
            text("DB", uid % 3).alias("database_name"),
            text("SC", uid % 2).alias("schema_name"),
            text("SVC", uid % 5).alias("service_name"),
            "credits",
        )

    def _agent_columns(self) -> list[Column]:
        uid = F.col("user_id")
        return [
            text("DB", uid % 3).alias("agent_database_name"),
            text("SC", uid % 2).alias("agent_schema_name"),
            text("AGENT", uid % 6).alias("agent_name"),
            F.col("credits").alias("token_credits"),
            F.col("k").alias("tokens"),
        ]

    @cached_property
    def intelligence_usage(self) -> DataFrame:
        return self._service("purchase").select(
            "start_time", "usage_date", "end_time", "user_name",
            text("WS", F.col("user_id") % 4).alias("workspace_name"), *self._agent_columns(),
        )

    @cached_property
    def agent_usage(self) -> DataFrame:
        return self.agent_usage_of(self.events)

    def agent_usage_of(self, events: DataFrame) -> DataFrame:
        return self._service("signup", events).select("start_time", "usage_date", "end_time", "user_name", *self._agent_columns())

    def _code(self, surface: int) -> DataFrame:
        return self.events.where((F.col("event_type") == "error") & (F.col("event_id") % 2 == surface)).select(
            "user_id", text("r", F.col("event_id")).alias("request_id"), F.col("ts").alias("usage_time"),
            F.col("credits").alias("token_credits"), F.col("k").alias("tokens"),
        )

    @cached_property
    def code_cli_usage(self) -> DataFrame:
        return self._code(0)

    @cached_property
    def code_web_usage(self) -> DataFrame:
        return self._code(1)

    # ---- limits ------------------------------------------------------------------------------

    @cached_property
    def access_control(self) -> DataFrame:
        uid = F.col("user_id")
        active = uid % 6 != 0
        return self.users.select(
            F.col("name").alias("user_name"), "user_id",
            F.lit("2024-01-01").cast("timestamp").alias("granted_at"),
            (1000 * (1 + uid % 5)).cast("decimal(38,6)").alias("monthly_credit_limit"),
            active.alias("is_active"),
            F.when(~active, F.lit("2023-12-15").cast("timestamp")).alias("revoked_at"),
            F.when(~active, F.lit("Monthly limit exceeded")).alias("revocation_reason"),
        )

    @cached_property
    def grant_requests(self) -> DataFrame:
        """New grants: some for users that hold access, some for new names, some with no limit."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.when(key % 2 == 0, F.col("c_name")).otherwise(text("New#", key)).alias("user_name"),
            F.when(key % 3 != 0, (500 + key).cast("decimal(38,6)")).alias("monthly_credit_limit"),
            F.lit("2024-01-30").cast("timestamp").alias("requested_at"),
        )

    @cached_property
    def account_daily_limits(self) -> DataFrame:
        """Default limit per surface (largest value set by any region row)."""
        return self.table("region").groupBy(
            pick(F.col("r_regionkey") % 2, "code_cli", "code_web").alias("surface")
        ).agg(F.max(F.col("r_regionkey") * 20).cast("decimal(38,6)").alias("daily_limit"))

    @cached_property
    def user_daily_limits(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("user_id"),
            pick(key % 2, "code_cli", "code_web").alias("surface"),
            F.when(key % 12 == 0, -1).when(key % 20 == 0, 0).otherwise(key % 90).cast("decimal(38,6)").alias("daily_limit"),
        )

    @cached_property
    def limit_parameters(self) -> tuple[DataFrame, DataFrame]:
        """Two parameter listings with upper-case names; the second lacks a description."""
        key = F.col("c_custkey")
        base = self.table("customer").select(
            key.cast("string").alias("VALUE"), F.lit("1").alias("DEFAULT"),
            pick(key % 2, "ACCOUNT", "USER").alias("LEVEL"), key.alias("OBJECT_ID"),
        )
        cli = base.select(F.lit("CODE_CLI_DAILY_LIMIT").alias("KEY"), "*", F.lit("command line").alias("DESCRIPTION"))
        web = base.select(F.lit("CODE_WEB_DAILY_LIMIT").alias("KEY"), "*")
        return cli, web

    @cached_property
    def agent_tags(self) -> DataFrame:
        """Cost-center tag of each agent (aggregate: one row per agent); some agents carry none."""
        number = F.col("s_suppkey") % 5
        return self.table("supplier").select(
            text("AGENT", number).alias("agent_name"), text("CENTER", number % 3).alias("tag_value")
        ).distinct()

    @cached_property
    def tag_budgets(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.table("region").select(
            text("CENTER", key).alias("tag_value"),
            (15000 * (key + 1)).cast("decimal(38,6)").alias("monthly_limit"),
        )

    # ---- scanner inventory and findings --------------------------------------------------------

    @cached_property
    def scanner_packages(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.table("region").select(
            package_id(key).alias("id"),
            F.col("r_name").alias("name"),
            pick(key, "TRUE", "true", "FALSE", None, "TRUE").alias("state"),
            pick(key, "0 6 7 * *", "16 8 * * *", "34 4 * * *", "0 6 * * 1", "0 6 9,24 * *").alias("schedule"),
            pick(key % 2, "built-in", "custom").alias("provider"),
            pick(key % 3, "mail", None, "queue").alias("notification"),
            (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(key * 30)).alias("last_enabled_timestamp"),
            F.when(key % 2 == 0, F.lit("2001-01-01").cast("timestamp")).alias("last_disabled_timestamp"),
        )

    @cached_property
    def scanners(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("short_description"),
            pick(F.col("p_size") % 4, "TRUE", "true", "FALSE", None).alias("state"),
            pick(key % 9, "USING CRON 16 8 * * * UTC", "USING CRON 0 6 * * 1 UTC", "USING CRON 0 6 7 * * UTC", "USING CRON 0 6 9,24 * * UTC",
                 "USING CRON 0 * * * * UTC", "USING CRON 0 6,18 * * * UTC", "USING CRON 0 6 1 1 * UTC", "USING CRON */20 8-10 * * 1-5 UTC",
                 "USING CRON 0 6 * * MON-FRI UTC").alias("schedule"),
            pick(key % 3, "mail", None, "queue").alias("notification"),
            (F.lit("2001-07-01").cast("timestamp") + F.make_dt_interval(key % 30)).alias("last_scan_timestamp"),
            package_id(key % 6).alias("scanner_package_id"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        return findings_of(self.table("orders"))

    @cached_property
    def configuration_view(self) -> DataFrame:
        return self.scanners.select(
            "scanner_package_id", F.col("id").alias("scanner_id"), F.lit("SCANNER").alias("type"),
            pick(F.col("id") % 10 / 9, "ENABLED", "SCHEDULE").alias("configuration_name"),
            F.col("state").alias("running_configuration_value"),
            F.when(F.col("id") % 17 == 0, F.lit("FALSE")).otherwise(F.col("state")).alias("set_configuration_value"),
        )

    @cached_property
    def notification_history(self) -> DataFrame:
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        failed = key % 7 == 0
        return self.table("orders").select(
            package_id(customer % 3).alias("scanner_package_id"),
            (customer % 40).alias("scanner_id"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), key)).alias("sent_on"),
            text("CHANNEL", customer % 3).alias("notification_integration_name"),
            F.when(failed, "FAILED").otherwise("SENT").alias("status"),
            F.when(failed, "mailbox full").alias("error_message"),
        )

    @cached_property
    def overview_metrics(self) -> DataFrame:
        """Readiness percentages (aggregate over the accounts)."""
        people = F.col("kind") == "PERSON"
        share = lambda part, whole: F.round(100 * F.count_if(part) / F.count_if(whole), 1)
        row = self.accounts.agg(
            share(people & F.col("has_mfa"), people).alias("mfa"),
            share(~people & ~F.col("has_password"), ~people).alias("passwordless"),
        )
        return row.unpivot(
            [], [F.col("mfa").alias("MFA_READINESS"), F.col("passwordless").alias("PASSWORDLESS_READINESS")],
            "metric_name", "value",
        ).select("metric_name", F.col("value").cast("decimal(9,1)").alias("value"))

    # ---- runs, models, snapshots ---------------------------------------------------------------

    @cached_property
    def execution_history(self) -> DataFrame:
        order_date = F.col("o_orderdate").cast("timestamp")
        seconds = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") % 60)
        return self.table("orders").select(
            F.col("o_orderkey").alias("query_id"),
            text("P", F.col("o_custkey") % 5).alias("object_name"),
            order_date.alias("query_start_time"),
            (order_date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("query_end_time"),
            F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "O", "SUCCESS")
            .otherwise("RUNNING").alias("execution_status"),
        )

    @cached_property
    def task_runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("query_id"),
            text("TASK", F.col("o_custkey") % 4).alias("name"),
            F.col("o_orderdate").cast("timestamp").alias("scheduled_time"),
            F.col("o_orderstatus").alias("state"),
        )

    @cached_property
    def snapshot_history(self) -> DataFrame:
        source = self.table("orders").where(F.col("o_orderkey") % 10 != 0)
        updated = F.col("o_orderdate").cast("timestamp")
        closed_at = updated - F.expr("interval 5 days")
        versions = source.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
            updated.alias("updated_at"), updated.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        )
        older = source.where(F.col("o_orderkey") % 7 == 0).select(
            F.col("o_orderkey").alias("order_id"), F.lit("N").alias("status"),
            closed_at.alias("updated_at"), closed_at.alias("valid_from"), updated.alias("valid_to"),
        )
        return versions.unionByName(older)

    @cached_property
    def snapshot_source(self) -> DataFrame:
        changed = F.col("o_orderkey") % 10 == 2
        updated = F.col("o_orderdate").cast("timestamp")
        return self.table("orders").where(F.col("o_orderkey") % 10 != 1).select(
            F.col("o_orderkey").alias("order_id"),
            F.when(changed, "X").otherwise(F.col("o_orderstatus")).alias("status"),
            F.when(changed, updated + F.expr("interval 1 day")).otherwise(updated).alias("updated_at"),
        )

    @cached_property
    def order_changes(self) -> DataFrame:
        """Change log with several dated rows per order (aggregate: one row per order and date)."""
        return self.table("lineitem").groupBy(
            F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("updated_at")
        ).agg(F.max("l_linestatus").alias("status"))

    @cached_property
    def model_nodes(self) -> DataFrame:
        """Model list of three projects; a model depends on the ones at half and a third of its number."""
        key = F.col("p_partkey")
        half, third = F.floor(key / 2), F.floor(key / 3)
        parents = F.when(key == 0, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.array(text("m", half), text("m", third)))
        )
        return self.table("part").select(
            text("m", key).alias("model"), text("proj", key % 3).alias("project"), parents.alias("depends_on")
        )

    @cached_property
    def external_edges(self) -> DataFrame:
        """Lineage events that name a source outside the projects."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            text("m", key).alias("model"), text("src", key % 9).alias("parent"),
        )

    @cached_property
    def monitoring_overlap(self) -> DataFrame:
        """How far other monitoring covers a scanner (aggregate: one row per package and scanner); for some it is unknown."""
        number, package = F.col("s_suppkey") % 40, F.col("s_suppkey") % 3
        return self.table("supplier").select(
            pick(package, "Security Essentials", "CIS Benchmarks", "Threat Intelligence").alias("scanner_package_name"),
            text("S", number).alias("scanner_name"), pick((number + package) % 4, "YES", "PARTIAL", "NO", None).alias("overlap")
        ).distinct()

    # ---- accounts, logins, grants, objects -------------------------------------------------------

    @cached_property
    def accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        day = lambda n: F.make_dt_interval(n)
        return self.table("customer").select(
            key.alias("user_id"), F.col("c_name").alias("name"),
            pick(key % 4, "PERSON", "PERSON", "SERVICE", "LEGACY_SERVICE").alias("kind"),
            (key % 3 != 0).alias("has_password"), (key % 5 < 2).alias("has_mfa"),
            (key % 7 == 0).alias("has_key_pair"),
            F.when(key % 7 == 0, F.lit("2023-01-01").cast("timestamp") + day(key % 400)).alias("key_set_at"),
            F.when(key % 50 != 0, F.lit("2024-01-31").cast("timestamp") - day(key % 200)).alias("last_login_at"),
            F.when(key % 97 == 0, "ACCOUNTADMIN").when(key % 89 == 0, "SECURITYADMIN").otherwise("ANALYST").alias("default_role"),
            F.when(key % 17 != 0, text("u", key, "@example.com")).alias("email"),
            F.when(key % 2 == 0, "NETWORK_POLICY").alias("network_policy"),
            (key % 29 == 0).alias("is_disabled"),
        )

    @cached_property
    def role_grants(self) -> DataFrame:
        """Grants of roles to users."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("grant_id"), F.col("o_custkey").alias("user_id"),
            F.when(key % 50 == 0, "ACCOUNTADMIN").when(key % 50 == 1, "SECURITYADMIN")
            .otherwise(text("ROLE", key % 20)).alias("role_name"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), key % 24)).alias("granted_on"),
        )

    @cached_property
    def role_hierarchy(self) -> DataFrame:
        """Roles granted to roles: the grantee gains what the granted role may do."""
        key = F.col("p_partkey")
        return self.table("part").select(
            F.when(key % 500 == 1, "ACCOUNTADMIN").when(key % 500 == 2, "SECURITYADMIN")
            .otherwise(text("ROLE", F.floor(key / 2))).alias("granted_role"),
            text("ROLE", key).alias("grantee_role"),
        )

    @cached_property
    def logins(self) -> DataFrame:
        return logins_of(self.events)

    @cached_property
    def query_history(self) -> DataFrame:
        start = F.col("l_shipdate").cast("timestamp")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("user_id"),
            text("WH", F.col("l_suppkey") % 20).alias("entity"), start.alias("start_time"),
            F.when(F.col("l_linenumber") == 7, F.col("l_quantity") * 10).otherwise(F.col("l_quantity"))
            .cast("bigint").alias("duration_seconds"),
            (F.col("l_returnflag") == "R").alias("is_error"),
        )

    @cached_property
    def change_events(self) -> DataFrame:
        return change_events_of(self.events)

    @cached_property
    def parameters(self) -> DataFrame:
        """Settings of many accounts, one row per account and parameter; the last account lacks some."""
        key, size = F.col("p_partkey"), F.col("p_size")
        names = PARAMETERS
        number = pick(key % len(names), *["number" if name in NUMERIC_PARAMETERS else "text" for name in names])
        return self.table("part").select(
            F.floor(key / len(names)).alias("account_id"),
            pick(key % len(names), *names).alias("parameter"),
            F.when(size % 11 == 0, None)
            .when(number == "number", F.when(size % 3 == 0, 90).otherwise(size).cast("string"))
            .otherwise(pick(size % 3, "TRUE", "false", "SET")).alias("value"),
        )

    @cached_property
    def code_objects(self) -> DataFrame:
        """Scheduled tasks and stored procedures with owner and execution role."""
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("object_id"), pick(key % 2, "TASK", "PROCEDURE").alias("object_kind"),
            F.when(key % 40 == 0, "ACCOUNTADMIN").when(key % 40 == 1, "SECURITYADMIN")
            .otherwise(text("ROLE", key % 9)).alias("owner_role"),
            F.when(key % 30 == 2, "ACCOUNTADMIN").when(key % 6 == 0, None)
            .otherwise(text("ROLE", key % 9)).alias("run_as_role"),
        )

    @cached_property
    def stages(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            text("STAGE", key).alias("object_name"), pick(key % 2, "INTERNAL", "EXTERNAL").alias("stage_kind"),
            pick(key % 3, "AES-256", "NONE", None).alias("encryption"),
            F.when(key % 5 != 0, text("INT", key % 4)).alias("storage_integration"),
        )

    @cached_property
    def sensitive_columns(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            text("TABLE", F.floor(key / 4)).alias("table_name"), text("COL", key % 4).alias("column_name"),
            (F.col("p_size") % 2 == 0).alias("is_sensitive"),
        )

    @cached_property
    def policy_references(self) -> DataFrame:
        key = F.col("p_partkey")
        table = F.floor(key / 4)
        return self.table("part").select(
            text("TABLE", table).alias("table_name"),
            F.when(table % 3 != 1, text("COL", key % 4)).alias("column_name"),
            pick(table % 3, "MASKING", "ROW_ACCESS", "PROJECTION").alias("policy_kind"),
        )


def package_id(index: Column) -> Column:
    return pick(index, "SECURITY_ESSENTIALS", "CIS_BENCHMARKS", "THREAT_INTELLIGENCE", "CUSTOM_A", "CUSTOM_B", "NO_SUCH_PACKAGE")


# The four functions below take a raw table, so a stream over the same files has the same columns.


def event_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        credits("value").alias("credits"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def ai_usage_of(events: DataFrame) -> DataFrame:
    event, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    metric = lambda name, value: F.struct(F.struct(F.lit(name).alias("metric")).alias("key"), value.alias("value"))
    metrics = (
        F.when(event % 11 == 0, None)
        .when(event % 17 == 0, F.array().cast(METRICS_SCHEMA))
        .when(event % 5 == 0, F.array(metric("total", k)))
        .otherwise(F.array(metric("input", k), metric("output", event % 7)))
    )
    hour = F.date_trunc("hour", "ts")
    copies = F.when(event % 100 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return events.select(
        hour.alias("start_time"),
        F.to_date("ts").alias("usage_date"),
        (hour + F.expr("interval 1 hour")).alias("end_time"),
        F.col("event_type").alias("function_name"),
        text("m", uid % 4).alias("model_name"),
        text(uid, "-", F.col("event_type"), "-", F.to_date(F.date_trunc("week", "ts"))).alias("query_id"),
        (uid % 7).alias("warehouse_id"),
        "credits",
        (event % 10 != 0).alias("is_completed"),
        "user_id",
        metrics.alias("metrics"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def findings_of(orders: DataFrame) -> DataFrame:
    key, customer, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    start = F.col("o_orderdate").cast("timestamp")
    seconds = F.when(key % 9 != 0, customer % 60)
    return orders.select(
        F.floor(key / 2).alias("event_id"),
        pick(customer % 3, "Security Essentials", "CIS Benchmarks", "Threat Intelligence").alias("scanner_package_name"),
        text("S", customer % 40).alias("scanner_name"),
        F.when(priority == "1-URGENT", "CRITICAL").when(priority == "2-HIGH", "HIGH")
        .when(priority == "3-MEDIUM", "medium").when(priority == "5-LOW", "LOW").otherwise("UNKNOWN").alias("severity"),
        F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "RESOLVED").alias("state"),
        (key % 4).alias("total_at_risk_count"),
        start.alias("start_timestamp"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).alias("end_timestamp"),
        start.alias("created_on"),
    )


def logins_of(events: DataFrame) -> DataFrame:
    event, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    return events.select(
        event.alias("login_id"), "ts", "user_id",
        text("10.0.", uid % 250, ".", F.floor(event / 50) % 9).alias("client_ip"),
        text("app", F.floor(k / 10)).alias("client_app"),
        pick(k % 3, "connector-a", "connector-b", "connector-c").alias("client_kind"),
        text(k % 9, ".", event % 12, ".", uid % 3).alias("client_version"),
        (F.col("event_type") != "error").alias("is_success"),
        pick(event % 3 / 2, "PASSWORD", "KEY_PAIR").alias("first_factor"),
        F.when(event % 4 == 0, "MFA").alias("second_factor"),
    )


def change_events_of(events: DataFrame) -> DataFrame:
    event, k = F.col("event_id"), F.col("k")
    return events.select(
        "event_id", "ts", "user_id",
        pick(k % 5, "CREATE", "ALTER", "DROP", "SHOW", "GRANT").alias("action"),
        pick(event % 10, "AUTHENTICATION POLICY", "NETWORK POLICY", "PARAMETER", "PASSWORD POLICY", "SESSION POLICY",
             "SECURITY INTEGRATION", "SHARE", "ROLE GRANT", "PRIVILEGE GRANT", "PROVISIONING TOKEN").alias("object_kind"),
        pick(F.floor(event / 10) % 5, "ACCOUNTADMIN", "MANAGE GRANTS", "NETWORK_POLICY", "PREVENT_UNLOAD_TO_INLINE_URL",
             "STATEMENT_TIMEOUT").alias("object_name"),
    )
