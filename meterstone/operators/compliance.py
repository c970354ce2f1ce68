"""Benchmark rules over parameters, accounts, roles, code objects, events, sessions and objects.

Each function returns one row per failing subject with the rule it breaks; the parameter rules also
return the ones that pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.fixed_values import ADMIN_ROLES
from meterstone.functions.predicates import is_true
from meterstone.functions.time import Instant, instant
from meterstone.operators.detect import is_change, is_grant_event
from meterstone.operators.workflow import lineage_closure


class ParameterRule(NamedTuple):
    rule: str
    parameter: str
    test: str
    bound: int | None = None


# Rule, parameter, and what its value must be.
PARAMETER_RULES = (
    ParameterRule("CIS 1.1", "SSO_INTEGRATION", "set"),
    ParameterRule("CIS 1.2", "SCIM_INTEGRATION", "set"),
    ParameterRule("CIS 1.5", "PASSWORD_MIN_LENGTH", "at least", 14),
    ParameterRule("CIS 1.9", "SESSION_UI_IDLE_TIMEOUT_MINS", "set"),
    ParameterRule("CIS 3.1", "NETWORK_POLICY", "set"),
    ParameterRule("CIS 4.1", "PERIODIC_DATA_REKEYING", "true"),
    ParameterRule("CIS 4.3", "DATA_RETENTION_TIME_IN_DAYS", "equal", 90),
    ParameterRule("CIS 4.4", "MIN_DATA_RETENTION_TIME_IN_DAYS", "at least", 7),
    ParameterRule("CIS 4.5", "REQUIRE_STORAGE_INTEGRATION_FOR_STAGE_CREATION", "true"),
    ParameterRule("CIS 4.6", "REQUIRE_STORAGE_INTEGRATION_FOR_STAGE_OPERATION", "true"),
    ParameterRule("CIS 4.8", "PREVENT_UNLOAD_TO_INLINE_URL", "true"),
    ParameterRule("CIS 4.9", "TRI_SECRET_SECURE", "true"),
    ParameterRule("SE NETWORK", "NETWORK_POLICY", "set"),
    ParameterRule("SE EVENTS", "EVENT_TABLE", "set"),
)
PARAMETERS = list(dict.fromkeys(rule.parameter for rule in PARAMETER_RULES))
NUMERIC_PARAMETERS = {rule.parameter for rule in PARAMETER_RULES if rule.bound is not None}


def _passes(rule: ParameterRule, value: Column) -> Column:
    number = value.try_cast("bigint")
    test = {
        "set": value.isNotNull() & (F.trim(value) != ""),
        "true": is_true(value),
        "equal": number == rule.bound,
        "at least": number >= rule.bound,
    }[rule.test]
    return F.coalesce(test, F.lit(False))


def param_rules(parameters: DataFrame) -> DataFrame:
    """PASS or FAIL of every rule for every account; a parameter that is missing fails.

    Expects one row per account and parameter. A row is judged where it is. Only the set of parameters an
    account has, kept as the bits of one number, is shuffled to find the missing ones.
    """
    name = F.col("parameter")
    verdicts = [
        F.when(name == rule.parameter, F.struct(
            F.lit(rule.rule).alias("rule"), F.when(_passes(rule, F.col("value")), "PASS").otherwise("FAIL").alias("status")
        ))
        for rule in PARAMETER_RULES
    ]
    needed = parameters.where(name.isin(*PARAMETERS))
    judged = needed.select("account_id", "parameter", "value", F.explode(F.array_compact(F.array(*verdicts))).alias("v")).select(
        "account_id", "v.rule", "parameter", "value", "v.status"
    )
    bit = {parameter: 1 << position for position, parameter in enumerate(PARAMETERS)}
    own_bit = F.coalesce(*[F.when(name == parameter, F.lit(value)) for parameter, value in bit.items()], F.lit(0))
    present = parameters.groupBy("account_id").agg(F.bit_or(own_bit).alias("present"))
    absent = [
        F.when(F.col("present").bitwiseAND(F.lit(bit[rule.parameter])) == 0, F.struct(
            F.lit(rule.rule).alias("rule"), F.lit(rule.parameter).alias("parameter")
        ))
        for rule in PARAMETER_RULES
    ]
    missing = present.select("account_id", F.explode(F.array_compact(F.array(*absent))).alias("v")).select(
        "account_id", "v.rule", "v.parameter", F.lit(None).cast("string").alias("value"), F.lit("FAIL").alias("status")
    )
    return judged.unionByName(missing)


def _broken(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition holds, one output row each."""
    names = F.array(*[F.when(condition, name) for name, condition in rules.items()])
    return F.explode(F.array_compact(names))


def user_hygiene(accounts: DataFrame, as_of: Instant, rotate_days: int = 180, inactive_days: int = 90) -> DataFrame:
    """Accounts that break a sign-in rule. Never having logged in counts as inactive."""
    before = lambda days: instant(as_of) - F.make_dt_interval(F.lit(days))
    kind = F.col("kind")
    rules = {
        "CIS 1.4": (kind == "PERSON") & F.col("has_password") & ~F.col("has_mfa"),
        "CIS 1.6": (kind == "LEGACY_SERVICE") & ~F.col("has_key_pair"),
        "CIS 1.7": F.col("key_set_at") < before(rotate_days),
        "CIS 1.8": ~F.col("is_disabled") & (F.col("last_login_at").isNull() | (F.col("last_login_at") < before(inactive_days))),
        "CIS 3.2": kind.isin("SERVICE", "LEGACY_SERVICE") & F.col("network_policy").isNull(),
    }
    return accounts.select("user_id", _broken(rules).alias("rule"))


def roles_with_admin(hierarchy: DataFrame, roles: tuple[str, ...] = ADMIN_ROLES) -> DataFrame:
    """Roles that hold an admin role, directly or through other roles, with the number of grants between."""
    edges = hierarchy.select(F.col("grantee_role").alias("model"), F.col("granted_role").alias("parent"))
    start = edges.where(F.col("parent").isin(*roles)).select(F.col("parent").alias("model"))
    found = lineage_closure(edges, start, "downstream")
    return found.where(~F.col("related").isin(*roles)).groupBy(F.col("related").alias("role_name")).agg(
        F.min("depth").alias("depth")
    )


def admin_roles(
    grants: DataFrame, accounts: DataFrame, hierarchy: DataFrame, max_users: int = 3, roles: tuple[str, ...] = ADMIN_ROLES
) -> DataFrame:
    """Broken rules about admin roles: too many holders, holders without mail, default roles, custom roles."""
    holders = grants.where(F.col("role_name").isin(*roles)).select("user_id", "role_name").distinct()
    too_many = holders.groupBy("role_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_users)
    no_mail = holders.where(F.col("role_name") == roles[0]).join(
        accounts.where(F.col("email").isNull()).select("user_id", "name"), "user_id", "inner"
    )
    default = accounts.where(F.col("default_role").isin(*roles))
    row = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    return (
        row(too_many, "CIS 1.10", "role_name")
        .unionByName(row(no_mail, "CIS 1.11", "name"))
        .unionByName(row(default, "CIS 1.12", "name"))
        .unionByName(row(roles_with_admin(hierarchy, roles), "CIS 1.13", "role_name"))
    )


def privileged_code(objects: DataFrame, roles: tuple[str, ...] = ADMIN_ROLES) -> DataFrame:
    """Tasks and procedures owned by, or run with, an admin role. Without a run role the owner's is used."""
    owned = F.col("owner_role").isin(*roles)
    run = F.coalesce("run_as_role", "owner_role").isin(*roles)
    task, procedure = F.col("object_kind") == "TASK", F.col("object_kind") == "PROCEDURE"
    rules = {"CIS 1.14": task & owned, "CIS 1.15": task & run, "CIS 1.16": procedure & owned, "CIS 1.17": procedure & run}
    return objects.select("object_id", "object_kind", _broken(rules).alias("rule"))


def change_monitor(events: DataFrame, roles: tuple[str, ...] = ADMIN_ROLES) -> DataFrame:
    """Events that a monitoring rule asks to be noticed. Takes a table or a stream."""
    name = F.col("object_name")
    rule = (
        F.when(is_grant_event("ROLE GRANT") & name.isin(*roles), "CIS 2.1")
        .when(is_grant_event("PRIVILEGE GRANT") & (name == "MANAGE GRANTS"), "CIS 2.2")
        .when(is_change("SECURITY INTEGRATION"), "CIS 2.5")
        .when(is_change("NETWORK POLICY"), "CIS 2.6")
        .when(is_change("PROVISIONING TOKEN"), "CIS 2.7")
        .when(is_change("SHARE"), "CIS 2.8")
    )
    return events.withColumn("rule", rule).where(F.col("rule").isNotNull())


def version_parts(version: Column) -> Column:
    """``3.10.2`` as numbers that compare part by part; a version with another part is not judged (NULL)."""
    return F.when(version.rlike(r"^\d+(\.\d+)*$"), F.split(version, r"\.").cast("array<int>"))


def session_monitor(logins: DataFrame, minimum_versions: Mapping[str, str]) -> DataFrame:
    """Logins with a password alone, and logins by a client below the supported version.

    A client kind without a minimum is not judged.
    """
    pairs = [F.lit(part) for pair in minimum_versions.items() for part in pair]
    minimum = F.try_element_at(F.create_map(*pairs), F.col("client_kind"))
    rules = {
        "CIS 2.4": F.col("is_success") & (F.col("first_factor") == "PASSWORD") & F.col("second_factor").isNull(),
        "CIS 2.9": version_parts(F.col("client_version")) < version_parts(minimum),
    }
    return logins.select("login_id", "ts", "user_id", _broken(rules).alias("rule"))


def object_coverage(stages: DataFrame, columns: DataFrame, policies: DataFrame) -> DataFrame:
    """Stages without encryption or integration, and sensitive data without a masking or row policy."""
    kind = F.col("stage_kind")
    rules = {
        "CIS 4.2": (kind == "INTERNAL") & (F.coalesce("encryption", F.lit("NONE")) != "AES-256"),
        "CIS 4.7": (kind == "EXTERNAL") & F.col("storage_integration").isNull(),
    }
    sensitive = columns.where("is_sensitive").select("table_name", "column_name")
    masked = policies.where(F.col("policy_kind") == "MASKING").select("table_name", "column_name")
    row_checked = policies.where(F.col("policy_kind") == "ROW_ACCESS").select("table_name")
    unmasked = sensitive.join(masked, ["table_name", "column_name"], "left_anti").select(
        F.concat_ws(".", "table_name", "column_name").alias("subject"), F.lit("CIS 4.10").alias("rule")
    )
    unchecked = sensitive.select("table_name").distinct().join(row_checked, "table_name", "left_anti").select(
        F.col("table_name").alias("subject"), F.lit("CIS 4.11").alias("rule")
    )
    return stages.select(F.col("object_name").alias("subject"), _broken(rules).alias("rule")).unionByName(unmasked).unionByName(unchecked)
