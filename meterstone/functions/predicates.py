"""Row tests shared by the inventory and finding reports. State is kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterstone.fixed_values import HIGH_TIER_FROM_SECONDS, MEDIUM_TIER_FROM_SECONDS, SEVERITIES


def is_true(state: str | Column) -> Column:
    """Any spelling of TRUE; NULL stays NULL."""
    return F.upper(state) == "TRUE"


def is_not_true(state: str | Column) -> Column:
    """FALSE, any other text, or NULL."""
    return ~F.coalesce(is_true(state), F.lit(False))


def is_true_or_false(state: str | Column) -> Column:
    """TRUE test with NULL read as FALSE."""
    column = F.col(state) if isinstance(state, str) else state
    return F.upper(F.coalesce(column, F.lit("FALSE"))) == "TRUE"


def is_open_finding(state: str = "state", at_risk: str = "total_at_risk_count") -> Column:
    return (F.col(state).isNull() | (F.upper(state) == "OPEN")) & (F.col(at_risk) > 0)


def severity_rank(severity: str) -> Column:
    """Position of a severity from the gravest on; unknown ones come last."""
    upper = F.upper(severity)
    rank = F.lit(len(SEVERITIES) + 1)
    for position, name in reversed(list(enumerate(SEVERITIES, start=1))):
        rank = F.when(upper == name, position).otherwise(rank)
    return rank


def duration_tier(seconds: str) -> Column:
    """Cost tier of a scanner by its mean duration."""
    mean = F.col(seconds)
    return F.when(mean >= HIGH_TIER_FROM_SECONDS, "HIGH").when(mean >= MEDIUM_TIER_FROM_SECONDS, "MEDIUM").otherwise("LOW")
