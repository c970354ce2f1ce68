"""Slowly changing tables: versions of rows with the interval in which each was valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.functions.time import Instant, instant

OPEN_FROM, OPEN_TO = "valid_from", "valid_to"


def snapshot_timestamp(
    current: DataFrame, history: DataFrame, key: str, updated_at: str, as_of: Instant, hard_deletes: bool = False
) -> DataFrame:
    """Next history when a newer ``updated_at`` marks a changed row.

    The new version starts, and the old one ends, at the new ``updated_at``.
    """
    newer = F.coalesce(F.col(f"cur.{updated_at}") > F.col(f"old.{updated_at}"), F.lit(False))
    return _next_history(current, history, key, newer, F.col(f"cur.{updated_at}"), as_of, hard_deletes)


def snapshot_check(
    current: DataFrame, history: DataFrame, key: str, columns: list[str] | str, as_of: Instant, hard_deletes: bool = False
) -> DataFrame:
    """Next history when a difference in the checked columns (or ``'all'``) marks a changed row.

    Two NULLs are equal. Versions change at ``as_of``.
    """
    checked = [c for c in current.columns if c != key] if columns == "all" else columns
    differs = F.lit(False)
    for column in checked:
        differs = differs | ~F.col(f"cur.{column}").eqNullSafe(F.col(f"old.{column}"))
    return _next_history(current, history, key, differs, instant(as_of), as_of, hard_deletes)


def hard_deletes(current: DataFrame, history: DataFrame, key: str, as_of: Instant) -> DataFrame:
    """History in which every open version whose key left the source ends at ``as_of``."""
    present = current.select(key).distinct().withColumn("_present", F.lit(True))
    open_rows = history.where(F.col(OPEN_TO).isNull()).join(present, key, "left")
    ended = F.when(F.col("_present").isNull(), instant(as_of))
    return history.where(F.col(OPEN_TO).isNotNull()).unionByName(
        open_rows.withColumn(OPEN_TO, ended).select(*history.columns)
    )


def _next_history(
    current: DataFrame, history: DataFrame, key: str, changed: Column, changed_at: Column, as_of: Instant, close_missing: bool
) -> DataFrame:
    """One full join of the open versions with the source; closed versions pass by untouched.

    Both sides hold a key once, so no key can fill a task. A changed row yields two versions.
    """
    source = [c for c in history.columns if c not in (OPEN_FROM, OPEN_TO)]
    version = lambda side, start, end: F.struct(
        *[F.col(f"{side}.{c}").alias(c) for c in source], start.alias(OPEN_FROM), end.alias(OPEN_TO)
    )
    none = F.lit(None).cast("timestamp")
    old_start = F.col(f"old.{OPEN_FROM}")
    kept = version("old", old_start, none)
    missing = version("old", old_start, instant(as_of) if close_missing else none)
    ended = version("old", old_start, changed_at)
    started = version("cur", changed_at, none)

    open_rows = history.where(F.col(OPEN_TO).isNull()).alias("old")
    joined = open_rows.join(current.alias("cur"), F.col(f"old.{key}") == F.col(f"cur.{key}"), "full_outer")
    versions = (
        F.when(F.col(f"old.{key}").isNull(), F.array(started))
        .when(F.col(f"cur.{key}").isNull(), F.array(missing))
        .when(changed, F.array(ended, started))
        .otherwise(F.array(kept))
    )
    next_open = joined.select(F.explode(versions).alias("v")).select("v.*")
    return history.where(F.col(OPEN_TO).isNotNull()).unionByName(next_open)


def validity_from_history(changes: DataFrame, key: str, updated_at: str, unit: str = "hour") -> DataFrame:
    """Validity of every row of a change log: it ends when the next row of the same key starts.

    Each key's log is cut into calendar units. The start of the next unit is looked up in a small table
    of first times, so a key that holds a large part of the log is still spread over many tasks.
    ``updated_at`` must differ between the rows of a key.
    """
    cut = changes.withColumn("_unit", F.date_trunc(unit, updated_at))
    firsts = cut.groupBy(key, "_unit").agg(F.min(updated_at).alias("_first"))
    following = firsts.select(
        key, "_unit", F.lead("_first").over(Window.partitionBy(key).orderBy("_unit")).alias("_next_unit_first")
    )
    within_unit = F.lead(updated_at).over(Window.partitionBy(key, "_unit").orderBy(updated_at))
    return (
        cut.join(following, [key, "_unit"], "left")
        .withColumn(OPEN_FROM, F.col(updated_at))
        .withColumn(OPEN_TO, F.coalesce(within_unit, "_next_unit_first"))
        .select(*changes.columns, OPEN_FROM, OPEN_TO)
    )
