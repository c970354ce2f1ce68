"""Stored row versions, laid out so that a run reads and writes only what changes.

Open versions lie in one folder, closed ones in a folder for the month they ended in. A run reads the open folder, and writes it anew together
with the months it has closed versions in; the folders of all other months are neither read nor written. Spark writes the new folders
aside and puts them in place at the end. A run that is repeated finds nothing more to close, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.operators.snapshots import OPEN_TO

PART, OPEN = "ended", "open"


def part_of(valid_to: str = OPEN_TO) -> Column:
    return F.coalesce(F.date_format(valid_to, "yyyy-MM"), F.lit(OPEN))


def save_history(history: DataFrame, path: str) -> None:
    """Lay out a whole history. Rows of a month are spread over several writers."""
    history.withColumn(PART, part_of()).hint("rebalance", PART).write.partitionBy(PART).parquet(path)


def read_history(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """All versions, or those of some folders."""
    rows = spark.read.parquet(path)
    if parts is None:
        return rows.drop(PART)
    return rows.where(F.col(PART).cast("string").isin(parts)).drop(PART)


def advance(spark: SparkSession, path: str, step: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Apply a snapshot function to the open versions and store the outcome; gives the months written besides the open folder.

    ``step`` gets the open versions as its history, such as ``lambda held: snapshot_check(current, held, ...)``.
    """
    columns = read_history(spark, path).columns
    held = step(read_history(spark, path, [OPEN])).select(*columns).persist(StorageLevel.DISK_ONLY)
    try:
        months = sorted(r[0] for r in held.where(F.col(OPEN_TO).isNotNull()).select(part_of()).distinct().collect())
        if not months and held.count() == read_history(spark, path, [OPEN]).count():
            return []  # no version has ended, so nothing but new keys could differ
        rows = held.unionByName(read_history(spark, path, months)) if months else held
        dealt = rows.withColumn(PART, part_of()).hint("rebalance", PART)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        if held.where(F.col(OPEN_TO).isNull()).isEmpty():
            # No row went there, so the write has left the old folder as it was.
            held.limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{PART}={OPEN}")
    finally:
        held.unpersist()
    return months
