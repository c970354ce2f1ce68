"""Tables laid out in buckets of their key, of which an upsert reads and writes only the ones it touches.

Each bucket is a folder of the table and, to Spark, one bucket of its hash partitioning on the key. So a join on the key takes the table as
it lies, without moving it, and a change replaces whole folders: Spark writes the new ones aside and puts them in place when all are done.
Readers and repeated changes see a bucket before or after a change, never in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.functions.time import Instant
from meterstone.operators import limits

BUCKET, KEY = "bucket", "user_name"


def bucket_of(key: str, buckets: int) -> Column:
    """The number Spark's own bucketing gives a key."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def save_buckets(df: DataFrame, table: str, buckets: int, key: str = KEY, path: str | None = None) -> None:
    """Write a table in ``buckets`` buckets of ``key``."""
    dealt = df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(buckets, key)
    writer = dealt.write.partitionBy(BUCKET).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def bucket_count(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} has no buckets")
    return int(rows[0]["data_type"])


def touched(changes: DataFrame, buckets: int, key: str = KEY) -> list[int]:
    """The buckets that keys of ``changes`` belong to: numbers below ``buckets``."""
    return sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())


def read_buckets(spark: SparkSession, table: str, numbers: list[int] | None = None) -> DataFrame:
    """The rows of all or of some buckets; the other folders are not opened. Files replaced by another session are seen."""
    spark.catalog.refreshTable(table)
    rows = spark.table(table)
    return (rows if numbers is None else rows.where(F.col(BUCKET).isin(numbers))).drop(BUCKET)


def replace_buckets(rows: DataFrame, table: str, buckets: int, key: str = KEY) -> None:
    """Put ``rows`` in place of all rows of the buckets they belong to."""
    spark = rows.sparkSession
    columns = [c for c in spark.table(table).columns if c != BUCKET]
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        rows.select(*columns, bucket_of(key, buckets).alias(BUCKET)).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(name, before)


def grant(table: str, grants: DataFrame, users: DataFrame, as_of: Instant) -> list[int]:
    """Upsert a batch of grants into the bucketed access table; gives the buckets written.

    Only grants and names move. The rows of the touched buckets stay where they lie.
    """
    spark = grants.sparkSession
    buckets = bucket_count(spark, table)
    numbers = touched(grants, buckets)
    if numbers:
        replace_buckets(merged(table, grants, users, as_of, numbers), table, buckets)
    return numbers


def merged(table: str, grants: DataFrame, users: DataFrame, as_of: Instant, numbers: list[int]) -> DataFrame:
    """The touched buckets after the grants."""
    return limits.grant_upsert(read_buckets(grants.sparkSession, table, numbers), grants, users, as_of)


def update_rows(table: str, users: DataFrame, change: Callable[[DataFrame, DataFrame, Instant | Column], DataFrame], as_of: Instant | Column) -> list[int]:
    """Replace the rows that ``change(access, users, as_of)`` gives for ``users`` (user_name); gives the buckets written."""
    spark = users.sparkSession
    buckets = bucket_count(spark, table)
    numbers = touched(users, buckets)
    if numbers:
        access = read_buckets(spark, table, numbers)
        changed = change(access, users, as_of)
        others = access.join(changed.select(KEY).hint("merge"), KEY, "left_anti")
        replace_buckets(others.unionByName(changed), table, buckets)
    return numbers
