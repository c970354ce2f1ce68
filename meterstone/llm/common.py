"""What the operators share: tables, written intermediate results, and ranks without one-task sorts."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.session import work_folder

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, work_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete a table written by ``stored`` that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, value: object) -> Broadcast:
    """Send an object of one of this package's classes to all tasks as bytes that carry the class; ``received`` reads it.

    Broadcasts alone name the class, which workers without the package could not find.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast) -> object:
    return pickle.loads(broadcast.value)


def lower_az(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, keys: list[str], order: Column, name: str, buckets: int = 256) -> DataFrame:
    """Number the rows of each key from 0 without gaps, however many rows a key has.

    ``order`` is hashed: rows are dealt into ``buckets`` per key, numbered inside their bucket, and shifted by the
    sizes of the buckets before it. Only the counts (keys times buckets) meet in one place per key, never the rows.
    The column ``__bucket`` must not exist. The order is that of the hash, then of ``order`` itself.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    numbered = dealt.withColumn("__i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "__bucket"]).withColumn(
        name, (F.col("__before") + F.col("__i")).cast("long")).drop("__bucket", "__before", "__i")


def crc32_rest(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
