"""Session settings and the shared folders long jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shuffle_partitions_for(shuffled_bytes: int, partition_bytes: int = 512 << 20) -> int:
    """Partitions that keep each one near ``partition_bytes``; adaptive execution merges the ones that turn out small."""
    return max(200, -(-shuffled_bytes // partition_bytes))


def build_session(
    app_name: str = "meterstone", master: str | None = None, shuffled_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC timestamps.

    ``shuffled_bytes`` is the size of the largest shuffle expected, such as the usage columns of one report.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if shuffled_bytes:
        defaults["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions_for(shuffled_bytes))
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a cluster the
    setting is required, because a folder on one machine does not outlive that machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="meterstone-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df):
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for one job's written tables, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/meterstone/{label}-{uuid.uuid4().hex}"
