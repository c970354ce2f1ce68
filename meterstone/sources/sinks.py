"""Writers: usage tables laid out for date pruning, state tables, snapshots, model layers and text reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.operators.workflow import observed_report, observed_tests


def write_usage_table(df: DataFrame, path: str, ts: str = "start_time", mode: str = "append") -> None:
    """Usage history partitioned by day. Rows of one day are spread over several writers, so no day
    is written by one task, and each file is sorted by time for tight min/max values."""
    dated = df.withColumn("usage_date", F.to_date(ts))
    spread = dated.hint("rebalance", "usage_date")
    spread.sortWithinPartitions("usage_date", ts).write.mode(mode).partitionBy("usage_date").parquet(path)


def z_value(columns: dict[str, list], bits: int) -> Column:
    """Place along a Z-shaped curve through all columns: the bits of each column's rank take turns.

    ``columns`` holds sorted bounds of each; a value's rank is the number of bounds below it.
    """
    def rank(column: str, bounds: list) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound < F.col(column)))

    ranks = [rank(*item) for item in columns.items()]
    terms = [F.shiftleft(F.shiftright(r, bit).bitwiseAND(1).cast("bigint"), bit * len(ranks) + k) for k, r in enumerate(ranks) for bit in range(bits)]
    total = terms[0]
    for term in terms[1:]:
        total = total.bitwiseOR(term)
    return total


def _orderly(df: DataFrame, column: str) -> Column:
    """A number that orders like the column: texts by their first seven bytes."""
    if df.schema[column].dataType.typeName() != "string":
        return F.col(column).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")


def write_z_ordered_usage(df: DataFrame, path: str, columns: tuple[str, ...] = ("start_time", "user_id", "model_name"), bits: int = 6,
                          ts: str = "start_time", mode: str = "append", row_group_bytes: int | None = None) -> None:
    """Usage history partitioned by day, and inside each day ordered along a curve through several columns.

    Row groups then hold a narrow range of each column, so a filter on any of them skips most. The bounds of the ranks are
    approximate quantiles, a fixed number for each column. Days are split over writers by ranges of the curve.
    """
    dated = df.withColumn("usage_date", F.to_date(ts))
    places = {ts: F.unix_timestamp(ts) - F.unix_timestamp(F.col("usage_date").cast("timestamp"))}
    numbered = dated.select("*", *[places.get(c, _orderly(dated, c)).cast("double").alias(f"_z_{c}") for c in columns])
    parts = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = numbered.agg(*[F.percentile_approx(f"_z_{c}", parts, 10_000).alias(c) for c in columns]).first()
    value = z_value({f"_z_{c}": sorted(set(bounds[c] or [])) or [0.0] for c in columns}, bits)
    curved = numbered.withColumn("_z", value).drop(*[f"_z_{c}" for c in columns])
    writer = curved.repartitionByRange("usage_date", "_z").sortWithinPartitions("usage_date", "_z").drop("_z").write.mode(mode).partitionBy("usage_date")
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


def save_bucketed_usage(df: DataFrame, table: str, buckets: int, mode: str = "errorifexists", path: str | None = None) -> None:
    """Usage history as a catalog table bucketed by query and hour.

    Both columns belong to the row key, so collapsing equal rows needs no shuffle when the table is read. With
    the hour in the bucket key, a query that holds a large part of the rows is still spread over the buckets.
    """
    writer = df.write.mode(mode).bucketBy(buckets, "query_id", "start_time").sortBy("query_id", "start_time")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def create_if_absent(df: DataFrame, path: str) -> bool:
    """Write the table unless it is there already; tells whether it was written."""
    if table_exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def append_alert_state(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# Each layer's way of keeping a model: a view, nothing (inlined where used), or a stored table.
LAYER_MATERIALISATION = {"staging": "view", "intermediate": "ephemeral", "marts": "table"}


def materialise(df: DataFrame, name: str, layer: str, folder: str | None = None) -> DataFrame:
    """Keep a model the way its layer asks for, and return the frame to build on."""
    kind = LAYER_MATERIALISATION[layer]
    if kind == "view":
        df.createOrReplaceTempView(f"{layer}_{name}")
        return df.sparkSession.table(f"{layer}_{name}")
    if kind == "ephemeral":
        return df
    if folder is None:
        df.write.mode("overwrite").saveAsTable(f"{layer}.{name}")
        return df.sparkSession.table(f"{layer}.{name}")
    path = f"{folder.rstrip('/')}/{layer}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialise_tested(df: DataFrame, name: str, layer: str, folder: str, failures: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Store a model and test its rows on the way: the stored model, and the test report. No second scan takes place."""
    if LAYER_MATERIALISATION[layer] != "table":
        raise ValueError(f"models of the layer {layer} are not stored, so nothing would count their rows")
    watched, counter = observed_tests(df, failures)
    stored = materialise(watched, name, layer, folder)
    return stored, observed_report(df.sparkSession, counter)


def write_report(df: DataFrame, path: str, fmt: str) -> None:
    """Report rows as ``csv`` with a header or as ``json`` lines, written in parallel."""
    if fmt == "csv":
        df.write.option("header", True).csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")


def report_text(df: DataFrame, n: int | None = None) -> None:
    """Print a report as a text table: all rows, or the first ``n`` and how many are left out."""
    rows = df.count()
    df.show(rows if n is None else n, truncate=False)
    if n is not None and rows > n:
        print(f"{rows - n} more rows")
