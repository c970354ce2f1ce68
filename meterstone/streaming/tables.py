"""Streams over table folders, run once or at an interval."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Keyed state needs this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of the row that closes all windows of a stream whose input has ended.
FAR_AHEAD = dt.datetime(9000, 1, 1)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of one table as a stream; the schema is that of the files already there."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def state_partitions(spark: SparkSession, path: str, bytes_each: int = 4 << 20, least: int = 4) -> int:
    """Partitions of a stream's state, by the size of the table it reads. They stay as they are for as long as the stream lives."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(least, -(-size // bytes_each))


@contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """A query keeps the settings it was started with; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _start(spark: SparkSession, writer: DataStreamWriter, folder: str, every: str | None, path: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Start a query; without an interval it takes the input there is now and has ended on return."""
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with _settings(spark, **{STORE: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})):
        query = writer.start(path) if path else writer.start()
    if not every:
        query.awaitTermination()
    return query


def run_rows(stream: DataFrame, folder: str, every: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Append the rows of a stream to the table ``folder/rows``, once or at an interval such as ``1 hour``.

    ``partitions`` (of the state) counts when the stream starts for the first time; the session's setting otherwise.
    """
    return _start(stream.sparkSession, stream.writeStream.format("parquet").outputMode("append"), folder, every, f"{folder}/rows", partitions)


def run_to_end(stream: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Process all input there is now, and return the table of results."""
    run_rows(stream, folder, partitions=partitions)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_closed(build: Callable[[DataFrame], DataFrame], rows: DataFrame, folder: str, ts: str, partitions: int | None = None, **values) -> DataFrame:
    """``run_to_end`` of ``build(rows)`` for a table that has come to its end, so that no window stays open.

    After all input one more row, far ahead in time, moves the watermark past every window and timer. It belongs to a window that never
    closes, so it is in no result. Its columns are blank or zero, or as in ``values`` where ``build`` would drop such a row at once.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    ends = spark.createDataFrame([], rows.schema)
    ends.write.mode("append").parquet(f"{folder}/ends")
    closing = spark.readStream.schema(rows.schema).parquet(f"{folder}/ends")
    run_rows(build(rows.unionByName(closing)), folder, partitions=partitions)
    blank = {f.name: F.lit("" if f.dataType.typeName() == "string" else False if f.dataType.typeName() == "boolean" else 0) for f in rows.schema.fields
             if f.dataType.typeName() in ("string", "boolean", "integer", "long", "double", "decimal")}
    row = blank | {ts: F.lit(FAR_AHEAD)} | {k: F.lit(v) for k, v in values.items()}
    spark.range(1).select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.mode("append").parquet(f"{folder}/ends")
    return run_to_end(build(rows.unionByName(closing)), folder, partitions)


def run_batches(
    stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Call ``step`` for every micro-batch, once or at an interval."""
    return _start(stream.sparkSession, stream.writeStream.foreachBatch(step).outputMode(mode), folder, every)
