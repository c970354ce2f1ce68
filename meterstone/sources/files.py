"""Readers for the file kinds besides Parquet tables: run artifacts, run logs and seed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = "run_id string, nodes map<string, struct<project: string, depends_on: struct<nodes: array<string>>>>"
RUN_RESULTS_SCHEMA = "run_id string, results array<struct<unique_id: string, status: string, execution_time: double>>"


def read_artifacts(spark: SparkSession, folder: str, names: str, schema: str, one_document_per_file: bool = True) -> DataFrame:
    """JSON artifacts with one of the given names, found in the folder or below it.

    The schema is given, so no file is read just to guess it. Files are read in parallel; a file with one
    document per line is also split.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return reader.option("multiLine", one_document_per_file).json(folder)


def run_results(artifacts: DataFrame) -> DataFrame:
    """One row per model result of the run-result artifacts."""
    rows = artifacts.select("run_id", F.explode("results").alias("r"))
    return rows.select("run_id", F.col("r.unique_id").alias("model"), F.col("r.status").alias("status"),
                       F.col("r.execution_time").alias("execution_seconds"))


#: The two documents a run leaves behind.
ARTIFACTS = ("manifest.json", "run_results.json")


def artifact_documents(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The named artifacts in a folder or below it, each file one document: (path, artifact, document).

    Documents are variants: fields that come, go or change their type between versions do no harm, and all are kept. A file that
    holds no valid JSON has a NULL document. With ``stream`` new files are taken up as they arrive, each once.
    """
    reader = (spark.readStream if stream else spark.read).format("text").option("wholetext", True).option("recursiveFileLookup", True)
    names = reader.option("pathGlobFilter", "{" + ",".join(ARTIFACTS) + "}")
    files = (names.schema("value string") if stream else names).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("artifact"), F.try_parse_json("value").alias("document"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Write each row (folder, name, value) as one file ``folder/name``; the tasks write all of them in one job."""
    spark, aside = documents.sparkSession, f"{folder.rstrip('/')}/_aside"
    documents.repartition("folder", "name").write.partitionBy("folder", "name").text(aside)
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in system.globStatus(jvm.Path(f"{aside}/*/*/part-*")):
        name = part.getPath().getParent()
        target = jvm.Path(f"{folder.rstrip('/')}/{name.getParent().getName().partition('=')[2]}/{name.getName().partition('=')[2]}")
        system.mkdirs(target.getParent())
        system.rename(part.getPath(), target)
    system.delete(jvm.Path(aside), True)


def document_nodes(documents: DataFrame) -> DataFrame:
    """Model rows (run_id, model, project, depends_on, node) of manifests; ``node`` keeps all other fields."""
    manifests = documents.where(F.col("artifact") == ARTIFACTS[0])
    nodes = manifests.select(_field("document", "$.run_id", "string").alias("run_id"), F.explode(_field("document", "$.nodes", "map<string,variant>")).alias("model", "node"))
    return nodes.select("run_id", "model", _field("node", "$.project", "string").alias("project"),
                        F.coalesce(_field("node", "$.depends_on.nodes", "array<string>"), F.array().cast("array<string>")).alias("depends_on"), "node")


def document_results(documents: DataFrame) -> DataFrame:
    """One row per model result (run_id, model, status, execution_seconds, result) of the run results."""
    results = documents.where(F.col("artifact") == ARTIFACTS[1])
    rows = results.select(_field("document", "$.run_id", "string").alias("run_id"), F.explode(_field("document", "$.results", "array<variant>")).alias("result"))
    return rows.select("run_id", _field("result", "$.unique_id", "string").alias("model"), _field("result", "$.status", "string").alias("status"),
                       _field("result", "$.execution_time", "double").alias("execution_seconds"), "result")


def _field(column: str, path: str, kind: str) -> Column:
    """A field of a variant; NULL where it is missing or does not fit the type."""
    return F.try_variant_get(column, path, kind)


def read_run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines kept under ``object_name=<name>`` folders, each starting with its run id and a tab.

    The object is a partition column, so a question about few objects opens only their folders.
    """
    parts = F.split("value", "\t", 2)
    return spark.read.text(folder).select(
        "object_name", parts[0].cast("bigint").alias("run_id"), F.get(parts, 1).alias("line")
    )


def load_seed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Small reference table kept as CSV with a header; a row that does not fit the schema is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
