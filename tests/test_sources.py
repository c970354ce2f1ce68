import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from meterstone import session
from meterstone.operators import governance as g
from meterstone.operators import usage as u
from meterstone.operators import workflow as w
from meterstone.sources import files, sinks
from tests.conftest import dec, plan_of, rows, ts

USAGE = "start_time timestamp, end_time timestamp, username string, credits decimal(38,6), request_count bigint, unused string"


@pytest.fixture
def analyst(spark):
    return spark.range(400).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id") % 20, F.col("id") % 24)).alias("start_time"),
        F.lit("2024-02-01").cast("timestamp").alias("end_time"), F.concat(F.lit("u"), F.col("id") % 5).alias("username"),
        F.lit(dec(1)).cast("decimal(38,6)").alias("credits"), F.col("id").alias("request_count"), F.lit("x").alias("unused"),
    )


def test_cutoff_and_columns_reach_the_scan(spark, analyst, tmp_path):
    analyst.write.parquet(str(tmp_path / "flat"))
    plan = plan_of(u.load_analyst(spark.read.parquet(str(tmp_path / "flat")), dt.date(2024, 1, 15)))
    assert "GreaterThanOrEqual(start_time,2024-01-15" in plan
    assert "unused" not in plan


def test_usage_table_skips_days_and_keeps_rows(spark, analyst, tmp_path):
    path = str(tmp_path / "daily")
    sinks.write_usage_table(analyst, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 400
    loaded = u.load_analyst(stored, dt.date(2024, 1, 15))
    assert "usage_date" in plan_of(loaded).split("PartitionFilters:")[1].split("\n")[0]
    assert loaded.count() == analyst.where(F.to_date("start_time") >= F.lit(dt.date(2024, 1, 15))).count()
    assert len(list((tmp_path / "daily").glob("usage_date=*"))) == 20


def test_table_is_created_once(spark, tmp_path):
    path = str(tmp_path / "state")
    first, second = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    assert sinks.create_if_absent(first, path) and not sinks.create_if_absent(second, path)
    assert rows(spark.read.parquet(path)) == [(1,)]


def test_layers_keep_models_as_asked(spark, tmp_path):
    model = spark.range(3)
    assert sinks.materialise(model, "m", "staging").count() == 3 and spark.catalog.tableExists("staging_m")
    assert sinks.materialise(model, "m", "intermediate") is model
    assert sinks.materialise(model, "m", "marts", str(tmp_path)).count() == 3 and (tmp_path / "marts" / "m").is_dir()
    spark.sql("CREATE SCHEMA IF NOT EXISTS marts")
    assert sinks.materialise(model, "m", "marts").count() == 3 and spark.catalog.tableExists("marts.m")


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_report_formats(spark, tmp_path, fmt):
    report = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    sinks.write_report(report, str(tmp_path / fmt), fmt)
    reader = spark.read.schema(report.schema)
    back = reader.option("header", True).csv(str(tmp_path / fmt)) if fmt == "csv" else reader.json(str(tmp_path / fmt))
    assert rows(back) == rows(report)
    with pytest.raises(ValueError):
        sinks.write_report(report, str(tmp_path / "x"), "xml")
    sinks.report_text(report)


def test_artifacts_of_several_runs(spark, tmp_path):
    manifest = {"run_id": "r", "nodes": {"b": {"project": "p", "depends_on": {"nodes": ["a"]}}, "a": {"project": "p", "depends_on": {"nodes": []}}}}
    results = {"run_id": "r", "results": [{"unique_id": "a", "status": "success", "execution_time": 1.5}]}
    for run in ("one", "two"):
        folder = tmp_path / run
        folder.mkdir()
        (folder / "manifest.json").write_text(json.dumps({**manifest, "run_id": run}, indent=2))
        (folder / "run_results.json").write_text(json.dumps({**results, "run_id": run}, indent=2))
        (folder / "catalog.json").write_text("{not json")
    manifests = files.read_artifacts(spark, str(tmp_path), "manifest.json", files.MANIFEST_SCHEMA)
    nodes = w.artifact_nodes(manifests)
    assert nodes.count() == 4 and rows(w.lineage_edges(nodes)) == [("b", "a")]
    found = files.run_results(files.read_artifacts(spark, str(tmp_path), "run_results.json", files.RUN_RESULTS_SCHEMA))
    assert rows(found, "run_id", "model", "execution_seconds") == [("one", "a", 1.5), ("two", "a", 1.5)]


def test_log_of_the_latest_run(spark, tmp_path):
    for name, lines in {"a": ["1\told", "2\tnew\twith tab", "2\tend"], "b": ["7\tonly"]}.items():
        folder = tmp_path / f"object_name={name}"
        folder.mkdir()
        (folder / "log.txt").write_text("\n".join(lines))
    history = spark.createDataFrame([(1, "a", ts("2024-01-01")), (2, "a", ts("2024-01-02")), (7, "b", ts("2024-01-01"))],
                                    "query_id bigint, object_name string, query_end_time timestamp").withColumn(
        "query_start_time", F.col("query_end_time")).withColumn("execution_status", F.lit("SUCCESS"))
    log = files.read_run_log(spark, str(tmp_path))
    assert rows(w.latest_logged_run(history, log)) == [("a", 2, "end"), ("a", 2, "new\twith tab"), ("b", 7, "only")]


def test_seed_rejects_bad_rows(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("code,name\n1,One\n2,Two\n")
    assert rows(files.load_seed(spark, str(tmp_path / "seed.csv"), "code int, name string")) == [(1, "One"), (2, "Two")]
    (tmp_path / "bad.csv").write_text("code,name\nx,One\n")
    with pytest.raises(Exception):
        files.load_seed(spark, str(tmp_path / "bad.csv"), "code int, name string").collect()


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == configured
    assert session.work_folder(spark, "x").startswith(configured)
    cut = session.cut_lineage(spark.range(5))
    assert cut.count() == 5 and "ExistingRDD" in plan_of(cut)


def test_snapshot_of_state(spark):
    scanners = spark.createDataFrame([(1, "a", "TRUE", "c", None, "P"), (2, "b", None, "c", None, "GONE")],
                                     "id bigint, name string, state string, schedule string, notification string, scanner_package_id string")
    packages = spark.createDataFrame([("P", "Pack", "TRUE")], "id string, name string, state string")
    assert rows(g.state_snapshot(scanners, packages, "2024-01-01"), "scanner_id", "pkg_name", "snapshot_time") == [
        (1, "Pack", ts("2024-01-01")), (2, None, ts("2024-01-01"))]


def test_bucketed_usage_needs_no_shuffle(spark):
    from meterstone.plans.usage_queries import FIRST_DAY
    from meterstone.sources.views import Views

    views = Views(spark, "/root/testdata/sf0.001")
    sinks.save_bucketed_usage(views.ai_usage, "bucketed_usage", 4, mode="overwrite")
    stored = u.ai_rows(spark.table("bucketed_usage"), FIRST_DAY)
    assert "Exchange" not in plan_of(stored)
    assert rows(stored) == rows(u.ai_rows(views.ai_usage, FIRST_DAY))
