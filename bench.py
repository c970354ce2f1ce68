"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and is then timed once or more (BENCH_RUNS); the median counts. A query is timed
from building its plan to the end of writing all its rows to a sink that discards them. BENCH_ALL=1 times all
registered queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from meterstone.plans import REGISTRY

HEADLINE = [
    "load_ai_functions", "metric_pivot", "load_analyst", "ai_by_model_and_user", "blended_cost", "service_breakdown",
    "daily_by_service", "credits_by_user", "ai_by_day", "ai_by_user", "kpi_row", "long_running", "duration_histogram",
    "scanner_counts", "open_findings", "findings_matrix", "run_rate", "avg_scan_duration", "health_check", "validation_report",
    "state_diff", "first_breach", "limit_enforcement", "grant_upsert", "runaway_detection", "daily_limit_check",
    "budget_thresholds", "snapshot_timestamp", "snapshot_check_all", "validity_from_history", "latest_run",
    "layered_models", "test_report", "lineage_downstream", "auth_failures", "long_query_outliers", "dormant_login",
    "unusual_ip_login", "param_rules", "scenario_cost", "savings_plan", "expected_vs_actual_runs", "hourly_usage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
