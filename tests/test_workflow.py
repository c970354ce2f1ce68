from pyspark.sql import functions as F

from meterstone.operators import workflow as w
from tests.conftest import dec, rows, ts

RUNS = "query_id bigint, object_name string, query_start_time timestamp, query_end_time timestamp, execution_status string"


def run(query, name, end, status="SUCCESS", start="2024-01-01T00:00:00"):
    return (query, name, ts(start), None if end is None else ts(end), status)


def runs(spark, *data):
    return spark.createDataFrame(list(data), RUNS)


def test_latest_run_breaks_ties_and_skips_unfinished(spark):
    history = runs(spark, run(1, "a", "2024-01-02"), run(2, "a", "2024-01-02"), run(9, "a", None), run(3, "b", "2024-01-01"), run(4, "c", None))
    assert rows(w.latest_run(history), "object_name", "query_id") == [("a", 2), ("b", 3)]


def test_execution_history_puts_unfinished_last(spark):
    history = runs(spark, run(1, "a", None), run(2, "a", "2024-01-02"), run(3, "a", "2024-01-03"), run(4, "b", "2024-01-03"))
    assert [r.query_id for r in w.execution_history(history, "a").collect()] == [3, 2, 1]
    assert [r.query_id for r in w.execution_history(history, "a", 1).collect()] == [3]


def test_run_summary(spark):
    history = runs(spark, run(1, "a", "2024-01-01T00:00:10"), run(2, "a", "2024-01-01T00:00:15"), run(3, "a", None, "RUNNING"))
    assert rows(w.run_summary(history), "execution_status", "runs", "avg_seconds") == [("RUNNING", 1, None), ("SUCCESS", 2, dec("12.5"))]


def test_task_history_window(spark):
    data = spark.createDataFrame([(1, "t", ts("2024-01-24")), (2, "t", ts("2024-01-23T23:59:59")), (3, "u", ts("2024-01-31"))],
                                 "query_id bigint, name string, scheduled_time timestamp")
    assert rows(w.task_history(data, "t", "2024-01-31"), "query_id") == [(1,)]


def test_data_tests(spark):
    orders = spark.createDataFrame([(1, 5, 10.0), (1, 6, 0.0), (2, None, -1.0), (3, 7, None)], "id bigint, customer bigint, amount double")
    customers = spark.createDataFrame([(5,), (6,)], "customer_id bigint")
    assert rows(w.assert_positive_amounts(orders, "amount"), "id") == [(1,), (2,)]
    report = w.test_report(
        w.column_tests(orders, {"positive": F.col("amount") <= 0, "present": F.col("amount").isNull(), "small": F.col("amount") > 99}),
        w.unique_test(orders, "id", "unique"), w.relationship_test(orders, "customer", customers, "customer_id", "known"),
        w.rows_test(customers, 2, "two customers"),
    )
    assert rows(report) == [("known", 1, "FAIL"), ("positive", 2, "FAIL"), ("present", 1, "FAIL"), ("small", 0, "PASS"),
                            ("two customers", 0, "PASS"), ("unique", 1, "FAIL")]


def nodes(spark, data, project="p"):
    return spark.createDataFrame([(m, project, d) for m, d in data], "model string, project string, depends_on array<string>")


def test_closure_of_a_diamond_a_long_chain_and_a_cycle(spark):
    chain = [(f"n{i}", [f"n{i + 1}"]) for i in range(12)]
    edges = w.lineage_edges(nodes(spark, [("d", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("x", ["y"]), ("y", ["x"]), ("s", ["s"])] + chain))
    closure = {(r.model, r.related): r.depth for r in w.lineage_closure(edges).collect()}
    assert closure[("d", "a")] == 2 and closure[("d", "b")] == 1
    assert closure[("n0", "n12")] == 12
    assert closure[("x", "x")] == 2 and ("s", "s") not in closure
    below = w.lineage_closure(edges, spark.createDataFrame([("a",)], "model string"), "downstream")
    assert rows(below, "related", "depth") == [("b", 1), ("c", 1), ("d", 2)]


def test_edges_merge_external_events(spark):
    own = nodes(spark, [("b", ["a", "a"])])
    external = spark.createDataFrame([("b", "a"), ("a", "raw")], "model string, parent string")
    assert rows(w.lineage_edges(own, external)) == [("a", "raw"), ("b", "a")]


def test_cross_project_refs(spark):
    core, metrics = nodes(spark, [("a", []), ("b", ["a", "m"])], "core"), nodes(spark, [("m", ["a"])], "metrics")
    assert rows(w.cross_project_refs([core, metrics])) == [("b", "core", "m", "metrics"), ("m", "metrics", "a", "core")]


def test_layered_models_keep_orders_without_lines(spark):
    orders = spark.createDataFrame([(1, 1, "O", 10.0, ts("2024-01-05")), (2, 9, "O", 5.5, ts("2024-01-06"))],
                                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    customers = spark.createDataFrame([(1, "S")], "c_custkey bigint, c_mktsegment string")
    lines = spark.createDataFrame([(1, 4.0), (1, 6.0)], "l_orderkey bigint, l_extendedprice double")
    facts = w.layered_models(orders, customers, lines)
    assert rows(facts, "segment", "orders", "lines", "line_amount") == [("S", 1, 2, dec("10.00")), (None, 1, 0, dec("0.00"))]
