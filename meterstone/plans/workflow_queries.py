"""Snapshot, model, data test, lineage and file queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from meterstone.operators import snapshots as s
from meterstone.operators import workflow as w
from meterstone.plans.registry import query
from meterstone.session import work_folder
from meterstone.sources import files, sinks, snapshot_store
from meterstone.streaming.tables import run_to_end

AS_OF = dt.date(2001, 9, 1)
NOW = "TIMESTAMP '2001-09-01'"

JOINED = """o AS (SELECT * FROM snapshot_history WHERE valid_to IS NULL),
j AS (SELECT o.order_id AS ok, o.status AS os, o.updated_at AS ou, o.valid_from AS ofr, c.order_id AS ck, c.status AS cs, c.updated_at AS cu
FROM o FULL JOIN snapshot_source c ON o.order_id = c.order_id)"""


def versions(changed: str, at: str, missing: str) -> str:
    return f"""WITH {JOINED} SELECT * FROM snapshot_history WHERE valid_to IS NOT NULL
UNION ALL SELECT ok, os, ou, ofr, CASE WHEN ck IS NULL THEN {missing} WHEN {changed} THEN {at} END FROM j WHERE ok IS NOT NULL
UNION ALL SELECT ck, cs, cu, {at}, NULL FROM j WHERE ck IS NOT NULL AND (ok IS NULL OR {changed})"""


@query("T01 J10", versions("cu > ou", "cu", "NULL"))
def snapshot_timestamp(v):
    return s.snapshot_timestamp(v.snapshot_source, v.snapshot_history, "order_id", "updated_at", AS_OF)


@query("T01 T03 J10", versions("cu > ou", "cu", NOW))
def snapshot_timestamp_with_deletes(v):
    return s.snapshot_timestamp(v.snapshot_source, v.snapshot_history, "order_id", "updated_at", AS_OF, hard_deletes=True)


@query("T02 J10", versions("cs IS DISTINCT FROM os", NOW, "NULL"))
def snapshot_check(v):
    return s.snapshot_check(v.snapshot_source, v.snapshot_history, "order_id", ["status"], AS_OF)


@query("T02 T03", versions("(cs IS DISTINCT FROM os OR cu IS DISTINCT FROM ou)", NOW, NOW))
def snapshot_check_all(v):
    return s.snapshot_check(v.snapshot_source, v.snapshot_history, "order_id", "all", AS_OF, hard_deletes=True)


@query("T03", f"""SELECT h.order_id, h.status, h.updated_at, h.valid_from,
CASE WHEN h.valid_to IS NULL AND c.order_id IS NULL THEN {NOW} ELSE h.valid_to END AS valid_to
FROM snapshot_history h LEFT JOIN snapshot_source c ON h.order_id = c.order_id""")
def hard_deletes(v):
    return s.hard_deletes(v.snapshot_source, v.snapshot_history, "order_id", AS_OF)


def stored_history(v, step):
    """The history after a snapshot step on its stored form, of which only the parts that change are written."""
    folder = work_folder(v.spark, "history")
    snapshot_store.save_history(v.snapshot_history, folder)
    for _ in range(2):  # the second run finds nothing to change
        snapshot_store.advance(v.spark, folder, step)
    return snapshot_store.read_history(v.spark, folder)


@query("T01 J10", versions("cu > ou", "cu", "NULL"))
def stored_snapshot_timestamp(v):
    return stored_history(v, lambda held: s.snapshot_timestamp(v.snapshot_source, held, "order_id", "updated_at", AS_OF))


@query("T02 T03 J10", versions("cs IS DISTINCT FROM os", NOW, NOW))
def stored_snapshot_check(v):
    return stored_history(v, lambda held: s.snapshot_check(v.snapshot_source, held, "order_id", ["status"], AS_OF, hard_deletes=True))


@query("T03", f"""SELECT h.order_id, h.status, h.updated_at, h.valid_from,
CASE WHEN h.valid_to IS NULL AND c.order_id IS NULL THEN {NOW} ELSE h.valid_to END AS valid_to
FROM snapshot_history h LEFT JOIN snapshot_source c ON h.order_id = c.order_id""")
def stored_hard_deletes(v):
    return stored_history(v, lambda held: s.hard_deletes(v.snapshot_source, held, "order_id", AS_OF))


@query("W03", """SELECT *, updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY order_id ORDER BY updated_at) AS valid_to FROM order_changes""")
def validity_from_history(v):
    return s.validity_from_history(v.order_changes, "order_id", "updated_at")


@query("S13 F01 O02", "SELECT * FROM execution_history WHERE object_name = 'P1'")
def execution_history(v):
    return w.execution_history(v.execution_history, "P1")


@query("S13 O04", "SELECT * FROM execution_history WHERE object_name = 'P1' ORDER BY query_end_time DESC NULLS LAST, query_id DESC LIMIT 10")
def execution_history_top(v):
    return w.execution_history(v.execution_history, "P1", 10)


@query("S14 F01 P07", "SELECT * FROM task_runs WHERE name = 'TASK2' AND scheduled_time >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY")
def task_history(v):
    return w.task_history(v.task_runs, "TASK2", dt.date(2001, 8, 1))


LATEST = """(SELECT object_name, query_id, query_start_time, query_end_time, execution_status FROM (SELECT *, row_number() OVER (
PARTITION BY object_name ORDER BY query_end_time DESC, query_id DESC) AS n FROM execution_history WHERE query_end_time IS NOT NULL) WHERE n = 1)"""


@query("W01 O05 J08", f"SELECT * FROM {LATEST}")
def latest_run(v):
    return w.latest_run(v.execution_history)


@query("T08", """SELECT object_name, execution_status, count(*) AS runs, max(query_end_time) AS last_end,
CAST(round(avg(date_diff('second', query_start_time, query_end_time)), 1) AS DECIMAL(18,1)) AS avg_seconds FROM execution_history GROUP BY 1, 2""")
def run_summary(v):
    return w.run_summary(v.execution_history)


def written_log(v) -> str:
    """Log text of every run, two lines each, written and then read back as a log folder."""
    folder = work_folder(v.spark, "run-log")
    lines = F.explode(F.array(F.lit("started"), F.concat(F.lit("finished "), "execution_status"))).alias("line")
    log = v.execution_history.select("object_name", F.col("query_id").cast("string").alias("run"), lines)
    log.select("object_name", F.concat_ws("\t", "run", "line").alias("value")).write.partitionBy("object_name").text(folder)
    return folder


@query("S16", """SELECT object_name, query_id AS run_id, line FROM execution_history,
LATERAL (SELECT unnest(['started', 'finished ' || execution_status]) AS line)""")
def run_log_lines(v):
    return files.read_run_log(v.spark, written_log(v))


@query("O07 O05 S16", f"""SELECT object_name, query_id AS run_id, line FROM {LATEST} r,
LATERAL (SELECT unnest(['started', 'finished ' || execution_status]) AS line)""")
def latest_logged_run(v):
    return w.latest_logged_run(v.execution_history, files.read_run_log(v.spark, written_log(v)))


def written_artifacts(v) -> str:
    """A manifest document per model, next to files of another name that a reader must skip."""
    folder = work_folder(v.spark, "artifacts")
    node = F.struct("project", F.struct(F.col("depends_on").alias("nodes")).alias("depends_on"))
    v.model_nodes.select(F.lit("run1").alias("run_id"), F.create_map("model", node).alias("nodes")).write.json(folder + "/run1")
    v.model_nodes.select("model").write.csv(folder + "/other")
    return folder


@query("S15", "SELECT model, project, array_to_string(depends_on, ',') AS depends_on FROM model_nodes")
def read_artifacts(v):
    manifests = files.read_artifacts(v.spark, written_artifacts(v), "*.json", files.MANIFEST_SCHEMA, one_document_per_file=False)
    return w.artifact_nodes(manifests).withColumn("depends_on", F.array_join("depends_on", ","))


def written_documents(v) -> str:
    """Both artifacts of a run for each project, each file one document with fields a reader does not know, and a file of another name."""
    folder = work_folder(v.spark, "documents")
    node = F.struct("project", F.struct(F.col("depends_on").alias("nodes"), F.lit("x").alias("extra")).alias("depends_on"), F.lit(1).alias("unknown"))
    result = F.struct(F.col("model").alias("unique_id"), F.when(F.col("n") % 7 == 0, "error").otherwise("success").alias("status"), (F.col("n") % 50 / 4.0).alias("execution_time"))
    numbered = v.model_nodes.withColumn("n", F.substring("model", 2, 20).cast("bigint"))
    run = F.concat_ws("-", "project", F.floor(F.col("n") / 500))  # a document holds a bounded number of models
    documents = numbered.withColumn("run_id", run).groupBy("run_id").agg(
        F.to_json(F.struct("run_id", F.lit("v9").alias("schema"), F.map_from_entries(F.collect_list(F.struct("model", node))).alias("nodes"))).alias("manifest"),
        F.to_json(F.struct("run_id", F.collect_list(result).alias("results"))).alias("run_results"))
    both = documents.unpivot("run_id", ["manifest", "run_results"], "name", "value")
    files.write_documents(both.select(F.col("run_id").alias("folder"), F.concat("name", F.lit(".json")).alias("name"), "value"), folder)
    v.model_nodes.limit(1).select("model").write.csv(folder + "/other")
    return folder


@query("S15", """SELECT project || '-' || (CAST(substr(model, 2) AS BIGINT) // 500) AS run_id, model, project, array_to_string(depends_on, ',') AS depends_on,
CASE WHEN CAST(substr(model, 2) AS BIGINT) % 7 = 0 THEN 'error' ELSE 'success' END AS status,
CAST(CAST(substr(model, 2) AS BIGINT) % 50 / 4.0 AS DOUBLE) AS execution_seconds, 1 AS unknown FROM model_nodes""")
def artifact_documents(v):
    """Both named files as a stream of whole documents."""
    found = run_to_end(files.artifact_documents(v.spark, written_documents(v), stream=True).withColumn("document", F.to_json("document")), work_folder(v.spark, "taken"))
    documents = found.withColumn("document", F.parse_json("document"))
    nodes = files.document_nodes(documents).select("run_id", "model", "project", F.array_join("depends_on", ",").alias("depends_on"),
                                                  F.try_variant_get("node", "$.unknown", "int").alias("unknown"))
    return nodes.join(files.document_results(documents).drop("result"), ["run_id", "model"])


@query("S17", "SELECT n_nationkey AS code, n_name AS name, c_custkey AS customer_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def load_seed(v):
    """Country codes kept as CSV, used as a lookup for every customer."""
    folder = work_folder(v.spark, "seed")
    v.table("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")).write.option("header", True).csv(folder)
    seed = files.load_seed(v.spark, folder, "code int, name string")
    customers = v.table("customer").select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("customer_id"))
    return customers.join(seed, "code")


FACTS = """SELECT segment, CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS orders, CAST(sum(line_count) AS BIGINT) AS lines,
CAST(sum(amount) AS DECIMAL(28,2)) AS amount, CAST(sum(line_amount) AS DECIMAL(28,2)) AS line_amount FROM (
  SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, c_mktsegment AS segment,
    coalesce(line_count, 0) AS line_count, coalesce(line_amount, 0) AS line_amount
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS line_count,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_amount FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1, 2"""


@query("T04", FACTS)
def layered_models(v):
    return w.layered_models(v.table("orders"), v.table("customer"), v.table("lineitem"))


@query("K03 T04", FACTS)
def materialised_models(v):
    folder = work_folder(v.spark, "models")
    staged = sinks.materialise(w.staged_orders(v.table("orders")), "orders", "staging")
    enriched = sinks.materialise(w.enriched_orders(staged, v.table("customer"), v.table("lineitem")), "orders_enriched", "intermediate")
    return sinks.materialise(w.order_facts(enriched), "order_facts", "marts", folder)


@query("T05 T06 K03", """WITH f AS (SELECT count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount, max(o_orderdate) AS last_order
FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate))
SELECT *, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'has_orders' AS test_name, count(*) FILTER (orders <= 0) AS failures FROM f
UNION ALL SELECT 'small_month', count(*) FILTER (amount > 400000) FROM f UNION ALL SELECT 'order_known', count(*) FILTER (last_order IS NULL) FROM f)""")
def built_model_tests(v):
    """A mart is stored and its rows are tested by the write itself."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    facts = v.table("orders").groupBy("o_custkey", month.alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), F.max("o_orderdate").alias("last_order"))
    tests = {"has_orders": F.col("orders") <= 0, "small_month": F.col("amount") > 400000, "order_known": F.col("last_order").isNull()}
    return sinks.materialise_tested(facts, "customer_months", "marts", work_folder(v.spark, "tested"), tests)[1]


@query("T05", "SELECT o_orderkey, o_totalprice - 20000 AS net FROM orders WHERE o_totalprice - 20000 <= 0")
def assert_positive_amounts(v):
    net = v.table("orders").select("o_orderkey", (F.col("o_totalprice") - 20000).alias("net"))
    return w.assert_positive_amounts(net, "net")


@query("T06 T05", """SELECT *, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT 'positive_price' AS test_name, count(*) FILTER (l_extendedprice <= 0) AS failures FROM lineitem
UNION ALL SELECT 'discount_below_tenth', count(*) FILTER (l_discount >= 0.1) FROM lineitem
UNION ALL SELECT 'line_order_present', count(*) FILTER (l_orderkey IS NULL) FROM lineitem
UNION ALL SELECT 'order_unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'order_customer_known', count(*) FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'five_regions', abs(count(*) - 5) FROM region)""")
def test_report(v):
    lines, orders = v.table("lineitem"), v.table("orders")
    return w.test_report(
        w.column_tests(lines, {
            "positive_price": F.col("l_extendedprice") <= 0, "discount_below_tenth": F.col("l_discount") >= 0.1,
            "line_order_present": F.col("l_orderkey").isNull(),
        }),
        w.unique_test(orders, "o_orderkey", "order_unique"),
        w.relationship_test(orders, "o_custkey", v.users, "user_id", "order_customer_known"),
        w.rows_test(v.table("region"), 5, "five_regions"),
    )


EDGES = """edges AS (SELECT DISTINCT model, parent FROM (SELECT model, unnest(depends_on) AS parent FROM model_nodes
UNION ALL SELECT model, parent FROM external_edges) WHERE model <> parent)"""


@query("T07", f"WITH {EDGES} SELECT * FROM edges")
def lineage_edges(v):
    return w.lineage_edges(v.model_nodes, v.external_edges)


@query("T07", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT model, parent AS related, 1 AS depth FROM edges
UNION SELECT w.model, e.parent, w.depth + 1 FROM walk w JOIN edges e ON w.related = e.model)
SELECT model, related, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def lineage_closure(v):
    return w.lineage_closure(w.lineage_edges(v.model_nodes, v.external_edges))


@query("T07", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT parent AS model, model AS related, 1 AS depth FROM edges WHERE parent = 'm5'
UNION SELECT w.model, e.model, w.depth + 1 FROM walk w JOIN edges e ON w.related = e.parent)
SELECT model, related, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def lineage_downstream(v):
    start = v.model_nodes.where(F.col("model") == "m5").select("model")
    return w.lineage_closure(w.lineage_edges(v.model_nodes, v.external_edges), start, "downstream")


ASKED = """asked AS (SELECT DISTINCT 'm' || p_partkey AS model, 'm' || (p_partkey // (2 + p_partkey % 9)) AS related FROM part WHERE p_partkey > 0
UNION SELECT 'm' || p_partkey, 'src' || (p_partkey % 9) FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0)"""


@query("T07", f"""WITH RECURSIVE {EDGES}, {ASKED}, walk AS (SELECT model, parent AS related FROM edges UNION SELECT w.model, e.parent FROM walk w JOIN edges e ON w.related = e.model)
SELECT model, related, EXISTS (SELECT 1 FROM walk w WHERE w.model = a.model AND w.related = a.related) AS reachable FROM asked a""")
def lineage_reaches(v):
    """Whether given models are built on given others, without a list of all pairs."""
    key = F.col("p_partkey")
    parts = v.table("part").where(key > 0).select(key, F.concat(F.lit("m"), key).alias("model"))
    pairs = parts.select("model", F.concat(F.lit("m"), F.floor(key / (2 + key % 9))).alias("related")).union(
        parts.where(key % 3 == 0).select("model", F.concat(F.lit("src"), key % 9)))
    return w.reaches(w.lineage_edges(v.model_nodes, v.external_edges), pairs)


@query("T09", """SELECT DISTINCT n.model, n.project, p.model AS parent, p.project AS parent_project
FROM (SELECT model, project, unnest(depends_on) AS parent FROM model_nodes) n JOIN model_nodes p ON n.parent = p.model WHERE n.project <> p.project""")
def cross_project_refs(v):
    return w.cross_project_refs([v.model_nodes.where(F.col("project") == f"proj{i}") for i in range(3)])
