"""Table workflow: run history, layered models, data tests and model lineage."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meterstone.functions.time import Instant, seconds_between_marks, within
from meterstone.session import cut_lineage

RUN_COLUMNS = ["query_id", "object_name", "query_start_time", "query_end_time", "execution_status"]

# ---- run history ----------------------------------------------------------------------------------


def execution_history(history: DataFrame, object_name: str, n: int | None = None) -> DataFrame:
    """Runs of one object, newest first; only the newest ``n`` when given."""
    runs = history.where(F.col("object_name") == object_name).select(*RUN_COLUMNS)
    newest = runs.orderBy(F.col("query_end_time").desc_nulls_last(), F.col("query_id").desc())
    return newest if n is None else newest.limit(n)


def task_history(history: DataFrame, task: str, as_of: Instant, days: int = 7) -> DataFrame:
    runs = history.where((F.col("name") == task) & within("scheduled_time", as_of, days=days))
    return runs.orderBy(F.col("scheduled_time").desc_nulls_last(), F.col("query_id").desc())


def latest_run(history: DataFrame) -> DataFrame:
    """Newest finished run of every object; the higher id wins a tie. Runs without an end time do not compete.

    The newest end of each object is found first, as a plain maximum taken inside each task. Only the runs
    that end then are compared by id, so no object's runs are sorted or gathered.
    """
    newest = history.groupBy("object_name").agg(F.max("query_end_time").alias("query_end_time"))
    tied = history.join(newest, ["object_name", "query_end_time"], "left_semi")
    best = F.max(F.struct("query_end_time", "query_id", "query_start_time", "execution_status")).alias("r")
    return tied.groupBy("object_name").agg(best).select(
        "object_name", "r.query_id", "r.query_start_time", "r.query_end_time", "r.execution_status"
    )


def latest_logged_run(history: DataFrame, log_lines: DataFrame) -> DataFrame:
    """Log lines of the newest run of every object."""
    newest = latest_run(history).select("object_name", F.col("query_id").alias("run_id"))
    return log_lines.join(newest, ["object_name", "run_id"], "inner").select("object_name", "run_id", "line")


def run_summary(history: DataFrame) -> DataFrame:
    """Runs per object and status, last end and mean seconds of the finished ones."""
    seconds = seconds_between_marks(F.col("query_start_time"), F.col("query_end_time"))
    return history.groupBy("object_name", "execution_status").agg(
        F.count(F.lit(1)).alias("runs"), F.max("query_end_time").alias("last_end"),
        F.round(F.avg(seconds), 1).cast("decimal(18,1)").alias("avg_seconds"),
    )


# ---- layered models over orders ------------------------------------------------------------------------


def staged_orders(orders: DataFrame) -> DataFrame:
    """Staging: chosen columns with plain names and types."""
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.to_date("o_orderdate").alias("order_date"),
    )


def enriched_orders(staged: DataFrame, customers: DataFrame, lines: DataFrame) -> DataFrame:
    """Intermediate: each order with its customer segment and its line totals, summed before the join."""
    totals = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("line_amount")
    )
    segments = customers.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return staged.join(totals, "order_id", "left").join(segments, "customer_id", "left").select(
        *staged.columns, "segment", F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("line_amount", F.lit(0)).cast("decimal(28,2)").alias("line_amount"),
    )


def order_facts(enriched: DataFrame) -> DataFrame:
    """Mart: orders, lines and amounts per segment and month."""
    month = F.to_date(F.date_trunc("month", "order_date"))
    return enriched.groupBy("segment", month.alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("line_count").alias("lines"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("line_amount").cast("decimal(28,2)").alias("line_amount"),
    )


def layered_models(orders: DataFrame, customers: DataFrame, lines: DataFrame) -> DataFrame:
    return order_facts(enriched_orders(staged_orders(orders), customers, lines))


# ---- data tests -----------------------------------------------------------------------------------------


def assert_positive_amounts(df: DataFrame, amount: str) -> DataFrame:
    """Failing rows: amount zero or below. No rows means the test passes."""
    return df.where(F.col(amount) <= 0)


def column_tests(df: DataFrame, failures: Mapping[str, Column]) -> DataFrame:
    """Failing rows of several row tests, counted in one pass over the table."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in failures.items()])
    return counts.unpivot([], list(failures), "test_name", "failures")


def unique_test(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number of key values that occur more than once."""
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("test_name"), "failures")


def relationship_test(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows whose key has no parent; keys are counted before the join, so a hot key is one row in it."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = counted.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(F.lit(name).alias("test_name"), "failures")


def rows_test(df: DataFrame, expected: int, name: str) -> DataFrame:
    """Distance of a row count from the expected one."""
    off = F.abs(F.count(F.lit(1)) - expected)
    return df.agg(off.alias("failures")).select(F.lit(name).alias("test_name"), "failures")


def test_report(*results: DataFrame) -> DataFrame:
    """One row per test with its failures and PASS or FAIL."""
    report = results[0]
    for result in results[1:]:
        report = report.unionByName(result)
    return report.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def observed_tests(df: DataFrame, failures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows with a counter of the failing rows of each test, filled by whatever job writes them."""
    counter = Observation("tests")
    counts = [F.count_if(test).alias(name) for name, test in failures.items()]
    return df.observe(counter, *counts), counter


def observed_report(spark: SparkSession, counter: Observation) -> DataFrame:
    """Test report of rows that have been written; the table is not read again."""
    return test_report(spark.createDataFrame(list(counter.get.items()), "test_name string, failures bigint"))


# ---- lineage ---------------------------------------------------------------------------------------------


def artifact_nodes(manifests: DataFrame) -> DataFrame:
    """Model rows of run manifests, whose ``nodes`` map a model name to what it depends on."""
    nodes = manifests.select(F.explode("nodes").alias("model", "node"))
    return nodes.select("model", F.col("node.project").alias("project"), F.col("node.depends_on.nodes").alias("depends_on"))


def lineage_edges(nodes: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Distinct (model, parent) pairs; events of external lineage are added to those of the models."""
    edges = nodes.select("model", F.explode("depends_on").alias("parent"))
    if external is not None:
        edges = edges.unionByName(external.select("model", "parent"))
    return edges.where(F.col("model") != F.col("parent")).distinct()


def cross_project_refs(projects: list[DataFrame]) -> DataFrame:
    """Edges between models of different projects, over the models of all projects together."""
    nodes = projects[0]
    for project in projects[1:]:
        nodes = nodes.unionByName(project)
    homes = nodes.select(F.col("model").alias("parent"), F.col("project").alias("parent_project"))
    used = nodes.select("model", "project", F.explode("depends_on").alias("parent"))
    return used.join(homes, "parent", "inner").where(F.col("project") != F.col("parent_project")).select(
        "model", "project", "parent", "parent_project"
    ).distinct()


def lineage_closure(edges: DataFrame, start: DataFrame | None = None, direction: str = "upstream", steps_at_once: int = 4) -> DataFrame:
    """Every model reachable from each start model, with the least number of steps.

    Each round walks ``steps_at_once`` steps on from the pairs first reached at the end of the last one, as one job, and keeps what no
    earlier round has reached, until a round ends with nothing new; there is no depth limit and a cycle ends by itself. Only
    the new pairs are checkpointed, once per round, so the plan stays short and outlives lost executors. Without ``start`` all
    pairs are listed, and kept as bits until then; ``reaches`` answers for given pairs without that.
    """
    near, far = ("model", "parent") if direction == "upstream" else ("parent", "model")
    steps = _moved(cut_lineage(edges.select(F.col(near).alias("_at"), F.col(far).alias("_next")).distinct()))
    if start is None:
        return _all_pairs(steps, steps_at_once)
    last = start.select("model").distinct().select("model", F.col("model").alias("related"))
    reached, depth = None, 0
    while True:
        found = None
        for _ in range(steps_at_once):
            depth += 1
            last = last.withColumnRenamed("related", "_at").join(steps, "_at").select("model", F.col("_next").alias("related")).distinct()
            level = last.withColumn("depth", F.lit(depth))
            found = level if found is None else found.unionByName(level)
        new = found.groupBy("model", "related").agg(F.min("depth").alias("depth"))
        new = cut_lineage(new if reached is None else new.join(reached.hint("merge"), ["model", "related"], "left_anti"))
        reached = new if reached is None else reached.unionByName(new)
        last = new.where(F.col("depth") == depth).select("model", "related")
        if last.isEmpty():
            return reached


def _all_pairs(steps: DataFrame, steps_at_once: int) -> DataFrame:
    """(model, related, depth) of all pairs along ``steps`` (_at, _next).

    Models are numbered as in ``reaches``, and a node has a row for each 64 numbers of which a model reaches it, with a word of bits for
    each step of the round that first did. So what is joined, shuffled and kept is far less than the pairs where neighbours walk the
    same way, and a row a pair at worst. The names come last: each word meets the list of its 64 models and the pairs leave that task.
    """
    numbered = cut_lineage(_numbered(steps.select(F.col("_at").alias("model")).where("model is not null").distinct(), steps))
    word, one = F.shiftright("number", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("number").bitwiseAND(63).cast("int"))
    last, none = numbered.select(F.col("model").alias("node"), word, one.alias("bits")), F.lit(0).cast("bigint")
    names, either = [f"step{k}" for k in range(steps_at_once)], lambda columns: reduce(lambda a, b: a.bitwiseOR(b), map(F.col, columns))
    rounds, held, depth = [], None, 0
    while True:
        found = None
        for name in names:
            walked = last.join(steps, F.col("node") == F.col("_at")).select(F.col("_next").alias("node"), "word", "bits")
            last = walked.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
            level = last.select("node", "word", none.alias("old"), *[(F.col("bits") if n == name else none).alias(n) for n in names])
            found = level if found is None else found.unionByName(level)
        if held is not None:
            found = found.unionByName(held.select("node", "word", F.col("bits").alias("old"), *[none.alias(n) for n in names]))
        seen = found.groupBy("node", "word").agg(*[F.bit_or(c).alias(c) for c in ("old", *names)])
        fresh = [F.col(n).bitwiseAND(F.bitwise_not(either(["old", *names[:k]]))).alias(n) for k, n in enumerate(names)]
        new = cut_lineage(seen.select("node", "word", *fresh).where(either(names) != 0))
        steps_of = F.array(*[F.struct(F.lit(depth + k + 1).alias("depth"), F.col(n).alias("bits")) for k, n in enumerate(names)])
        rounds.append(new.select("node", "word", F.explode(steps_of).alias("at")).where("at.bits <> 0").select("node", "word", "at.depth", "at.bits"))
        depth += steps_at_once
        bits = new.select("node", "word", either(names).alias("bits"))
        held = bits if held is None else held.unionByName(bits)
        last = new.where(F.col(names[-1]) != 0).select("node", "word", F.col(names[-1]).alias("bits"))
        if last.isEmpty():
            break
    models = numbered.groupBy(word).agg(F.collect_list(F.struct(one.alias("bit"), "model")).alias("models"))
    mine = F.filter("models", lambda m: m["bit"].bitwiseAND(F.col("bits")) != 0)
    listed = reduce(DataFrame.unionByName, rounds).join(models.hint("merge"), "word")
    return listed.select("node", "depth", F.explode(mine).alias("m")).select("m.model", F.col("node").alias("related"), "depth")


def _moved(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows to join: more than ``most`` are sorted and merged. Names compress so well that a table below the broadcast threshold on disk
    may be a hundred times that on the driver and in every task."""
    return rows.hint("merge") if rows.count() > most else rows


def reaches(edges: DataFrame, pairs: DataFrame, steps_at_once: int = 4) -> DataFrame:
    """(model, related, reachable) for given ``pairs``: whether one walks from ``model`` to ``related`` along parents.

    The models asked about are numbered, those with common forebears side by side. A node has a row for each 64 numbers of which
    a model reaches it, as the bits of one word, so what is kept grows with the models that do, and is less where neighbours
    walk the same way. Each round walks ``steps_at_once`` steps on from the bits first set at the end of the last one, and keeps
    only new bits; it ends when there are none, so cycles do no harm. A model does not reach itself unless a cycle leads back.
    """
    asked = cut_lineage(pairs.select("model", "related").distinct())
    steps = _moved(cut_lineage(edges.select(F.col("model").alias("_at"), F.col("parent").alias("_next")).distinct()))
    numbered = cut_lineage(_numbered(asked.select("model").distinct(), steps))
    word, position = F.shiftright("number", 6).alias("word"), F.col("number").bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), position)
    last = numbered.select(F.col("model").alias("node"), word, one.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    held, none = None, F.lit(0).cast("bigint")
    while True:
        found = None
        for step in range(steps_at_once):
            walked = last.join(steps, F.col("node") == F.col("_at")).select(F.col("_next").alias("node"), "word", "bits")
            last = walked.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
            end = step == steps_at_once - 1
            level = last.select("node", "word", (none if end else F.col("bits")).alias("early"), (F.col("bits") if end else none).alias("late"), none.alias("old"))
            found = level if found is None else found.unionByName(level)
        if held is not None:
            found = found.unionByName(held.select("node", "word", none.alias("early"), none.alias("late"), F.col("bits").alias("old")))
        seen = found.groupBy("node", "word").agg(*[F.bit_or(c).alias(c) for c in ("early", "late", "old")])
        fresh = lambda c: F.col(c).bitwiseAND(F.bitwise_not("old"))
        new = seen.select("node", "word", fresh("early").alias("early"), fresh("late").alias("late")).where("early <> 0 OR late <> 0")
        new = cut_lineage(new.select("node", "word", F.col("early").bitwiseOR(F.col("late")).alias("bits"), F.col("late").bitwiseAND(F.bitwise_not("early")).alias("on")))
        held = new.drop("on") if held is None else held.unionByName(new.drop("on"))
        last = new.where("on <> 0").select("node", "word", F.col("on").alias("bits"))
        if last.isEmpty():
            break
    named = asked.join(numbered.hint("merge"), "model").select("model", F.col("related").alias("node"), word, one.alias("bit"))
    whole = held.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    answered = named.join(whole.hint("merge"), ["node", "word"], "left")
    there = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return answered.select("model", F.col("node").alias("related"), there.alias("reachable"))


def _numbered(names: DataFrame, steps: DataFrame) -> DataFrame:
    """Different numbers for many names, with gaps; names that share a forebear one, two, four or eight steps up are neighbours.

    Of several parents the smallest counts. The order has no part in any answer, only in how many words the bits fill.
    """
    up = _moved(cut_lineage(steps.groupBy(F.col("_at").alias("model")).agg(F.min("_next").alias("up1"))))
    for near, far in ((1, 2), (2, 4), (4, 8)):
        over = up.select(F.col("model").alias(f"up{near}"), F.col(f"up{near}").alias(f"up{far}"))
        up = _moved(cut_lineage(up.join(over, f"up{near}", "left")))
    placed = names.join(up, "model", "left").orderBy("up8", "up4", "up2", "up1", "model")
    return placed.select("model", F.monotonically_increasing_id().alias("number"))
