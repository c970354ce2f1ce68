"""Connected components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): ``root`` is the smallest id reachable.

    Each round every id takes the smallest label of its neighbours, then the label of that label, so labels travel twice
    as far each time. Sums of a hub's edges are combined inside the tasks first. Labels are written after each round, and
    rounds end when none changed.
    """
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select(
        "id", F.least("id", "low").alias("root"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        lowest = both.join(labels.select(F.col("id").alias("a"), "root"), "a").groupBy(F.col("b").alias("id")).agg(F.min("root").alias("low"))
        met = labels.select("id", F.col("root").alias("old")).join(lowest, "id").select("id", "old", F.least("old", "low").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        newer = stored(met.join(jump, "root").select("id", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("old")).alias("changed")), "labels")
        drop_stored(labels)
        labels = newer
    return labels.select("id", "root")


def open_groups(marked: DataFrame, key: str, part_rows: int, task_rows: int) -> DataFrame:
    """(key, rows, low, tasks) of the groups of ``marked`` (key, comp) with several components. ``low`` is the smallest one.

    Groups with the same ``low`` hold much the same rows. They are meant for the same ``tasks`` tasks, of about ``task_rows``
    rows each when groups are cut into a grid of parts of ``part_rows``.
    """
    open_ = stored(marked.groupBy(key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low != high").drop("high"), "open")
    work = F.col("rows") * F.ceil(F.col("rows") / part_rows)
    return open_.join(open_.groupBy("low").agg(F.ceil(F.sum(work) / task_rows).alias("tasks")), "low").select(key, "rows", "low", "tasks")
