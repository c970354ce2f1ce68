"""Writers that touch only what changes, sketch tables, lineage questions, and artifacts as documents."""

import datetime as dt
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterstone.operators import limits, sketches, snapshots, workflow
from meterstone.operators.governance import findings_totals
from meterstone.sources import buckets, files, sinks, snapshot_store
from tests.conftest import dec, plan_of, rows, ts

VERSIONS = "id bigint, status string, updated_at timestamp, valid_from timestamp, valid_to timestamp"
SOURCE = "id bigint, status string, updated_at timestamp"


def stamps(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("part-*.parquet")}


def folders(names):
    return {n.split("/")[0] for n in names}


# Snapshots in parts


@pytest.fixture
def history(spark, tmp_path):
    closed = [(k, "old", ts(f"2024-0{m}-01"), ts(f"2024-0{m}-01"), ts(f"2024-0{m}-15")) for m in (1, 2, 3) for k in range(5)]
    held = [(k, "new", ts("2024-04-01"), ts("2024-04-01"), None) for k in range(5)]
    df = spark.createDataFrame(closed + held, VERSIONS)
    snapshot_store.save_history(df, str(tmp_path / "h"))
    return df, tmp_path / "h"


def test_a_snapshot_run_leaves_other_months_alone(spark, history):
    df, path = history
    before = stamps(path)
    current = spark.createDataFrame([(0, "new", ts("2024-04-01")), (1, "later", ts("2024-02-20")), (2, "later", ts("2024-05-05")), (9, "first", ts("2024-05-01"))], SOURCE)
    step = lambda held: snapshots.snapshot_timestamp(current, held, "id", "updated_at", dt.date(2024, 6, 1), hard_deletes=True)
    assert snapshot_store.advance(spark, str(path), step) == ["2024-05", "2024-06"]
    after = stamps(path)
    kept = {n for n, t in after.items() if before.get(n) == t}
    assert folders(kept) == {"ended=2024-01", "ended=2024-02", "ended=2024-03"} and folders(after) == folders(kept) | {"ended=open", "ended=2024-05", "ended=2024-06"}
    whole = snapshots.snapshot_timestamp(current, df, "id", "updated_at", dt.date(2024, 6, 1), hard_deletes=True)
    assert rows(snapshot_store.read_history(spark, str(path))) == rows(whole)
    # Once more, nothing changes and nothing is written.
    assert snapshot_store.advance(spark, str(path), step) == [] and stamps(path) == after


def test_a_month_that_is_written_again_keeps_its_older_versions(spark, history):
    df, path = history
    current = spark.createDataFrame([(k, "x", ts("2024-04-01")) for k in range(5)], SOURCE)
    check = lambda held: snapshots.snapshot_check(current, held, "id", ["status"], dt.date(2024, 3, 20))
    assert snapshot_store.advance(spark, str(path), check) == ["2024-03"]
    assert rows(snapshot_store.read_history(spark, str(path))) == rows(check(df))


def test_a_history_without_open_versions(spark, history):
    _, path = history
    nobody = spark.createDataFrame([], SOURCE)
    snapshot_store.advance(spark, str(path), lambda held: snapshots.hard_deletes(nobody, held, "id", dt.date(2024, 6, 1)))
    assert snapshot_store.read_history(spark, str(path)).where("valid_to IS NULL").count() == 0
    assert snapshot_store.read_history(spark, str(path)).count() == 20
    assert snapshot_store.advance(spark, str(path), lambda held: held) == []


def test_a_run_reads_the_open_folder_only(spark, history):
    _, path = history
    held = snapshot_store.read_history(spark, str(path), [snapshot_store.OPEN])
    filters = plan_of(held).split("PartitionFilters: [")[1].split("]")[0]
    assert "ended#" in filters and "open" in filters
    assert {r[0].split("/")[-2] for r in held.select(F.input_file_name()).distinct().collect()} == {"ended=open"}


# Buckets


ACCESS = "user_name string, user_id bigint, granted_at timestamp, monthly_credit_limit decimal(38,6), is_active boolean, revoked_at timestamp, revocation_reason string"
GRANTS = "user_name string, monthly_credit_limit decimal(38,6), requested_at timestamp"


def test_a_grant_writes_its_bucket_only_and_moves_no_table(spark, tmp_path):
    access = spark.createDataFrame([(f"u{i}", i, ts("2024-01-01"), dec(10), False, ts("2024-01-02"), "x") for i in range(200)], ACCESS)
    users = spark.createDataFrame([(i, f"u{i}") for i in range(205)], "user_id bigint, name string")
    grants = spark.createDataFrame([("u7", dec(5), ts("2024-01-05"))], GRANTS)
    buckets.save_buckets(access, "granted_access", 8, path=str(tmp_path / "t"))
    assert buckets.bucket_count(spark, "granted_access") == 8
    before, want = stamps(tmp_path / "t"), rows(limits.grant_upsert(access, grants, users, dt.date(2024, 2, 1)))
    numbers = buckets.touched(grants, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(buckets.merged("granted_access", grants, users, dt.date(2024, 2, 1), numbers))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Formatted plans list each operator once: the table's scan feeds the join through a sort, not an exchange.
    tree = plan.split("\n\n\n")[0]
    table = [line for line in tree.splitlines() if "granted_access" in line][0]
    above = tree.splitlines()[:tree.splitlines().index(table)]
    depth = len(table) - len(table.lstrip(" :+-"))
    path = []
    for line in reversed(above):
        level = len(line) - len(line.lstrip(" :+-"))
        if level < depth:
            path.append(line.strip(" :+-"))
            depth = level
    upto = next(i for i, line in enumerate(path) if line.startswith("SortMergeJoin"))
    assert not any("Exchange" in line for line in path[:upto])
    assert buckets.grant("granted_access", grants, users, dt.date(2024, 2, 1)) == numbers and len(numbers) == 1
    after = stamps(tmp_path / "t")
    assert folders({n for n, t in after.items() if before.get(n) == t}) == {f"bucket={b}" for b in range(8) if b not in numbers}
    assert rows(buckets.read_buckets(spark, "granted_access")) == want
    # A new name, and an empty batch.
    more = spark.createDataFrame([("u204", None, ts("2024-01-05"))], GRANTS)
    buckets.grant("granted_access", more, users, dt.date(2024, 2, 1))
    assert buckets.grant("granted_access", more.limit(0), users, dt.date(2024, 2, 1)) == []
    assert rows(buckets.read_buckets(spark, "granted_access").where("user_name = 'u204'"), "user_id", "is_active") == [(204, True)]
    spark.range(3).write.saveAsTable("no_buckets", path=str(tmp_path / "n"))
    with pytest.raises(ValueError):
        buckets.bucket_count(spark, "no_buckets")


# Order along a curve


def test_row_groups_along_a_curve_hold_few_users(spark, tmp_path):
    rng = random.Random(4)
    data = [(ts("2024-01-01") + dt.timedelta(hours=rng.randrange(24)), rng.randrange(4000), f"m{rng.randrange(8)}", dec(1)) for _ in range(40_000)]
    df = spark.createDataFrame(data, "start_time timestamp, user_id bigint, model_name string, credits decimal(38,6)").repartition(4)
    sinks.write_z_ordered_usage(df, str(tmp_path / "z"), row_group_bytes=16 << 10)
    sinks.write_usage_table(df, str(tmp_path / "t"))

    def read_share(folder, user, column="user_id"):
        groups = []
        for file in folder.rglob("part-*.parquet"):
            meta = pq.ParquetFile(file).metadata
            at = meta.schema.names.index(column)
            groups += [(meta.row_group(g).column(at).statistics, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        return sum(n for s, n in groups if s.min <= user <= s.max) / sum(n for _, n in groups)

    users = (3, 1000, 2222, 3999)
    assert max(read_share(tmp_path / "z", u) for u in users) < 0.45 and min(read_share(tmp_path / "t", u) for u in users) > 0.8
    assert read_share(tmp_path / "z", "m3", "model_name") < 0.7
    assert rows(spark.read.parquet(str(tmp_path / "z")).drop("usage_date")) == rows(df)


def test_curve_places_keep_the_order_of_each_column(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(4) for b in range(4)], "a double, b double")
    got = {(r.a, r.b): r.z for r in df.withColumn("z", sinks.z_value({"a": [0.0, 1.0, 2.0], "b": [0.0, 1.0, 2.0]}, 2)).collect()}
    assert len(set(got.values())) == 16 and got[0, 0] == 0 and got[3, 3] == 15 and got[1, 1] == 3 and got[2, 0] == 4


def test_nothing_can_be_ordered_along_a_curve(spark, tmp_path):
    kind = "start_time timestamp, user_id bigint, model_name string"
    sinks.write_z_ordered_usage(spark.createDataFrame([], kind), str(tmp_path / "e"))
    sinks.write_z_ordered_usage(spark.createDataFrame([(ts("2024-01-01"), None, None), (ts("2024-01-02"), 3, "m")], kind), str(tmp_path / "n"))
    assert rows(spark.read.parquet(str(tmp_path / "n")), "user_id", "model_name") == [(3, "m"), (None, None)]


# Sketches


def test_distinct_counts_of_a_span_stay_near_the_exact_ones(spark, tmp_path):
    data = spark.range(60_000).select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,int(id % 20))").alias("start_time"), F.lit("f").alias("function_name"),
                                      F.concat(F.lit("m"), F.col("id") % 3).alias("model_name"), (F.pmod(F.xxhash64("id"), F.lit(17_000))).alias("user_id"), F.col("id").alias("query_id"))
    sketches.daily_usage(data, 12).write.parquet(str(tmp_path / "d"))
    daily = spark.read.parquet(str(tmp_path / "d"))
    assert daily.count() == 60
    for first, last in (("2024-01-01", "2024-01-20"), ("2024-01-03", "2024-01-09"), ("2024-01-05", "2024-01-05")):
        exact = data.where(F.to_date("start_time").between(first, last)).groupBy("model_name").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("query_id").alias("q"))
        for r in sketches.usage_over(daily, first, last, ["model_name"]).join(exact, "model_name").collect():
            assert abs(r.users / r.u - 1) < 5 * 0.8 / math.sqrt(1 << 12) and abs(r.queries / r.q - 1) < 5 * 0.8 / math.sqrt(1 << 12)
    none = sketches.usage_over(daily, "2030-01-01", "2030-01-02", [])
    assert none.first().users == 0


def test_no_paid_scanner_in_a_span_is_zero(spark):
    findings = spark.createDataFrame([("Security Essentials", "S1", 1, ts("2024-01-01")), ("CIS Benchmarks", "S2", 2, ts("2024-01-02")), ("CIS Benchmarks", "S2", 3, ts("2024-01-04"))],
                                     "scanner_package_name string, scanner_name string, event_id bigint, start_timestamp timestamp")
    daily = sketches.daily_scanners(findings)
    assert [sketches.paid_scanners_over(daily, a, b).first().scanners for a, b in (("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-09"))] == [0, 1]
    assert rows(sketches.run_rate_over(daily, "2024-01-01", "2024-01-09")) == [("CIS Benchmarks", 1, 2, 2, dec("1.0")), ("Security Essentials", 1, 1, 0, None)]


def test_quantiles_of_a_moving_span_are_right_within_their_rank(spark):
    data = spark.range(40_000).select(F.lit("e").alias("entity"), F.col("id").alias("query_id"), F.lit(1).alias("user_id"),
                                      F.expr("timestamp'2024-01-01' + make_interval(0,0,0,int(id % 10))").alias("start_time"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("duration_seconds"))
    limits_ = {r.day: r["limit"] for r in sketches.moving_quantile(sketches.daily_durations(data, 200), 4, 0.9).collect()}
    assert dt.date(2024, 1, 1) not in limits_ and len(limits_) == 9
    for last, limit in limits_.items():
        span = data.where(F.to_date("start_time").between(F.lit(last - dt.timedelta(days=4)), F.lit(last - dt.timedelta(days=1))))
        assert abs(span.where(F.col("duration_seconds") <= limit).count() / span.count() - 0.9) < 0.03
    null = data.limit(5).withColumn("duration_seconds", F.lit(None).cast("bigint"))
    assert sketches.daily_durations(null).count() == 0


# Totals


def test_totals_add_up(spark):
    findings = spark.createDataFrame([("p", "High", "Open", 2), ("p", "LOW", "OPEN", 3), ("q", "high", "open", 5), ("q", "high", "closed", 100), (None, "low", "open", 7)],
                                     "scanner_package_name string, severity string, state string, total_at_risk_count bigint")
    found = [tuple(r) for r in findings_totals(findings).collect()]
    assert {r for r in found if r[2] == 3} == {(None, None, 3, 4, 17)}
    for level, total in ((0, 4), (1, 4), (2, 4)):
        assert sum(r[3] for r in found if r[2] == level) == total and sum(r[4] for r in found if r[2] == level) == 17
    assert (None, None, 1, 1, 7) in found and (None, "HIGH", 2, 2, 7) in found


# Tests during the build


def test_a_model_is_tested_by_its_own_write(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(count, "id bigint")
    stored, report = sinks.materialise_tested(df, "m", "marts", str(tmp_path), {"small": F.col("id") > 89, "known": F.col("id").isNull()})
    assert rows(report) == [("known", 0, "PASS"), ("small", 10, "FAIL")] and stored.count() == 100
    assert seen.value == 100  # each row was made once, by the write
    with pytest.raises(ValueError):
        sinks.materialise_tested(df, "m", "staging", str(tmp_path), {})
    _, none = sinks.materialise_tested(df.limit(0), "none", "marts", str(tmp_path), {"small": F.col("id") > 89})
    assert rows(none) == [("small", 0, "PASS")]


# Lineage


def random_edges(seed, nodes, edges):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)]


def walk(edges):
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    out = {}
    for start in following:
        level, depth, seen = {start}, 0, {}
        while level:
            depth += 1
            level = {b for a in level for b in following.get(a, ())} - set(seen)
            seen |= {b: depth for b in level}
        out[start] = seen
    return out


@pytest.mark.parametrize("edges", [random_edges(1, 40, 60), [(f"n{k}", f"n{k + 1}") for k in range(13)], [("n1", "n2"), ("n2", "n3"), ("n3", "n1"), ("n3", "n4")]])
@pytest.mark.parametrize("steps", [1, 4])
def test_closure_and_questions_equal_a_walk(spark, edges, steps):
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "model string, parent string")
    want = walk(edges)
    assert rows(workflow.lineage_closure(df, steps_at_once=steps)) == sorted((a, b, d) for a, seen in want.items() for b, d in seen.items())
    start = spark.createDataFrame([("n1",), ("n1",), ("absent",)], "model string")
    assert rows(workflow.lineage_closure(df, start, steps_at_once=steps)) == sorted(("n1", b, d) for b, d in want.get("n1", {}).items())
    if steps == 4:
        names = sorted({n for e in edges for n in e}) + ["absent"]
        pairs = [(a, b) for a in names for b in names]
        asked = spark.createDataFrame(pairs + pairs[:3], "model string, related string")
        assert rows(workflow.reaches(df, asked)) == sorted(((a, b, b in want.get(a, {})) for a, b in pairs), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_all_pairs_are_kept_as_bits(spark, monkeypatch):
    """Models at half and a third of the number, hundreds of words of them, and a cycle: far fewer rows than pairs are kept, the pairs are the same."""
    edges = [(f"n{k}", f"n{k // d}") for k in range(1, 1500) for d in (2, 3)] + [("n0", "n7")]
    kept, cut = [], workflow.cut_lineage
    monkeypatch.setattr(workflow, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    found = workflow.lineage_closure(spark.createDataFrame(edges, "model string, parent string"))
    want = walk(edges)
    assert rows(found) == sorted((a, b, d) for a, seen in want.items() for b, d in seen.items())
    pairs = sum(len(seen) for seen in want.values())
    assert max(df.count() for df in kept) * 4 < pairs and found.columns == ["model", "related", "depth"]


def test_lineage_of_nothing(spark):
    none = spark.createDataFrame([], "model string, parent string")
    assert workflow.lineage_closure(none).collect() == []
    pairs = spark.createDataFrame([("a", "b"), ("a", None), (None, "b")], "model string, related string")
    assert rows(workflow.reaches(none, pairs.dropna())) == [("a", "b", False)]
    assert workflow.reaches(none, pairs.limit(0)).collect() == []


def test_fewer_rounds_than_levels(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(24)], "model string, parent string")
    rounds, cut = [], workflow.cut_lineage
    monkeypatch.setattr(workflow, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    found = workflow.lineage_closure(chain, spark.createDataFrame([("n0",)], "model string"), steps_at_once=8)
    # 24 levels: the edges, three rounds, and one that finds nothing more.
    assert found.count() == 24 and len(rounds) == 5


def test_edges_are_not_copied_to_tasks_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(workflow._moved, "__defaults__", (10,))
    plans, cut = [], workflow.cut_lineage
    monkeypatch.setattr(workflow, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    edges = [(f"n{k}", f"n{k // 2}") for k in range(1, 60)]
    df = spark.createDataFrame(edges, "model string, parent string")
    assert workflow.lineage_closure(df).count() == sum(len(seen) for seen in walk(edges).values())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_questions_keep_words_of_models_and_no_whole_bitmaps(spark, monkeypatch):
    edges = [e for e in random_edges(3, 300, 420) if e[0] != e[1]]
    kinds, cut = set(), workflow.cut_lineage
    monkeypatch.setattr(workflow, "cut_lineage", lambda df: kinds.update(f.dataType.typeName() for f in df.schema.fields) or cut(df))
    want, names = walk(edges), [f"n{k}" for k in range(300)]
    pairs = [(a, b) for a in names for b in names[::7]]
    got = workflow.reaches(spark.createDataFrame(edges, "model string, parent string"), spark.createDataFrame(pairs, "model string, related string"))
    assert {(r.model, r.related): r.reachable for r in got.collect()} == {(a, b): b in want.get(a, {}) for a, b in pairs}
    assert "binary" not in kinds


# Artifacts


def test_documents_drift_and_come_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "manifest.json").write_text('{"run_id": "r1",\n "nodes": {"m1": {"project": "p", "depends_on": {"nodes": ["m0"]}, "new": [1, 2]}, "m2": {"depends_on": "odd"}}}')
    (tmp_path / "b" / "run_results.json").write_text('{"run_id": "r1", "results": [{"unique_id": "m1", "status": "success", "execution_time": 2}, {"unique_id": "m2", "status": 7, "timing": {"a": 1}}]}')
    (tmp_path / "b" / "manifest.json").write_text("no json")
    (tmp_path / "b" / "other.json").write_text("{}")
    documents = files.artifact_documents(spark, str(tmp_path))
    assert rows(documents, "artifact") == [("manifest.json",), ("manifest.json",), ("run_results.json",)]
    nodes = files.document_nodes(documents)
    assert rows(nodes, "run_id", "model", "project", "depends_on") == [("r1", "m1", "p", ["m0"]), ("r1", "m2", None, [])]
    assert rows(nodes.select(F.try_variant_get("node", "$.new[1]", "int").alias("n"))) == [(2,), (None,)]
    results = files.document_results(documents)
    assert rows(results, "model", "status", "execution_seconds") == [("m1", "success", 2.0), ("m2", "7", None)]
    assert rows(results.select(F.try_variant_get("result", "$.timing.a", "int").alias("n"))) == [(1,), (None,)]
    taken = files.artifact_documents(spark, str(tmp_path), stream=True).select("path", F.to_json("document").alias("d"))
    from meterstone.streaming.tables import run_to_end

    assert run_to_end(taken, str(tmp_path / "job")).count() == 3
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "manifest.json").write_text("{}")
    assert run_to_end(taken, str(tmp_path / "job")).count() == 4


def test_results_of_artifacts_in_lines(spark, tmp_path):
    (tmp_path / "run_results.json").write_text('{"run_id": "r", "results": [{"unique_id": "m", "status": "error", "execution_time": 1.5}]}')
    found = files.run_results(files.read_artifacts(spark, str(tmp_path), "run_results.json", files.RUN_RESULTS_SCHEMA))
    assert rows(found) == [("r", "m", "error", 1.5)]
