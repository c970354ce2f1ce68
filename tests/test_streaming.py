import datetime as dt
import os
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meterstone.operators import detect, limits
from meterstone.sources import buckets, views
from meterstone.streaming import jobs, keyed
from meterstone.streaming.tables import STORE, run_batches, run_closed, run_rows, run_to_end, state_partitions, stream_table
from tests.conftest import dec, plan_of, rows, ts

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def parts(tmp_path):
    """The event table in four files, oldest first; each becomes one micro-batch."""
    table = pq.read_table(EVENTS).sort_by("ts")
    folder = tmp_path / "tables"
    folder.mkdir()
    size = table.num_rows // 4
    for i in range(4):
        part = table.slice(i * size, size if i < 3 else None)
        name = folder / ("events.parquet" if i == 0 else f"events-{i}.parquet")
        pq.write_table(part, name)
        os.utime(name, (1_700_000_000 + i,) * 2)  # streams take files by age; two may be written within a millisecond
    return folder


def stream(spark, folder):
    return views.event_columns(stream_table(spark, str(folder), "events", files_per_trigger=1))


def batch(spark):
    return views.event_columns(spark.read.parquet(EVENTS))


def test_hours_equal_the_batch_once_closed(spark, parts, tmp_path):
    shape = lambda df: df.select("ts", F.col("event_type").alias("function_name"), F.lit("m").alias("model_name"), "credits")
    got = run_to_end(jobs.hourly_usage(shape(stream(spark, parts))), str(tmp_path / "out"))
    hour = F.date_trunc("hour", "ts")
    want = shape(batch(spark)).groupBy(hour.alias("start_time"), "function_name").agg(F.sum("credits").alias("credits"), F.count(F.lit(1)).alias("requests"))
    last = batch(spark).agg(F.max("ts")).first()[0]
    closed = want.where(F.col("start_time") + F.expr("interval 1 hour") <= F.lit(last - dt.timedelta(hours=2)))
    assert rows(got, "start_time", "function_name", "credits", "requests") == rows(closed, "start_time", "function_name", "credits", "requests")


USAGE = "user_id bigint, start_time timestamp, credits decimal(38,6)"
ACCESS = "user_name string, user_id bigint, granted_at timestamp, monthly_credit_limit decimal(38,6), is_active boolean, revoked_at timestamp, revocation_reason string"


def usage_files(spark, folder, *files):
    """A stream that takes one of the files, oldest first, with each batch."""
    for data in files:
        spark.createDataFrame(data, USAGE).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_one_alert_per_month_over_many_batches(spark, parts, tmp_path):
    usage = views.ai_usage_of(stream(spark, parts))
    build = lambda: jobs.spend_alerts(usage, Decimal("1000"), F.lit("2024-01-31").cast("timestamp"))
    first = rows(run_to_end(build(), str(tmp_path / "job")))
    want = limits.first_breach(views.ai_usage_of(batch(spark)), Decimal("1000")).first()
    assert [(r[1], r[3]) for r in first] == [(want.month, want.spent_at_breach)]
    # A restart with one more file goes on from the state and sends nothing new.
    pq.write_table(pq.read_table(EVENTS).slice(0, 50), parts / "events-9.parquet")
    assert rows(run_to_end(build(), str(tmp_path / "job"))) == first


def test_enforcement_revokes_each_user_once_and_only_in_their_buckets(spark, parts, tmp_path):
    users = [r.user_id for r in batch(spark).select("user_id").distinct().collect()]
    access = spark.createDataFrame([(f"u{i}", i, ts("2024-01-01"), dec(2000), True, None, None) for i in users], ACCESS)
    buckets.save_buckets(access, "enforced_access", 16, path=str(tmp_path / "access"))
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "access").rglob("part-*.parquet")}
    before, at = files(), F.lit("2024-01-31").cast("timestamp")
    found = run_closed(lambda e: jobs.limit_actions(views.ai_usage_of(e), spark.table("enforced_access"), at), stream(spark, parts), str(tmp_path / "job"), "ts", user_id=1)
    spend = limits.user_month_spend(views.ai_usage_of(batch(spark)), dt.date(2024, 1, 31))
    want = rows(limits.limit_enforcement(access, spend), "user_name")
    assert want and rows(found, "user_name") == want
    for _ in range(2):  # the second run has no new actions
        jobs.apply_actions(spark, str(tmp_path / "job"), "enforced_access", at)
    now = buckets.read_buckets(spark, "enforced_access")
    assert rows(now.where("not is_active"), "user_name") == want and now.count() == len(users)
    touched = set(buckets.touched(found, 16))
    kept = {f.parent.name for f, t in files().items() if before.get(f) == t}
    assert kept == {f"bucket={b}" for b in range(16) if b not in touched and any(f.parent.name == f"bucket={b}" for f in before)}


def test_late_usage_of_an_old_month_revokes_nobody(spark, tmp_path):
    usage = usage_files(spark, tmp_path / "usage", [(1, ts("2024-01-20"), dec(90)), (1, ts("2024-02-01"), dec(5))],
                        [(1, ts("2024-01-21"), dec(20)), (1, ts("2024-02-20"), dec(500))], [(2, ts("2024-02-02"), dec(101))])
    access = spark.createDataFrame([(f"u{i}", i, ts("2024-01-01"), dec(100), True, None, None) for i in (1, 2)], ACCESS)
    build = lambda u: jobs.limit_actions(u, access, F.lit("2024-02-03").cast("timestamp"), late="30 days")
    found = run_closed(build, usage, str(tmp_path / "job"), "start_time", user_id=1)
    assert rows(found, "user_name", "credits_used") == [("u2", dec("101.000000"))]


def test_who_is_granted_access_again_is_checked_again(spark, tmp_path):
    access = spark.createDataFrame([("u1", 1, ts("2024-01-01"), dec(100), True, None, None)], ACCESS)
    buckets.save_buckets(access, "regranted_access", 2, path=str(tmp_path / "access"))
    users = spark.createDataFrame([(1, "u1")], "user_id bigint, name string")
    job, at = str(tmp_path / "job"), F.lit("2024-01-31").cast("timestamp")

    def check(day, credits):
        usage_files(spark, tmp_path / "usage", [(1, ts(day), dec(credits))])
        usage = spark.readStream.schema(USAGE).parquet(str(tmp_path / "usage"))
        found = run_to_end(jobs.limit_actions(usage, buckets.read_buckets(spark, "regranted_access"), at, late="0 seconds"), job)
        jobs.apply_actions(spark, job, "regranted_access", at)
        return rows(found, "credits_used"), rows(buckets.read_buckets(spark, "regranted_access"), "is_active")

    check("2024-01-02", 101)
    assert check("2024-01-03", 1) == ([(dec("101.000000"),)], [(False,)])
    buckets.grant("regranted_access", spark.createDataFrame([("u1", dec(150), ts("2024-01-04"))], "user_name string, monthly_credit_limit decimal(38,6), requested_at timestamp"), users, dt.date(2024, 1, 4))
    assert check("2024-01-05", 30)[1] == [(True,)]
    check("2024-01-06", 30)
    assert check("2024-01-07", 1)[1] == [(False,)]


def test_access_comes_back_when_the_month_starts(spark, tmp_path):
    access = spark.createDataFrame([(f"u{i}", i, ts("2024-01-01"), dec(100), True, None, None) for i in (1, 2, 3)], ACCESS)
    buckets.save_buckets(access, "returned_access", 2, path=str(tmp_path / "access"))
    usage = usage_files(spark, tmp_path / "usage", [(1, ts("2024-01-20"), dec(101)), (2, ts("2024-01-21"), dec(99))])
    at, job = F.lit("2024-01-31").cast("timestamp"), str(tmp_path / "job")
    build = lambda u: jobs.limit_actions(u, buckets.read_buckets(spark, "returned_access"), at, reinstate=True)
    found = run_closed(build, usage, job, "start_time", user_id=1)
    assert rows(found, "user_name", "month", "action") == [("u1", dt.date(2024, 1, 1), "REVOKED"), ("u1", dt.date(2024, 2, 1), "GRANTED")]
    jobs.apply_actions(spark, job, "returned_access", at)
    assert rows(buckets.read_buckets(spark, "returned_access"), "user_name", "is_active", "granted_at") == [
        ("u1", True, ts("2024-02-01")), ("u2", True, ts("2024-01-01")), ("u3", True, ts("2024-01-01"))]
    # Taken away in one run and given back in a later one.
    revoked = spark.createDataFrame([("u2",)], "user_name string")
    buckets.update_rows("returned_access", revoked, limits.revoked_access, at)
    back = spark.createDataFrame([("u2", dt.date(2024, 2, 1)), ("u3", dt.date(2024, 2, 1))], "user_name string, month date")
    buckets.update_rows("returned_access", back, limits.granted_access, at)
    assert rows(buckets.read_buckets(spark, "returned_access"), "user_name", "is_active", "granted_at", "revoked_at") == [
        ("u1", True, ts("2024-02-01"), None), ("u2", True, ts("2024-02-01"), None), ("u3", True, ts("2024-02-01"), None)]


def test_access_rows_are_never_copied_through_the_driver(spark, tmp_path):
    """Names compress to files far below the broadcast threshold, while their rows need hundreds of megabytes on the driver."""
    access = spark.createDataFrame([("u1", 1, ts("2024-01-01"), dec(100), True, None, None)], ACCESS)
    buckets.save_buckets(access, "merged_access", 2, path=str(tmp_path / "access"))
    usage = usage_files(spark, tmp_path / "usage", [(1, ts("2024-01-20"), dec(101))])
    at = F.lit("2024-01-31").cast("timestamp")
    stream_plan = plan_of(jobs.limit_actions(usage, buckets.read_buckets(spark, "merged_access"), at, reinstate=True))
    assert "SortMergeJoin" in stream_plan and "BroadcastHashJoin" not in stream_plan
    users = spark.createDataFrame([("u1", dt.date(2024, 2, 1))], "user_name string, month date")
    held = buckets.read_buckets(spark, "merged_access")
    for changed in (limits.revoked_access(held, users, at), limits.granted_access(held, users, at)):
        assert "BroadcastHashJoin" not in plan_of(changed)


def test_budget_actions_come_once_and_access_returns_without_usage(spark, tmp_path):
    kind = "agent_name string, start_time timestamp, token_credits decimal(38,6)"
    folder = tmp_path / "usage"
    for data in ([("a", "2024-01-02", 50), ("b", "2024-01-02", 100)], [("a", "2024-01-10", 35)], [("a", "2024-01-11", 20), ("other", "2024-01-12", 999)], [("b", "2024-02-02", 80)], [("b", "2024-02-10", 1)]):
        spark.createDataFrame([(a, ts(t), dec(c)) for a, t, c in data], kind).coalesce(1).write.mode("append").parquet(str(folder))
    usage = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(folder))
    tags = spark.createDataFrame([("a", "x"), ("b", "y")], "agent_name string, tag_value string")
    budgets = spark.createDataFrame([("x", dec(100)), ("y", dec(100))], "tag_value string, monthly_limit decimal(38,6)")
    found = run_closed(lambda u: jobs.budget_actions(u, tags, budgets), usage, str(tmp_path / "job"), "start_time", agent_name="a")
    whole = spark.read.parquet(str(folder))
    assert rows(found, "tag_value", "month", "action") == rows(limits.budget_actions(limits.tag_spend(whole, tags), budgets), "tag_value", "month", "action")
    assert ("x", dt.date(2024, 2, 1), "REINSTATE") in rows(found, "tag_value", "month", "action")  # x has no usage in February


def test_a_month_begins_by_timer_while_the_stream_runs_on(spark, tmp_path):
    usage = usage_files(spark, tmp_path / "usage", [(1, ts("2024-01-20"), dec(101))], [(2, ts("2024-02-05"), dec(1))], [(2, ts("2024-02-06"), dec(1))])
    hours = lambda: keyed.hourly_spend(usage.withWatermark("start_time", "1 hour"), F.col("user_id")).withColumn("credit_limit", F.lit(dec(100)))
    found = run_to_end(keyed.spend_watch(hours(), [("NOTIFY", 80), ("REVOKE", 100)], at_end="REINSTATE"), str(tmp_path / "job"))
    assert rows(found, "subject", "month", "action") == [(1, dt.date(2024, 1, 1), "NOTIFY"), (1, dt.date(2024, 1, 1), "REVOKE"), (1, dt.date(2024, 2, 1), "REINSTATE")]


def test_every_window_closes_after_the_end(spark, parts, tmp_path):
    build = lambda df: jobs.auth_failures(views.logins_of(df), 1, "1 day")
    whole = run_closed(build, stream(spark, parts), str(tmp_path / "out"), "ts", event_type="error")
    assert rows(whole) == rows(detect.auth_failures(views.logins_of(batch(spark)), 1, "1 day"))


def test_runaway_queries_are_reported_once(spark, parts, tmp_path):
    users = spark.createDataFrame([], "user_id bigint, name string")
    found = run_to_end(jobs.runaway_work(views.ai_usage_of(stream(spark, parts)), users, Decimal("50"), F.lit("2024-01-31").cast("timestamp")), str(tmp_path / "out"))
    want = limits.runaway_detection(views.ai_usage_of(batch(spark)), users, dt.date(2024, 1, 31), Decimal("50")).distinct()
    assert rows(found) == rows(want) and found.count() >= 1


def test_dormant_logins_across_batches_and_a_restart_equal_the_batch(spark, parts, tmp_path):
    held = tmp_path / "held"
    held.mkdir()
    for name in ("events-2.parquet", "events-3.parquet"):
        (held / name).write_bytes((parts / name).read_bytes())
        pq.write_table(pq.read_table(EVENTS).slice(0, 0), parts / name)  # these rows come only after the restart
        os.utime(parts / name, (1_700_000_010,) * 2)
    build = lambda df: jobs.dormant_logins(views.logins_of(df), 1)
    early = run_to_end(build(stream(spark, parts)), str(tmp_path / "first")).count()
    for i, name in enumerate(("events-2.parquet", "events-3.parquet")):
        (parts / f"events-{i + 7}.parquet").write_bytes((held / name).read_bytes())
        os.utime(parts / f"events-{i + 7}.parquet", (1_700_000_020 + i,) * 2)
    run_to_end(build(stream(spark, parts)), str(tmp_path / "first"))
    got = spark.read.parquet(str(tmp_path / "first" / "rows"))
    want = detect.dormant_login(views.logins_of(batch(spark)), 1)
    # What is missing lies in the hours that were still open at the end.
    assert 0 < early < got.count() and not set(rows(got)) - set(rows(want, *got.columns))
    closed = run_closed(build, stream(spark, parts), str(tmp_path / "second"), "ts")
    assert rows(closed) == rows(want, *closed.columns) and closed.count() > 10


def test_last_logins_before_the_stream_are_its_first_state(spark, tmp_path):
    kind = "user_id bigint, ts timestamp, is_success boolean"
    spark.createDataFrame([(1, ts("2024-06-01"), True), (2, ts("2024-06-01"), True), (3, ts("2024-06-01"), True), (2, ts("2024-06-02"), False)], kind).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1, ts("2024-01-01")), (2, ts("2024-05-31")), (1, ts("2023-01-01"))], "user_id bigint, last_seen timestamp")
    found = run_closed(lambda df: jobs.dormant_logins(df, 90, known), spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "job"), "ts", is_success=True)
    assert rows(found) == [(1, ts("2024-01-01"), ts("2024-06-01"))]
    with pytest.raises(ValueError):
        jobs.dormant_logins(found, 0)


def test_addresses_are_new_once_and_forgotten_after_a_time(spark, parts, tmp_path):
    known = spark.createDataFrame([(u, f"10.0.{u}.0", ts("2024-01-01")) for u in range(15)], "user_id bigint, client_ip string, last_seen timestamp")
    got = run_closed(lambda df: jobs.unusual_ip_logins(views.logins_of(df), known), stream(spark, parts), str(tmp_path / "out"), "ts")
    want = views.logins_of(batch(spark)).where("is_success").groupBy("user_id", "client_ip").agg(F.min("ts").alias("login_at")).join(known, ["user_id", "client_ip"], "left_anti")
    assert rows(got) == rows(want)
    kind = "user_id bigint, client_ip string, ts timestamp, is_success boolean"
    for day in ("2024-01-01", "2024-01-09", "2024-01-15", "2024-03-01", "2024-03-02"):
        spark.createDataFrame([(1, "a", ts(day), True), (2, day, ts(day), True)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    short = run_closed(lambda df: jobs.unusual_ip_logins(df, forget_days=10), spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")),
                       str(tmp_path / "short"), "ts", is_success=True)
    # Seen on the 1st, 9th and 15th it stays known; on the first of March it is new again.
    assert [r[2] for r in rows(short) if r[0] == 1] == [ts("2024-01-01"), ts("2024-03-01")]


def test_keys_that_share_state_are_forgotten_each_at_its_own_time(spark, tmp_path):
    kind = "user_id bigint, client_ip string, ts timestamp, is_success boolean"
    for data in ([("a", "2024-01-01"), ("b", "2024-01-05"), (None, "2024-01-05")], [("c", "2024-01-14")], [("a", "2024-01-14"), ("b", "2024-01-14")], [("b", "2024-01-16"), ("a", "2024-01-20")], [(None, "2024-01-21")]):
        spark.createDataFrame([(1, ip, ts(day), True) for ip, day in data], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(1, "c", ts("2024-01-10")), (1, "d", ts("2024-01-01")), (2, None, ts("2024-01-01"))], "user_id bigint, client_ip string, last_seen timestamp")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run_closed(lambda df: keyed.last_seen(df.where("is_success"), ["user_id", "client_ip"], "ts", None, 10, known, groups=1), read, str(tmp_path / "job"), "ts", is_success=True)
    assert rows(found, "client_ip", "seen_at") == [("a", ts("2024-01-01")), ("a", ts("2024-01-14")), ("b", ts("2024-01-05")), (None, ts("2024-01-05")), (None, ts("2024-01-21"))]


def test_state_is_split_by_a_few_megabytes_of_input(spark, tmp_path):
    (tmp_path / "t.parquet").write_bytes(bytes(50 << 20))
    assert state_partitions(spark, str(tmp_path / "t.parquet")) == 13


def test_failures_and_errors_stream(spark, parts, tmp_path):
    got = run_to_end(jobs.auth_failures(views.logins_of(stream(spark, parts)), 2, "1 day"), str(tmp_path / "out"))
    want = detect.auth_failures(views.logins_of(batch(spark)), 2, "1 day").where("window_end <= '2024-01-30'")
    assert rows(got.where("window_end <= '2024-01-30'")) == rows(want)
    shape = lambda df: df.select("user_id", F.col("ts").alias("start_time"), (F.col("event_type") == "error").alias("is_error"))
    errors = run_to_end(jobs.job_errors(shape(stream(spark, parts)), 2), str(tmp_path / "errors"))
    assert rows(errors.where("window_end <= '2024-01-30'")) == rows(detect.job_errors(shape(batch(spark)), 2).where("window_end <= '2024-01-30'"))


def test_change_filters_take_a_stream(spark, parts, tmp_path):
    seen = []
    run_batches(detect.network_policy_changes(views.change_events_of(stream(spark, parts))), str(tmp_path / "job"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == detect.network_policy_changes(views.change_events_of(batch(spark))).count()


def test_active_scanners_per_day(spark, parts, tmp_path):
    shape = lambda df: df.select(
        F.col("ts").alias("start_timestamp"), F.concat(F.lit("S"), F.col("event_id") % 30).alias("scanner_name"),
        F.when(F.col("event_id") % 3 == 0, "Security Essentials").otherwise("CIS Benchmarks").alias("scanner_package_name"),
    )
    got = {r.window_start: r.scanners for r in run_to_end(jobs.active_scanners(shape(stream(spark, parts))), str(tmp_path / "out")).collect()}
    day = F.date_trunc("day", "start_timestamp")
    want = shape(batch(spark)).where("scanner_package_name <> 'Security Essentials'").groupBy(day.alias("d")).agg(F.count_distinct("scanner_name").alias("n"))
    for r in want.where("d < '2024-01-29'").collect():
        assert abs(got[r.d] - r.n) <= 1


def test_a_job_can_run_at_an_interval(spark, parts, tmp_path):
    before = spark.conf.get(STORE, None)
    job = run_rows(jobs.dormant_logins(views.logins_of(stream(spark, parts)), 1), str(tmp_path / "job"), every="1 second")
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    assert spark.read.parquet(str(tmp_path / "job" / "rows")).count() > 10 and spark.conf.get(STORE, None) == before
