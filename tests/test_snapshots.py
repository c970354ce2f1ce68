import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterstone.operators import snapshots as s
from tests.conftest import rows, ts

HISTORY = "id bigint, status string, updated_at timestamp, valid_from timestamp, valid_to timestamp"
SOURCE = "id bigint, status string, updated_at timestamp"
NOW = ts("2024-03-01")
OLD, MID, NEW = ts("2024-01-01"), ts("2024-01-15"), ts("2024-02-01")


@pytest.fixture
def history(spark):
    return spark.createDataFrame([
        (1, "same", OLD, OLD, None), (2, "changed", OLD, OLD, None), (3, "gone", OLD, OLD, None),
        (4, "first", OLD, OLD, MID), (4, "second", MID, MID, None), (5, None, OLD, OLD, None), (6, "back", OLD, OLD, MID),
    ], HISTORY)


@pytest.fixture
def source(spark):
    return spark.createDataFrame([
        (1, "same", OLD), (2, "CHANGED", NEW), (4, "second", MID), (5, None, OLD), (6, "back", NEW), (7, "new", NEW),
    ], SOURCE)


def versions(df):
    return rows(df, "id", "status", "valid_from", "valid_to")


def in_order(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


EXPECTED = in_order([
    (1, "same", OLD, None), (2, "CHANGED", NEW, None), (2, "changed", OLD, NEW), (3, "gone", OLD, None), (4, "first", OLD, MID),
    (4, "second", MID, None), (5, None, OLD, None), (6, "back", NEW, None), (6, "back", OLD, MID), (7, "new", NEW, None),
])


def test_timestamp_strategy(history, source):
    assert versions(s.snapshot_timestamp(source, history, "id", "updated_at", NOW)) == EXPECTED


def test_hard_deletes_close_only_missing_keys(history, source):
    closed = in_order([(i, t, f, NOW if i == 3 else to) for i, t, f, to in EXPECTED])
    assert versions(s.snapshot_timestamp(source, history, "id", "updated_at", NOW, hard_deletes=True)) == closed
    alone = {(r.id, r.status): r.valid_to for r in s.hard_deletes(source, history, "id", NOW).collect()}
    assert alone[(3, "gone")] == NOW and alone[(1, "same")] is None and alone[(4, "first")] == MID


def test_check_strategy_compares_nulls_safely(history, source):
    after = versions(s.snapshot_check(source, history, "id", ["status"], NOW))
    assert (2, "changed", OLD, NOW) in after and (2, "CHANGED", NOW, None) in after
    assert (5, None, OLD, None) in after and (7, "new", NOW, None) in after
    assert len(after) == 10


def test_repeated_run_changes_nothing(history, source):
    once = s.snapshot_timestamp(source, history, "id", "updated_at", NOW, hard_deletes=True)
    twice = s.snapshot_timestamp(source, once, "id", "updated_at", ts("2024-04-01"), hard_deletes=True)
    assert versions(once) == versions(twice)


def test_older_source_row_does_not_reopen(spark, history):
    stale = spark.createDataFrame([(2, "stale", ts("2023-01-01"))], SOURCE)
    assert (2, "changed", OLD, None) in versions(s.snapshot_timestamp(stale, history, "id", "updated_at", NOW))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400)), min_size=1, max_size=40, unique=True))
def test_validity_equals_plain_lead(spark, data):
    changes = spark.createDataFrame([(k, OLD + dt.timedelta(days=d)) for k, d in data], "id bigint, updated_at timestamp")
    got = {(r.id, r.valid_from): r.valid_to for r in s.validity_from_history(changes, "id", "updated_at").collect()}
    for key, day in data:
        later = [d for k, d in data if k == key and d > day]
        want = OLD + dt.timedelta(days=min(later)) if later else None
        assert got[(key, OLD + dt.timedelta(days=day))] == want


def test_validity_keeps_rows_without_a_time(spark):
    changes = spark.createDataFrame([(1, None), (1, OLD), (1, NEW)], "id bigint, updated_at timestamp")
    assert rows(s.validity_from_history(changes, "id", "updated_at"), "valid_from", "valid_to") == [(OLD, NEW), (NEW, None), (None, None)]
