"""Checks that keep state per key in Spark's state store and act when event time passes a point.

Rows are first summed per key and hour (a windowed aggregation, given out once the hour is over), so a key that holds a large part
of all rows is a few rows an hour here. Hours come in order of time, and a batch that is repeated gives the same rows. Every key
has one timer, after which its state goes, so state is bounded by the keys of the last ``forget`` days or the current month.

Times are whole microseconds inside the state, so no time zone plays a part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processors travel with the job, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400_000_000
HOUR = "1 hour"


class LastSeen(StatefulProcessor):
    """When keys were last seen. Gives a row for a key that is new (``gap`` None), or that comes back after ``gap`` or more.

    State is held for groups of keys: reading and writing it costs about the same for one key as for hundreds. One timer a group, no
    later than its first key is due, so each key is forgotten at its own time.
    """

    def __init__(self, keys: list[str], kinds: str, gap: int | None, forget: int) -> None:
        self.keys, self.kinds, self.gap, self.forget = keys, kinds, gap, forget
        self.names = [*keys, "previous_us", "seen_us"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", f"timer bigint, seen array<struct<{self.kinds}, last_us: bigint>>")

    def load(self) -> tuple[int | None, dict[tuple, int]]:
        timer, seen = self.state.get() or (None, [])
        return timer, {tuple(r[:-1]): r[-1] for r in seen}

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, seen = self.load()
        came: dict[tuple, list[tuple[int, int]]] = {}
        for r in rows:
            came.setdefault(tuple(r[k] for k in self.keys), []).append((r["first_us"], r["last_us"]))
        for name, times in came.items():
            last = seen.get(name)
            for first, final in sorted(times):
                if (last is None) if self.gap is None else (last is not None and first >= last + self.gap):
                    yield Row(**dict(zip(self.names, (*name, last, first))))
                last = final if last is None else max(last, final)
            seen[name] = last
        self.remember(seen, timer, min(seen[name] for name in came))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        seen = {tuple(r[k] for k in self.keys): r["last_us"] for r in initialState["known"]}
        self.remember(seen, None, min(seen.values()))

    def remember(self, seen: dict[tuple, int], timer: int | None, earliest: int) -> None:
        due = self.due(earliest)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update((timer, [(*name, last) for name, last in seen.items()]))

    def due(self, last: int) -> int:
        return (last + self.forget) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        seen = {name: last for name, last in self.load()[1].items() if self.due(last) > now}
        if seen:
            self.remember(seen, None, min(seen.values()))
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class SpendWatch(StatefulProcessor):
    """Spend of a (subject, month) against its limit.

    ``steps`` are (action, percent of the limit) in rising order; each action is given out once, and again where ``since`` tells that the
    limit has been granted anew. When the month is over, ``at_end`` follows if the last action has been given out, whether or not any
    usage arrives, and the state goes.
    """

    def __init__(self, steps: list[tuple[str, Decimal]], strict: bool, at_end: str | None) -> None:
        self.steps, self.strict, self.at_end = steps, strict, at_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("spent", "credits decimal(38,6), done int, since bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        spent, done, since = self.state.get() or (Decimal(0), None, None)
        if done is None:
            self.handle.registerTimer(key[1] // 1000)
        for _, credits, limit, granted in sorted((r["hour_us"], r["credits"], r["credit_limit"], r["since_us"]) for r in rows):
            spent += credits
            if done is None or granted != since:
                done, since = 0, granted
            while done < len(self.steps) and (spent * 100 > limit * self.steps[done][1] or not self.strict and spent * 100 == limit * self.steps[done][1]):
                yield self.row(key, self.steps[done][0], spent, limit)
                done += 1
        self.state.update((spent, done, since))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        spent, done, _ = self.state.get() or (None, None, None)
        self.state.clear()
        if done == len(self.steps) and self.at_end:
            yield self.row(key, self.at_end, spent, None)

    def row(self, key: tuple, action: str, credits: Decimal, limit: Decimal | None) -> Row:
        return Row(subject=key[0], month_end_us=key[1], action=action, credits=credits, credit_limit=limit)

    def close(self) -> None:
        pass


def last_seen(rows: DataFrame, keys: list[str], ts: str, gap_days: int | None, forget_days: int, known: DataFrame | None = None, late: str = "10 minutes",
              groups: int = 1 << 16) -> DataFrame:
    """A stream of (keys, previous_seen, seen_at): keys seen for the first time, or, with ``gap_days``, again after so many days.

    ``known`` (keys, last_seen) is what had been seen before the stream began; it is read once, into the state. State is kept for
    ``groups`` groups of keys, dealt by their hash; the number stays as it is for as long as the stream lives.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("_group")
    hours = rows.withWatermark(ts, late).groupBy(*keys, F.window(ts, HOUR).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    hours = hours.select(group, *keys, F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), F.window_time("w").alias("at"))
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    begin = None
    if known is not None:
        latest = known.groupBy(*keys).agg(F.max(F.unix_micros("last_seen")).alias("last_us")).where("last_us IS NOT NULL")
        latest = latest.select(*[F.col(k).cast(kind) for k, kind in kinds.items()], "last_us")
        begin = latest.groupBy(group).agg(F.collect_list(F.struct(*keys, "last_us")).alias("known")).groupBy("_group")
    watch = LastSeen(keys, ", ".join(f"{k}: {kind}" for k, kind in kinds.items()), None if gap_days is None else gap_days * DAY, forget_days * DAY)
    listed = ", ".join(f"{k} {kind}" for k, kind in kinds.items())
    found = hours.groupBy("_group").transformWithState(watch, f"{listed}, previous_us bigint, seen_us bigint", "append", "eventTime", initialState=begin)
    return found.select(*keys, F.timestamp_micros("previous_us").alias("previous_seen"), F.timestamp_micros("seen_us").alias("seen_at"))


def hourly_spend(usage: DataFrame, subject: Column) -> DataFrame:
    """Credits of each subject and hour, once the hour is over, with the month it belongs to. ``start_time`` has a watermark."""
    summed = usage.groupBy(subject.alias("subject"), F.window("start_time", HOUR).alias("w")).agg(F.sum("credits").alias("credits"))
    month_end = F.add_months(F.date_trunc("month", F.col("w.start")), 1).cast("timestamp")
    return summed.select(
        "subject", F.unix_micros(month_end).alias("month_end_us"), F.unix_micros("w.start").alias("hour_us"),
        F.col("credits").cast("decimal(38,6)").alias("credits"), F.window_time("w").alias("at"),
    )


def spend_watch(hours: DataFrame, steps: list[tuple[str, int]], strict: bool = True, at_end: str | None = None) -> DataFrame:
    """A stream of (subject, month, action, credits, credit_limit) from ``hourly_spend`` with columns ``credit_limit`` and, at will, ``since``.

    Each hour is a check: ``credits`` is the spend of the month up to the first hour that calls for the action, however
    the hours come in batches. ``at_end`` carries the month that then starts.
    """
    watch = SpendWatch([(name, Decimal(percent)) for name, percent in steps], strict, at_end)
    kind = hours.schema["subject"].dataType.simpleString()
    since = F.unix_micros("since") if "since" in hours.columns else F.lit(0).cast("bigint")
    hours = hours.withColumn("since_us", F.coalesce(since, F.lit(0)))
    found = hours.groupBy("subject", "month_end_us").transformWithState(
        watch, f"subject {kind}, month_end_us bigint, action string, credits decimal(38,6), credit_limit decimal(38,6)", "append", "eventTime")
    month_end = F.to_date(F.timestamp_micros("month_end_us"))
    month = F.when(F.col("action").eqNullSafe(F.lit(at_end)), month_end).otherwise(F.add_months(month_end, -1))
    return found.select("subject", month.alias("month"), "action", "credits", "credit_limit")
