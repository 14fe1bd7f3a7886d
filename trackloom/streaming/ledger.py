"""Streams over submissions, sessions and reminders. Each gives, at its end, the batch operator's answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.streaming.keyed import together, with_state

CREDITED = "event_id bigint, part_id bigint, annotator string, submitted_at timestamp, cumulative bigint, is_final boolean, credited bigint, rejected boolean"


class CreditPart(StatefulProcessor):
    """State of a part: ``mark``, its highest count and whether it is final."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "high bigint, final boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        f = together(rows).sort_values(["submitted_at", "event_id"], kind="stable").reset_index(drop=True)
        high, final = self.mark.get() if self.mark.exists() else (0, False)
        count, last = f["cumulative"].to_numpy("int64"), f["is_final"].to_numpy(bool)
        # What was before each row: the highest count so far, and whether a final one came.
        before = np.maximum.accumulate(np.r_[high, count])
        closed = np.logical_or.accumulate(np.r_[final, last])
        rejected = ~closed[:-1] & (count < before[:-1])
        credited = np.where(closed[:-1] | rejected, 0, np.maximum(count - before[:-1], 0))
        self.mark.update((int(before[-1]), bool(closed[-1])))
        kept = rejected | (credited > 0) | last
        if kept.any():
            out = f.assign(part_id=key[0], credited=credited, rejected=rejected)[kept]
            yield out[["event_id", "part_id", "annotator", "submitted_at", "cumulative", "is_final", "credited", "rejected"]]


def online_credit(submissions: DataFrame) -> DataFrame:
    """The credit ledger with two values of state per part: rows of a part are taken by time and id within a batch."""
    return with_state(submissions, "part_id", CreditPart(), CREDITED)


def weekly_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling weeks from Tuesday 00:00 at UTC+8."""
    week = F.window("submitted_at", "7 days", "7 days", "4 days 16 hours")
    return events.withWatermark("submitted_at", late).groupBy(week.alias("week")).agg(F.count("*").alias("events"), F.sum("cumulative").alias("cumulative")).select(F.col("week.start").alias("week_start"), "events", "cumulative")


def unique_reminders(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each reminder once, if its repeats come within the watermark."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])


def notifications(changes: DataFrame, users: DataFrame) -> DataFrame:
    """A stream of changes (change_id, publisher, manager) to notifications of the active users named; users is a table."""
    named = changes.withColumn("username", F.explode(F.array_distinct(F.array_compact(F.array("publisher", "manager"))))).drop("publisher", "manager")
    return named.join(users.where("is_active").select("username"), "username")


def daily_credit(credits: DataFrame, late: str = "1 day") -> DataFrame:
    """(day_start, annotator, credited) of a stream of credited events: days from midnight at UTC+8."""
    day = F.window("submitted_at", "1 day", "1 day", "16 hours")
    return credits.where("not rejected").withWatermark("submitted_at", late).groupBy(day.alias("day"), "annotator").agg(F.sum("credited").alias("credited")).select(F.col("day.start").alias("day_start"), "annotator", "credited")


PAIRED = "part_id bigint, actor string, started_at timestamp, ended_at timestamp, timed_out boolean"


class PairSessions(StatefulProcessor):
    """State of a part: ``open``, when and by whom its open session began; a timer ends it ``limit_ms`` after."""

    def __init__(self, start: list[str], limit_ms: int):
        self.start, self.limit_ms = start, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at bigint, actor string")

    def _told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["part_id", "actor", "started_at", "ended_at", "timed_out"]).astype({"started_at": "datetime64[us]", "ended_at": "datetime64[us]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held, out = self.open.get() if self.open.exists() else None, []
        for a in together(rows).sort_values(["ts", "action_id"]).itertuples(index=False):
            if held is not None:
                out.append((key[0], held[1], pd.Timestamp(held[0], unit="us"), pd.NaT if a.action in self.start else a.ts, False))
            held = (int(a.ts.value // 1000), a.actor) if a.action in self.start else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is None:
            self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer(max(held[0] // 1000 + self.limit_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._told(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            at, actor = self.open.get()
            self.open.clear()
            yield from self._told([(key[0], actor, pd.Timestamp(at, unit="us"), pd.NaT, True)])


def online_sessions(actions: DataFrame, start: list[str], stop: list[str], most: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of actions (action_id, part_id, actor, action, ts) as they close: by a stop, by another start, which leaves the end open, or by a timer, which also does, once the watermark is ``most`` behind the start."""
    rows = actions.where(F.col("action").isin(*start, *stop)).select("action_id", "part_id", "actor", "action", "ts").withWatermark("ts", late)
    return with_state(rows, "part_id", PairSessions(start, int(pd.Timedelta(most).total_seconds() * 1000)), PAIRED, "eventtime")
