"""The life cycle of parts as a fold over an action log, in batch and as a stream, and the rules for edits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators import changes
from trackloom.operators.ordering import stored
from trackloom.streaming.keyed import together, with_state

#: What a fold gives, in one schema: kind says which of the columns count.
OUT = "kind string, seq bigint, action_id bigint, task_id bigint, part_id bigint, actor string, at double, status string, annotator string, work_seconds double, progress_count bigint, started double, ended double, cumulative bigint, credited bigint, is_final boolean, note string, part_index bigint, image_count bigint"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


#: A part's state by columns, and what they hold.
STATE = {"part_index": int, "image_count": int, "status": str, "annotator": str, "work_seconds": float, "progress_count": int, "opened": float, "credited": int, "final": bool}
STATE_SCHEMA = "part_index bigint, image_count bigint, status string, annotator string, work_seconds double, progress_count bigint, opened double, credited bigint, final boolean"


@dataclass
class Part:
    part_id: int
    part_index: int
    image_count: int = 0
    status: str = "pending"
    annotator: str | None = None
    work_seconds: float = 0.0
    progress_count: int = 0
    opened: float | None = None
    credited: int = 0
    final: bool = False


@dataclass
class Task:
    """A task's parts and who may review them. ``do`` applies an action: it returns the rows that it makes, or a rejection."""

    task_id: int
    reviewers: list[str]
    parts: dict[int, Part] = field(default_factory=dict)

    def do(self, a) -> list[dict]:
        rule = getattr(self, f"_{a.action}", None) if a.action in ACTIONS else None
        if rule is None:
            return [self._row("reject", a, note="unknown action")]
        p = None
        if a.action != "claim":
            p = None if a.part_id is None or a.part_id != a.part_id else self.parts.get(int(a.part_id))
            if p is None:
                return [self._row("reject", a, note="unknown part")]
        out = rule(a, p)
        return [self._row("reject", a, note=out, part_id=p.part_id if p else None)] if isinstance(out, str) else out

    def _row(self, kind: str, a, **more) -> dict:
        return {"kind": kind, "action_id": a.action_id, "task_id": self.task_id, "actor": a.actor, "at": a.at} | more

    def _open(self, p: Part, a) -> None:
        p.opened = a.at

    def _close(self, p: Part, a) -> list[dict]:
        if p.opened is None:
            return []
        p.work_seconds += max(0.0, a.at - p.opened)
        began, p.opened = p.opened, None
        return [self._row("session", a, part_id=p.part_id, annotator=p.annotator, started=began, ended=a.at)]

    def _comment(self, p: Part, a, kind: str) -> dict:
        return self._row("comment", a, part_id=p.part_id, status=kind)

    def _credit(self, p: Part, a, cumulative: int, final: bool) -> list[dict] | str:
        if not p.final and cumulative < p.credited:
            return "below what is credited"
        added = 0 if p.final else cumulative - p.credited
        if not final and added == 0:
            return []
        p.credited += added
        p.final |= final
        return [self._row("event", a, part_id=p.part_id, annotator=a.actor, cumulative=cumulative, credited=added, is_final=final)]

    def _busy(self, actor: str, *statuses: str, but: int | None = None) -> bool:
        return any(p.annotator == actor and p.status in statuses and p.part_id != but for p in self.parts.values())

    def _claim(self, a, _) -> list[dict] | str:
        if self._busy(a.actor, "in_progress", "paused"):
            return "another part is active"
        p = min((p for p in self.parts.values() if p.status == "pending"), key=lambda p: p.part_index, default=None)
        if p is None:
            return "no part is left"
        p.status, p.annotator = "in_progress", a.actor
        self._open(p, a)
        return []

    def _pause(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status != "in_progress":
            return "only the active annotator can pause"
        out = self._close(p, a)
        p.status = "paused"
        return [*out, self._comment(p, a, "pause")]

    def _resume(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status != "paused":
            return "only the assigned annotator can resume"
        if self._busy(a.actor, "in_progress", but=p.part_id):
            return "another part is active"
        p.status = "in_progress"
        self._open(p, a)
        return [self._comment(p, a, "resume")]

    def _return(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status not in ("in_progress", "paused"):
            return "only the assigned annotator can return"
        out = self._close(p, a)
        p.status, p.annotator, p.work_seconds = "pending", None, 0.0
        return [*out, self._comment(p, a, "return")]

    def _progress(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status not in ("in_progress", "paused"):
            return "only the active annotator can submit progress"
        if p.final:
            return "finished before"
        value = -1 if a.value is None or a.value != a.value else int(a.value)
        if value < 0 or 0 < p.image_count < value:
            return "beyond the part's images"
        out = self._credit(p, a, value, False)
        if not isinstance(out, str):
            p.progress_count = value
        return out

    def _submit(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status != "in_progress":
            return "only the active annotator can submit"
        out = self._credit(p, a, p.image_count or p.progress_count, True)
        if isinstance(out, str):
            return out
        out += self._close(p, a)
        p.status = "submitted"
        p.progress_count = p.image_count or p.progress_count
        return out

    def _rework(self, a, p: Part) -> list[dict] | str:
        if p.annotator != a.actor or p.status != "rework":
            return "only the assigned annotator can start rework"
        p.status = "in_progress"
        self._open(p, a)
        return []

    def _review(self, a, p: Part, status: str, kind: str) -> list[dict] | str:
        if a.actor not in self.reviewers:
            return "only a reviewer can review"
        if p.status != "submitted":
            return "only a submitted part can be reviewed"
        p.status = status
        return [self._comment(p, a, kind)]

    def _approve(self, a, p: Part) -> list[dict] | str:
        return self._review(a, p, "completed", "review_approve")

    def _reject(self, a, p: Part) -> list[dict] | str:
        return self._review(a, p, "rework", "review_rework")


ACTIONS = ("claim", "pause", "resume", "return", "progress", "submit", "rework", "approve", "reject")


def _start(key: int, rows: pd.DataFrame) -> Task:
    """A task as its rows of parts say."""
    first = rows.iloc[0]
    task = Task(int(key), sorted({r for r in first["reviewers"] if r}))
    for r in rows.sort_values("part_index").itertuples(index=False):
        given = {c: kind(v) for c, kind in STATE.items() if (v := getattr(r, c, None)) is not None and v == v}
        task.parts[int(r.part_id)] = Part(int(r.part_id), **given)
    return task


def _frame(rows: list[dict]) -> pd.DataFrame:
    held = {c: [r.get(c) for r in rows] for c in COLUMNS} | {"seq": list(range(len(rows)))}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in held.items()})


def _held(task: Task) -> list[dict]:
    """The rows of a task's parts, and of the sessions that are still open."""
    out = []
    for p in task.parts.values():
        out.append({"kind": "part", "task_id": task.task_id, "part_id": p.part_id, "status": p.status, "annotator": p.annotator, "work_seconds": p.work_seconds, "progress_count": p.progress_count, "started": p.opened, "credited": p.credited, "is_final": p.final, "part_index": p.part_index, "image_count": p.image_count})
        if p.opened is not None:
            out.append({"kind": "session", "task_id": task.task_id, "part_id": p.part_id, "annotator": p.annotator, "started": p.opened})
    return out


def replay(actions: DataFrame, tasks: DataFrame, parts: DataFrame) -> dict[str, DataFrame]:
    """parts, sessions, events, comments, rejects and state after the actions, each task's in order of time and id.

    actions: (action_id, task_id, part_id, actor, action, value, ts); a claim has no part: it takes the first pending one. tasks:
    (task_id, publisher, manager, applicant); these three may review. parts: (part_id, task_id, part_index, image_count), pending
    at first; or the ``state`` of an earlier replay, from which later actions go on: what both give together is what the whole log
    gives, but for sessions that the first leaves open, which the second gives again with their ends. An illegal action changes nothing and is a reject with its reason; actions on unknown tasks are rejects, too. Claims
    depend on all parts of a task, so a task, some thousand parts at most, is folded
    in one place, its actions batch by batch: what is held are its parts and a batch. It is folded once and stored.
    """
    who = F.array(*[F.col(c).cast("string") for c in ("publisher", "manager", "applicant") if c in tasks.columns])
    own = parts.join(tasks.select("task_id", who.alias("reviewers")), "task_id").select("task_id", "part_id", *[c for c in STATE if c in parts.columns], "reviewers")
    log = actions.select("task_id", "action_id", F.col("part_id").cast("double").alias("part_id"), "actor", "action", F.col("value").cast("double").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))

    # A task's parts come first, then its actions in order, all in one task of Spark, which reads them batch by batch.
    key = [F.coalesce("task_id", F.lit(0).cast("bigint")).alias("task_id"), F.col("task_id").isNull().alias("nameless")]
    have = [c for c in STATE if c in parts.columns]
    first = own.select(*key, F.lit(False).alias("acts"), F.lit(0).cast("bigint").alias("action_id"), F.col("part_id").cast("bigint").alias("own_id"), *have, "reviewers")
    rest = log.select(*key, F.lit(True).alias("acts"), F.col("action_id").cast("bigint").alias("action_id"), F.lit(0).cast("bigint").alias("own_id"), "part_id", "actor", "action", "value", "at")
    ordered = first.unionByName(rest, allowMissingColumns=True).repartition("task_id", "nameless").sortWithinPartitions("task_id", "nameless", "acts", F.asc_nulls_last("at"), "action_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, task, given = None, None, []  # the key, its task once its actions begin, and till then its rows of parts

        def begun() -> Task | None:
            return _start(now[0], pd.concat(given, ignore_index=True)) if given else None

        def ended() -> list[dict]:
            return _held(task or begun()) if task or given else []

        for f in batches:
            out = []
            at = f[["task_id", "nameless", "acts"]].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(f)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                rows, here = f.iloc[lo:hi], (int(at[lo][0]), bool(at[lo][1]))
                if here != now:
                    out += ended()
                    now, task, given = here, None, []
                if not at[lo][2]:
                    given.append(rows.drop(columns="part_id").rename(columns={"own_id": "part_id"}))
                    continue
                task, given = task or begun(), []
                rows = rows[["action_id", "part_id", "actor", "action", "value", "at"]]
                if task is None:
                    out += [{"kind": "reject", "action_id": a.action_id, "task_id": None if here[1] else here[0], "actor": a.actor, "at": a.at, "note": "unknown task"} for a in rows.itertuples(index=False)]
                    continue
                for a in rows.itertuples(index=False):
                    out += task.do(a)
            yield _frame(out)
        yield _frame(ended())

    every = stored(ordered.mapInPandas(fold, OUT))
    moment = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))
    of = lambda kind: every.where(F.col("kind") == kind)
    return {
        "parts": of("part").select("task_id", "part_id", "status", "annotator", "work_seconds", "progress_count"),
        "state": of("part").select("task_id", "part_id", "part_index", "image_count", "status", "annotator", "work_seconds", "progress_count", F.col("started").alias("opened"), "credited", F.col("is_final").alias("final")),
        "sessions": of("session").select("task_id", "part_id", "annotator", moment("started").alias("started_at"), moment("ended").alias("ended_at")),
        "events": of("event").select("action_id", "task_id", "part_id", "annotator", moment("at").alias("submitted_at"), "cumulative", "credited", "is_final"),
        "comments": of("comment").select("action_id", "task_id", "part_id", "actor", moment("at").alias("created_at"), F.col("status").alias("kind")),
        "rejects": of("reject").select("action_id", "task_id", "part_id", "actor", F.col("note").alias("reason")),
    }


def replay_stream(actions: DataFrame) -> DataFrame:
    """The same fold as a stream: sessions, events, comments and rejects as they come, with a task's parts as its state.

    actions carry their task's ``task_parts`` (array of part_id, part_index, image_count) and ``reviewers`` (array), as joined from
    the tables; the first batch of a task counts. Within a batch a task's actions go by time and id.
    """
    log = actions.select("task_id", "action_id", F.col("part_id").cast("double").alias("part_id"), "actor", "action", F.col("value").cast("double").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.to_json("task_parts").alias("own"), F.to_json("reviewers").alias("who"))

    return with_state(log, "task_id", FoldTask(), OUT)


class FoldTask(StatefulProcessor):
    """State of a task: ``parts``, a row of named columns for each, and ``reviewers``. Only parts that an action changed are written again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part_id bigint", STATE_SCHEMA)
        self.reviewers = handle.getListState("reviewers", "name string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        f = together(rows).sort_values(["at", "action_id"], kind="stable")
        task = Task(int(key[0]), [r[0] for r in self.reviewers.get()] if self.reviewers.exists() else [])
        if self.parts.exists():
            task.parts = {k: Part(k, *v) for (k,), v in sorted(self.parts.iterator(), key=lambda x: x[1][0])}
            before = {k: replace(p) for k, p in task.parts.items()}
        else:
            task.reviewers = sorted({r for r in json.loads(f["who"].iloc[0]) if r})
            for p in json.loads(f["own"].iloc[0]):
                task.parts[p["part_id"]] = Part(p["part_id"], p["part_index"], p.get("image_count") or 0)
            if task.reviewers:
                self.reviewers.put([(r,) for r in task.reviewers])
            before = {}
        out = [row for a in f.itertuples(index=False) for row in task.do(a)]
        for k, p in task.parts.items():
            if before.get(k) != p:
                self.parts.updateValue((k,), tuple(None if (v := getattr(p, c)) is None else kind(v) for c, kind in STATE.items()))
        if out:
            yield _frame(out)


def paired_sessions(actions: DataFrame, start: list[str], stop: list[str]) -> DataFrame:
    """(part_id, actor, started_at, ended_at, seconds): each start with the next stop of its part, null where none has come. Seconds are the difference of the two in seconds of the epoch, as SQL's ``epoch`` gives them."""
    w = Window.partitionBy("part_id").orderBy("ts", "action_id")
    rows = actions.where(F.col("action").isin(*start, *stop)).withColumns({"next": F.lead("action").over(w), "until": F.lead("ts").over(w)})
    ends = F.when(F.col("next").isin(*stop), F.col("until"))
    rows = rows.where(F.col("action").isin(*start)).select("part_id", "actor", F.col("ts").alias("started_at"), ends.alias("ended_at"))
    epoch = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return rows.withColumn("seconds", epoch("ended_at") - epoch("started_at"))


MOST_SECONDS, MOST_COUNT = 31 * 86400, 2**53 - 1


def validate_edits(edits: DataFrame, parts: DataFrame, tasks: DataFrame, users: DataFrame, credited: DataFrame) -> DataFrame:
    """The edits (edit_id, part_id, actor, and name, work_path, image_count, progress_count, bbox_count, work_seconds, null where not meant) with ``reason``, null if the edit is allowed.

    Publisher, applicant and admins may edit all but progress, which only the part's annotator may; the annotator also its box
    count while the part is open to them. A total below what is credited, and values out of bounds, are refused.
    """
    admins = users.where((F.col("role") == "admin") & F.col("is_active")).select(F.col("username").alias("actor"), F.lit(True).alias("admin")).distinct()
    owner = [c for c in ("publisher", "applicant") if c in tasks.columns]
    rows = edits.join(parts.select("part_id", "task_id", "annotator", "status"), "part_id", "left").join(tasks.select("task_id", *owner), "task_id", "left")
    rows = rows.join(admins, "actor", "left").join(credited.select("part_id", "credited"), "part_id", "left")
    owns = F.coalesce(F.col("admin"), F.lit(False))
    for c in owner:
        owns = owns | F.coalesce(F.col(c) == F.col("actor"), F.lit(False))
    mine = F.coalesce(F.col("annotator") == F.col("actor"), F.lit(False))
    open_ = F.col("status").isin("in_progress", "paused", "rework", "submitted")
    has = lambda c: F.col(c).isNotNull()
    reason = (
        F.when(F.col("task_id").isNull(), "unknown part").when(has("work_seconds") & ~F.col("work_seconds").between(0, MOST_SECONDS), "work_seconds").when(has("work_seconds") & ~owns, "permission")
        .when(has("bbox_count") & ~F.col("bbox_count").between(0, MOST_COUNT), "bbox_count").when(has("bbox_count") & ~owns & ~(mine & open_), "permission")
        .when(~owns & (has("name") | has("work_path") | has("image_count")), "permission").when(owns & has("image_count") & (F.col("image_count") < F.coalesce("credited", F.lit(0))), "image_count")
        .when(has("progress_count") & ~mine, "permission")
    )
    return rows.select(*edits.columns, reason.alias("reason"))


def apply_edits(parts: DataFrame, validated: DataFrame) -> DataFrame:
    """The parts after the allowed edits, the last one of a part by edit_id for each field; counts are held to 0 at least."""
    fields = [c for c in ("name", "work_path", "image_count", "progress_count", "bbox_count", "work_seconds") if c in validated.columns]
    last = validated.where("reason is null").groupBy("part_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_id"))).alias(f"__{c}") for c in fields])
    target = {"work_seconds": "work_seconds_override"}
    out = parts.join(last, "part_id", "left")
    for c in fields:
        new = F.greatest(F.col(f"__{c}"), F.lit(0)) if c in ("image_count", "progress_count") else F.trim(F.col(f"__{c}")) if c in ("name", "work_path") else F.col(f"__{c}")
        at = target.get(c, c)
        if at in parts.columns:
            out = out.withColumn(at, F.coalesce(F.when(F.col(f"__{c}").isNotNull(), new), F.col(at)).cast(parts.schema[at].dataType))
    return out.select(*parts.columns)


def daily_snapshot(tasks: DataFrame, estimates: DataFrame, date: str) -> DataFrame:
    """The day's rows of the tasks that aren't completed, with their estimates: one partition, written over whenever the job runs again."""
    return tasks.where(~F.col("deleted") & (F.col("status") != "completed")).join(estimates, "task_id", "left").withColumn("report_date", F.lit(date).cast("date"))


def write_snapshot(tasks: DataFrame, estimates: DataFrame, now: str, path: str) -> bool:
    """Writes the snapshot that is due at ``now`` (a moment with its zone) to its date's partition under path; False where it is before 18:00 or the date has one. The folder of the date is what says so, and a run that was cut off left none: it is written elsewhere and moved when it is whole."""
    spark = tasks.sparkSession
    runs = spark.createDataFrame([(now,)], "now string").select(F.col("now").cast("timestamp").alias("now"))
    due = changes.due_runs(runs).first()
    if due is None:
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{path}/report_date={due['report_date']}")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        return False
    part = hadoop(f"{path}/_writing-{uuid.uuid4().hex}")
    daily_snapshot(tasks, estimates, str(due["report_date"])).drop("report_date").write.parquet(part.toString())
    files.mkdirs(at.getParent())
    if not files.rename(part, at):  # another run was first
        files.delete(part, True)
        return False
    return True


def visible_counts(snapshot: DataFrame, users: DataFrame) -> DataFrame:
    """(username, tasks): of each active account the tasks that it sees: all for admins, those that it published or manages for others."""
    roles = [c for c in ("publisher", "manager") if c in snapshot.columns]
    named = snapshot.select("task_id", F.explode(F.array_distinct(F.array_compact(F.array(*roles)))).alias("username")).groupBy("username").agg(F.count("*").alias("own"))
    total = snapshot.agg(F.count("*").alias("every"))
    rows = users.where("is_active").join(named, "username", "left").join(F.broadcast(total))
    return rows.select("username", F.when(F.col("role") == "admin", F.col("every")).otherwise(F.coalesce("own", F.lit(0))).alias("tasks"))
