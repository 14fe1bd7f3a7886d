"""Changes of work records: differences, additions, deletions, histories, notifications and reminders."""

from __future__ import annotations

import ntpath
import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import work


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new): one row per field whose text differs between two snapshots; nulls are equal to each other."""
    b = before.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    a = after.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new")) for f in fields]))
    return b.join(a, key).select(key, each.alias("c")).select(key, "c.*").where(~F.col("old").eqNullSafe(F.col("new")))


def normal_path(p: str | None) -> str | None:
    if p is None:
        return None
    return ntpath.normcase(ntpath.normpath(p)) if "\\" in p or ntpath.splitdrive(p)[0] else posixpath.normpath(p)


def path_key(path: Column) -> Column:
    """Normalised paths, equal for names of one place: those with a backslash or a drive without case and with backslashes, others as they are written."""

    @F.pandas_udf("string")
    def key(paths: pd.Series) -> pd.Series:
        return paths.map(normal_path)

    return key(path)


def add_parts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``accepted`` and ``new_index``: accepted if its path is in no part of its task and is the first of its kind (by part_index) among the new ones; its index then goes on from the task's largest."""
    known = existing.select("task_id", path_key(F.col("path")).alias("key")).distinct().withColumn("known", F.lit(True))
    top = existing.groupBy("task_id").agg(F.max("part_index").alias("top"))
    keyed = new.withColumn("key", path_key(F.col("path")))
    place = F.row_number().over(Window.partitionBy("task_id", "key").orderBy("part_index"))
    marked = keyed.withColumn("place", place).join(known, ["task_id", "key"], "left").withColumn("accepted", F.col("known").isNull() & (F.col("place") == 1)).drop("key", "place", "known")
    nth = F.count_if("accepted").over(Window.partitionBy("task_id").orderBy("part_index").rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(top, "task_id", "left").withColumn("new_index", F.when(F.col("accepted"), F.coalesce("top", F.lit(0)) + nth)).drop("top")


def history(events: DataFrame, key: str, at: str, tie: str, fields: list[str]) -> DataFrame:
    """(key, events): each key's events in order, as an array of structs."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, tie, *fields))).alias("events"))


def status_changes(versions: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version, old, status) where a status differs from that of the version before; first versions are changes from null."""
    old = F.lag("status").over(Window.partitionBy(key).orderBy(version))
    return versions.select(key, version, old.alias("old"), "status").where(~F.col("old").eqNullSafe(F.col("status")))


def check_ins(sessions: DataFrame) -> DataFrame:
    """(annotator, day, checked_in_at): the first start of each person and day, at +08:00."""
    day = (F.col("started_at") + F.expr("interval 8 hours")).cast("date")
    return sessions.groupBy("annotator", day.alias("day")).agg(F.min("started_at").alias("checked_in_at"))


def reminders(rules: DataFrame, events: DataFrame, tasks: DataFrame, users: DataFrame) -> DataFrame:
    """(reminder_id, event_id, rule_id, username): whom each event reaches by the rules that are enabled for its kind.

    rules: rule_id, kind, task_id (null for a rule of all tasks), usernames, notify_publisher, notify_applicant, enabled; events:
    event_id, kind, task_id. A rule reaches its users and, if it says so, the task's publisher and applicant, each once, and of them
    those that are active and have a phone. A task's own rule doesn't hold at all where one of its users can't be reached. An event
    that comes twice under one id is one: reminder_id is the event's for a rule of all tasks, else the rule's is added to it.
    """
    reached = users.where(F.col("is_active") & (F.trim(F.coalesce("phone", F.lit(""))) != "")).select("username").distinct()
    live = rules.where("enabled")
    listed = live.where("task_id is not null").select("rule_id", F.explode("usernames").alias("username"))
    broken = listed.join(reached, "username", "left_anti").select("rule_id").distinct()
    told = ["rule_id", "usernames", "notify_publisher", "notify_applicant"]
    once = events.select("event_id", "kind", "task_id").distinct()
    own = once.join(live.where("task_id is not null").join(broken, "rule_id", "left_anti"), ["kind", "task_id"]).withColumn("reminder_id", F.concat(F.col("event_id").cast("string"), F.lit(":task-rule:"), F.col("rule_id")))
    # Rules for all tasks meet all events of their kind, which is their purpose: dealt over 64 keys, so that no key holds them all.
    every = live.where("task_id is null").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")))).drop("task_id")
    wide = once.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(64).cast("bigint"))).join(every, ["kind", "salt"]).withColumn("reminder_id", F.col("event_id").cast("string"))
    keep = ["reminder_id", "event_id", "task_id", *told]
    met = own.select(*keep).unionByName(wide.select(*keep)).join(tasks.select("task_id", "publisher", "applicant"), "task_id")
    others = F.array(F.when(F.col("notify_publisher"), F.col("publisher")), F.when(F.col("notify_applicant"), F.col("applicant")))
    names = F.array_distinct(F.array_compact(F.concat(F.coalesce("usernames", F.array().cast("array<string>")), others)))
    return met.select("reminder_id", "event_id", "rule_id", F.explode(names).alias("username")).distinct().join(reached, "username", "left_semi").select("reminder_id", "event_id", "rule_id", "username")


def task_notifications(before: DataFrame, after: DataFrame, users: DataFrame) -> DataFrame:
    """(task_id, kind, username) between two snapshots of tasks (task_id, publisher, manager, status, priority, deleted).

    A new task is told to its manager; a new priority, and a task's completion, to publisher and manager; another manager to
    the publisher and both managers. Each name once for a kind, active accounts only; deleted tasks and values that were or
    are null tell nothing.
    """
    old = before.select("task_id", *[F.col(c).alias(f"old_{c}") for c in ("manager", "status", "priority")], F.lit(True).alias("known"))
    rows = after.join(old, "task_id", "left")
    new = lambda c: (F.col(c) != F.col(f"old_{c}")) & ~F.col("deleted")
    tell = lambda kind, when, *names: F.when(when, F.transform(F.array_distinct(F.array_compact(F.array(*names))), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("username"))))
    none = F.array().cast("array<struct<kind:string,username:string>>")
    told = [
        tell("created", F.col("known").isNull(), "manager"), tell("priority", new("priority"), "publisher", "manager"),
        tell("completed", new("status") & (F.col("status") == "completed"), "publisher", "manager"), tell("manager", new("manager"), "publisher", "manager", "old_manager"),
    ]
    return rows.select("task_id", F.explode(F.concat(*[F.coalesce(t, none) for t in told])).alias("n")).select("task_id", "n.*").join(users.where("is_active").select("username"), "username", "left_semi").select("task_id", "kind", "username")


def mark_read(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """notifications (notification_id, username, created_at, read_at) after marks (username, notification_id, at), a notification_id of 0 standing for all that the person has by then; what was read keeps its time.

    The first mark that counts is found by one pass over a person's notifications and marks in the order of time.
    """
    single = marks.where("notification_id <> 0").join(notifications.select("username", "notification_id", "created_at"), ["username", "notification_id"])
    one = single.where("at >= created_at").groupBy("username", "notification_id").agg(F.min("at").alias("__one"))
    rows = notifications.join(one, ["username", "notification_id"], "left").withColumn("__at", F.col("created_at")).withColumn("__mark", F.lit(None).cast("timestamp"))
    every = marks.where("notification_id = 0").select("username", F.col("at").alias("__at"), F.col("at").alias("__mark"))
    # A mark of the same moment comes after what it marks.
    later = Window.partitionBy("username").orderBy("__at", F.col("__mark").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = rows.unionByName(every, allowMissingColumns=True).withColumn("__all", F.first("__mark", ignorenulls=True).over(later)).where("notification_id is not null")
    return both.withColumn("read_at", F.coalesce("read_at", F.least("__one", "__all"))).select(*notifications.columns)


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("username").agg(F.count_if(F.col("read_at").isNull()).alias("unread"), F.count("*").alias("notifications"))


def review_resets(before: DataFrame, after: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts whose review of times is void, as the expected seconds of their task changed; a null expectation is 0. Review columns, where there are any, are emptied."""
    value = lambda df, c: df.select("task_id", F.coalesce(F.col("expected_part_seconds").cast("double"), F.lit(0.0)).alias(c))
    changed = value(before, "a").join(value(after, "b"), "task_id").where("a <> b").select("task_id")
    gone = {"time_review_status": F.lit(""), "time_review_note": F.lit(""), "time_review_actor": F.lit(""), "time_reviewed_at": F.lit(None)}
    rows = parts.join(changed, "task_id", "left_semi")
    return rows.select(*[gone[c].cast(parts.schema[c].dataType).alias(c) if c in gone else F.col(c) for c in parts.columns])


def due_runs(runs: DataFrame, begins: str = "18:00", weekdays_only: bool = False, done: DataFrame | None = None) -> DataFrame:
    """(report_date, ran_at): of a job's runs (now) those that do their work: the first of each date, at +08:00, that isn't before ``begins``; on weekdays only, if it is so; and not on dates that ``done`` (report_date) has."""
    local = F.from_utc_timestamp("now", "Asia/Shanghai")
    due = F.date_format(local, "HH:mm") >= begins
    if weekdays_only:
        due = due & (F.weekday(local) < 5)
    out = runs.where(due).groupBy(local.cast("date").alias("report_date")).agg(F.min("now").alias("ran_at"))
    return out if done is None else out.join(done.select("report_date").distinct(), "report_date", "left_anti")


def soft_delete(tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active tasks with new ranks, audit rows): tasks are marked as deleted and the others ranked anew; columns as ``normalize_ranks``."""
    marked = tasks.join(gone.select("task_id").distinct().withColumn("gone", F.lit(True)), "task_id", "left")
    audit = marked.where("gone and not deleted").select("task_id", F.lit("delete_task").alias("action"), F.lit("deleted").alias("field"), F.lit("0").alias("old"), F.lit("1").alias("new"))
    return work.normalize_ranks(marked.withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).drop("gone")), audit


def reassign(tasks: DataFrame, parts: DataFrame, sessions: DataFrame, username: str, heir: str) -> dict[str, DataFrame]:
    """A person leaves: tasks, parts, sessions, audit and comments as they are then.

    Tasks that the person published go to ``heir``, who also manages them if the person did; other tasks that the person
    managed are managed by their publisher. Parts in progress, paused or in rework are open again, without times and
    sessions, and have a comment.
    """
    mine, managed = F.col("publisher") == username, F.coalesce(F.col("manager") == username, F.lit(False))
    publisher = F.when(mine, heir).otherwise(F.col("publisher"))
    after = tasks.withColumn("manager", F.when(managed & mine, heir).when(managed, F.col("publisher")).otherwise(F.col("manager"))).withColumn("publisher", publisher)
    row = lambda when, field, new: tasks.where(when).select("task_id", F.lit("delete_user").alias("action"), F.lit(field).alias("field"), F.lit(username).alias("old"), new.alias("new"))
    audit = row(mine, "publisher", F.lit(heir)).unionByName(row(managed & ~mine, "manager", F.col("publisher")))
    held = F.coalesce((F.col("annotator") == username) & F.col("status").isin("in_progress", "paused", "rework"), F.lit(False))
    freed = parts.where(held).select("part_id")
    cleared = {"status": F.lit("pending"), "annotator": F.lit(None), "work_seconds": F.lit(0.0)} | {c: F.lit(None) for c in ("submitted_at", "claimed_at", "reviewed_at")}
    kinds = dict(parts.dtypes)
    free = parts.select(*[F.when(held, cleared[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in cleared else F.col(c) for c in parts.columns])
    comments = freed.select("part_id", F.lit(heir).alias("actor"), F.lit("return").alias("kind"))
    return {"tasks": after, "parts": free, "sessions": sessions.join(freed, "part_id", "left_anti"), "audit": audit, "comments": comments}


def accumulated(sessions: DataFrame) -> DataFrame:
    """(part_id, sessions, open, seconds): closed intervals summed; ends before starts count nothing."""
    span = F.greatest(work.elapsed(F.col("started_at"), F.col("ended_at")), F.lit(0.0))
    return sessions.groupBy("part_id").agg(F.count("*").alias("sessions"), F.count_if(F.col("ended_at").isNull()).alias("open"), F.coalesce(F.sum(span), F.lit(0.0)).alias("seconds"))
