"""Reports over work-management tables: users, tasks, parts, sessions, submission events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ordering import numbered

STATUSES = ["pending", "in_progress", "paused", "submitted", "rework", "completed"]
#: Fixed value: the name of tasks without a tag in the window report.
UNTAGGED = "未分类"


def elapsed(start: Column, end: Column) -> Column:
    """Seconds from start to end, 0 where they run backwards or one is missing."""
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(F.greatest((micros(end) - micros(start)) / 1e6, F.lit(0.0)), F.lit(0.0))


def part_summary(parts: DataFrame) -> DataFrame:
    """Per task: count of each status, total, annotated."""
    counts = parts.groupBy("task_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))
    return counts.withColumn("annotated", F.col("submitted") + F.col("completed"))


def actor_part_summary(parts: DataFrame) -> DataFrame:
    own = parts.where(F.col("annotator").isNotNull())
    return own.groupBy("task_id", "annotator").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "rework").alias("rework"), F.count_if(F.col("status") == "in_progress").alias("in_progress"))


def task_overview(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Per live task its counts, state and completion percent; parts are counted before they meet the tasks."""
    s = tasks.where(~F.col("deleted")).select("task_id", "project").join(part_summary(parts), "task_id", "left").fillna(0, [*STATUSES, "total", "annotated"])
    total = F.col("total")
    state = (
        F.when(total == 0, "awaiting_parts").when(F.col("completed") == total, "completed").when(F.col("pending") == total, "pending")
        .when(F.col("submitted") + F.col("completed") == total, "submitted").when(F.col("in_progress") + F.col("paused") + F.col("rework") > 0, "in_progress").otherwise("mixed")
    )
    percent = F.when(total > 0, F.round(F.col("completed") * 100.0 / total, 1)).otherwise(0.0)
    return s.select("task_id", "project", *STATUSES, "total", state.alias("state"), percent.alias("completion_percent"))


def annotator_statistics(parts: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Per task and annotator: counts and boxes by the part's annotator; seconds by the session's, but a part's override by its own annotator in the sessions' place."""
    own = parts.where(F.col("annotator").isNotNull())
    done = F.col("status").isin("submitted", "completed")
    counts = own.groupBy("task_id", "annotator").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.sum(F.when(done, F.coalesce("bbox_count", F.lit(1))).otherwise(0)).alias("boxes"),
        F.sum(F.greatest("progress_count", F.lit(0))).alias("images"), F.sum(F.coalesce("work_seconds_override", F.lit(0.0))).alias("override_seconds"),
    )
    worked = sessions.join(parts.where(F.col("work_seconds_override").isNull()).select("part_id", "task_id"), "part_id")
    seconds = worked.groupBy("task_id", "annotator").agg(F.sum(elapsed(F.col("started_at"), F.coalesce("ended_at", now))).alias("session_seconds"))
    out = counts.join(seconds, ["task_id", "annotator"], "full").fillna(0)
    total = F.round(F.col("override_seconds") + F.col("session_seconds"), 3)
    rate = lambda c: F.when(total > 0, F.round(F.col(c) * 3600 / total, 3)).otherwise(0.0)
    return out.select("task_id", "annotator", *STATUSES, "boxes", "images", total.alias("seconds"), rate("boxes").alias("boxes_per_hour"), rate("images").alias("images_per_hour"))


def task_statistics(statistics: DataFrame) -> DataFrame:
    """Task totals of annotator_statistics."""
    return statistics.groupBy("task_id").agg(*[F.sum(c).alias(c) for c in (*STATUSES, "boxes", "images", "seconds")], F.count("*").alias("annotators"))


def overlap_join(sessions: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """Sessions that reach into [start, end), with the seconds that lie in it. The window is one row, so its bounds are literals of a filter that the scan takes."""
    stop = F.coalesce("ended_at", now)
    return sessions.where((F.col("started_at") < end) & (stop > start)).withColumn("clipped_seconds", elapsed(F.greatest("started_at", start), F.least(stop, end)))


def admin_statistics(tasks: DataFrame, parts: DataFrame, sessions: DataFrame, users: DataFrame, start: Column, end: Column, now: Column) -> DataFrame:
    """The window report by grouping sets: total, per user, per user and task, per tag; every account has a row.

    A part counts if it was completed in the window or worked on in it; its clipped sessions go to its current annotator, and an
    override takes their place only if it was completed.
    """
    clipped = overlap_join(sessions, start, end, now).groupBy("part_id").agg(F.sum("clipped_seconds").alias("clipped"))
    live = tasks.where(~F.col("deleted")).select("task_id", F.coalesce(F.nullif("product_tag", F.lit("")), F.lit(UNTAGGED)).alias("tag"))
    p = parts.join(live, "task_id").join(clipped, "part_id", "left").where(F.col("annotator").isNotNull())
    completed = F.coalesce((F.col("submitted_at") >= start) & (F.col("submitted_at") < end), F.lit(False))
    p = p.withColumn("completed", completed).withColumn("seconds", F.when(F.col("completed") & F.col("work_seconds_override").isNotNull(), F.col("work_seconds_override")).otherwise(F.coalesce("clipped", F.lit(0.0))))
    p = p.where(F.col("completed") | (F.coalesce("clipped", F.lit(0.0)) > 0))
    boxed = F.col("completed") & F.col("status").isin("submitted", "completed")
    facts = p.select(
        "annotator", "task_id", "tag", F.col("completed").cast("int").alias("done"), F.when(F.col("completed"), F.greatest("progress_count", F.lit(0))).otherwise(0).alias("images"),
        F.when(boxed, F.coalesce("bbox_count", F.lit(1))).otherwise(0).alias("boxes"), "seconds",
    )
    # Facts are summed for each person and task first, so that the sets and the distinct tasks see few rows; a task has one tag.
    facts = facts.groupBy("annotator", "task_id", "tag").agg(F.count("*").alias("parts"), *[F.sum(c).alias(c) for c in ("done", "images", "boxes", "seconds")])
    sets = facts.groupingSets([[F.col("annotator")], [F.col("annotator"), F.col("task_id")], [F.col("tag")], []], "annotator", "task_id", "tag").agg(
        F.grouping_id().alias("level"), F.sum("parts").alias("parts"), F.sum("done").alias("completed"), F.sum("images").alias("images"), F.sum("boxes").alias("boxes"), F.round(F.sum("seconds"), 3).alias("seconds"), F.count_distinct("task_id").alias("tasks"),
    )
    names = {3: "user", 1: "user_task", 6: "tag", 7: "total"}
    kind = F.create_map(*[F.lit(x) for k in names.items() for x in k])
    sets = sets.select(F.element_at(kind, F.col("level").cast("int")).alias("kind"), "annotator", "task_id", "tag", "parts", "completed", "images", "boxes", "seconds", "tasks")
    idle = users.select(F.col("username").alias("annotator")).join(facts.select("annotator").distinct(), "annotator", "left_anti")
    zero = lambda t: F.lit(0).cast(t)
    idle = idle.select(F.lit("user").alias("kind"), "annotator", F.lit(None).cast("bigint").alias("task_id"), F.lit(None).cast("string").alias("tag"), *[zero("bigint").alias(c) for c in ("parts", "completed", "images", "boxes")], zero("double").alias("seconds"), zero("bigint").alias("tasks"))
    return sets.unionByName(idle)


def credit_ledger(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Credit is what a cumulative count adds to the part's high-water mark, and 0 after a final event; before one a lower count is rejected. A progress event that adds nothing isn't stored."""
    before = Window.partitionBy("part_id").orderBy("submitted_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = submissions.withColumns({"high": F.coalesce(F.max("cumulative").over(before), F.lit(0)), "finalised": F.coalesce(F.max("is_final").over(before), F.lit(False))})
    credited = F.when(F.col("finalised"), F.lit(0)).otherwise(F.greatest(F.col("cumulative") - F.col("high"), F.lit(0))).cast("bigint")
    rows = rows.withColumn("credited", credited)
    low = ~F.col("finalised") & (F.col("cumulative") < F.col("high"))
    events = rows.where(~low & (F.col("is_final") | (F.col("credited") > 0)))
    return events.drop("high", "finalised"), rows.where(low).drop("high", "finalised", "credited")


def submission_state(events: DataFrame) -> DataFrame:
    return events.groupBy("part_id").agg(F.sum("credited").alias("credited"), F.bool_or("is_final").alias("finalised"))


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday at UTC+8."""
    return F.weekday(F.from_utc_timestamp(ts, "Asia/Shanghai")) >= 5


def production_report(events: DataFrame, users: DataFrame, start: Column, end: Column, workdays_only: bool = False) -> DataFrame:
    """Credit per user in [start, end), with what weekends would have added; every account has a row."""
    rows = events.where((F.col("submitted_at") >= start) & (F.col("submitted_at") < end))
    off = is_weekend(F.col("submitted_at")) if workdays_only else F.lit(False)
    sums = rows.groupBy(F.col("annotator").alias("username")).agg(F.sum(F.when(off, 0).otherwise(F.col("credited"))).alias("credited"), F.sum(F.when(off, F.col("credited")).otherwise(0)).alias("excluded"), F.count_if(~off).alias("events"))
    return users.select("username", "display_name").join(sums, "username", "left").fillna(0, ["credited", "excluded", "events"])


def production_tasks(events: DataFrame, start: Column, end: Column, workdays_only: bool = False) -> DataFrame:
    """(annotator, task_id, name, image_count, first): credit in [start, end) by person, task and name, without imported events.

    events: event_id, annotator, submitted_at, credited, event_kind, task_id, task_name, project. A task's name is the first of name,
    project and id that isn't empty. Events without credit make no task. ``first`` numbers a person's names in the order in
    which they came, the same for all tasks of a name.
    """
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    name = F.coalesce(given("task_name"), given("project"), F.col("task_id").cast("string"))
    rows = events.where((F.col("event_kind") != "legacy_import") & (F.col("submitted_at") >= start) & (F.col("submitted_at") < end) & (F.col("credited") > 0))
    if workdays_only:
        rows = rows.where(~is_weekend(F.col("submitted_at")))
    place = F.struct("submitted_at", "event_id")
    sums = rows.withColumn("name", name).groupBy("annotator", "task_id", "name").agg(F.sum("credited").alias("image_count"), F.min(place).alias("at"))
    named = sums.withColumn("at", F.min("at").over(Window.partitionBy("annotator", "name")))
    first = F.dense_rank().over(Window.partitionBy("annotator").orderBy("at", "name"))
    return named.select("annotator", "task_id", "name", "image_count", first.alias("first"))


def production_summary(events: DataFrame, start: Column, end: Column, since: Column, workdays_only: bool = False) -> DataFrame:
    """One row: image_count, excluded_weekend_count, legacy_parts_excluded (imported events of all times) and includes_untracked_time (whether start lies before ``since``)."""
    own = (F.col("event_kind") != "legacy_import") & (F.col("submitted_at") >= start) & (F.col("submitted_at") < end)
    off = is_weekend(F.col("submitted_at")) if workdays_only else F.lit(False)
    total = lambda when: F.coalesce(F.sum(F.when(own & when, F.col("credited"))), F.lit(0)).cast("bigint")
    return events.agg(total(~off).alias("image_count"), total(off).alias("excluded_weekend_count"), F.count_if(F.col("event_kind") == "legacy_import").alias("legacy_parts_excluded"), (start < since).alias("includes_untracked_time"))


def attendance(sessions: DataFrame, first_day: str, days: int) -> DataFrame:
    """Check-ins per day: the first start of each user and day; days without any have zero."""
    calendar = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days - 1))).alias("day"))
    first = sessions.groupBy(F.to_date("started_at").alias("day"), "annotator").agg(F.min("started_at").alias("checked_in"))
    return calendar.join(first.groupBy("day").agg(F.count("*").alias("check_ins"), F.min("checked_in").alias("earliest")), "day", "left").fillna(0, ["check_ins"])


def normalize_ranks(tasks: DataFrame) -> DataFrame:
    """The active tasks, neither deleted nor completed, with ``new_rank``: all together by rank, later update, larger id, numbered from 1; ``changed`` where the number is new."""
    active = tasks.where(~F.col("deleted") & (F.col("status") != "completed"))
    out = numbered(active, [F.asc("rank"), F.desc("updated_at"), F.desc("task_id")], "new_rank")
    return out.withColumn("new_rank", F.col("new_rank").cast("int")).withColumn("changed", ~F.col("new_rank").eqNullSafe(F.col("rank")))


def move_rank(ranked: DataFrame, task_id: int | str, k: int) -> tuple[DataFrame, DataFrame]:
    """(tasks with moved_rank, audit rows): of the tasks that normalize_ranks numbered, one goes to place min(k, n) and the others close up around it. A completed task isn't among them, which is an error."""
    here = ranked.where(F.col("task_id") == task_id).select("new_rank").first()
    if here is None:
        raise ValueError("only an active task has a rank")
    if not 1 <= k <= 1_000_000_000:
        raise ValueError("rank is out of range")
    place = min(k, ranked.count())
    rest = F.col("new_rank") - (F.col("new_rank") > here[0]).cast("int")
    moved = F.when(F.col("task_id") == task_id, F.lit(place)).otherwise(rest + (rest >= place).cast("int")).cast("int")
    out = ranked.withColumn("moved_rank", moved)
    audit = out.where("moved_rank <> new_rank").select("task_id", F.lit("update_ordering").alias("action"), F.lit("rank").alias("field"), F.col("new_rank").cast("string").alias("old"), F.col("moved_rank").cast("string").alias("new"))
    return out, audit


def working_day(start: Column, n: Column) -> Column:
    """The n-th weekday from start on, which counts if it is one itself. It is counted in whole weeks, so a far day costs what a near one does."""
    day = F.weekday(start)
    monday = F.date_sub(start, day)
    # Places among the weekdays from that Monday on: a weekend's first weekday is the sixth.
    place = F.least(day, F.lit(5)) + n.cast("int") - 1
    return F.when(n > 0, F.date_add(monday, (F.floor(place / 5) * 7 + F.pmod(place, F.lit(5))).cast("int")))


def _number(text: Column) -> Column:
    """A whole text as a number, null where it is none; ranges are none."""
    return text.cast("string").try_cast("double")


def task_hours(tasks: DataFrame) -> Column:
    """The estimated hours; where there are none, amount over hourly capacity, of which the amount may have thousands' commas; else 0."""
    given = F.greatest(F.coalesce(_number(F.col("estimated_hours")), F.lit(0.0)), F.lit(0.0))
    amount, hourly = _number(F.replace(F.col("data_amount").cast("string"), F.lit(","), F.lit(""))), _number(F.col("hourly_capacity"))
    return F.when(given != 0, given).otherwise(F.coalesce(F.when(hourly > 0, amount / hourly), F.lit(0.0)))


def schedule(tasks: DataFrame, completed: DataFrame, people: int, today: str) -> DataFrame:
    """All live tasks in rank order (0 and null last), then update and id: hours add up over the whole list, days are the sum over eight hours a person, at least one, and the date is that working day.

    Completed tasks take no time and have no date; nor has one without hours. The rows come by date, those without one last,
    then rank and id.
    """
    rank = F.when(F.coalesce("rank", F.lit(0)) != 0, F.col("rank")).otherwise(1_000_000_000)
    rows = tasks.where(~F.col("deleted")).join(completed.select("task_id", "done"), "task_id", "left")
    rows = rows.select("task_id", rank.alias("place"), "updated_at", F.coalesce("done", F.lit(False)).alias("done"), task_hours(tasks).alias("hours"))
    takes = F.when(F.col("done"), 0.0).otherwise(F.col("hours"))
    rows = numbered(rows, [F.asc("place"), F.asc("updated_at"), F.asc("task_id")], "n", takes, "cumulative_hours")
    days = F.when(~F.col("done") & (F.col("hours") > 0) & F.lit(people > 0), F.greatest(F.ceil(F.round(F.col("cumulative_hours") / (people * 8), 9)), F.lit(1)).cast("int"))
    rows = rows.withColumn("days", days).withColumn("due", working_day(F.lit(today).cast("date"), F.col("days")))
    return rows.orderBy(F.asc_nulls_last("due"), "place", "task_id").select("task_id", "hours", "cumulative_hours", "days", "due")


def period_bounds(ts: Column, period: str) -> tuple[Column, Column]:
    """The first day of a moment's day, week (from Tuesday on) or month, and of the next one, at UTC+8."""
    day = F.to_date(F.from_utc_timestamp(ts, "Asia/Shanghai"))
    if period == "day":
        return day, F.date_add(day, 1)
    if period == "week":
        return week_start(ts), F.date_add(week_start(ts), 7)
    if period == "month":
        first = F.trunc(day, "month")
        return first, F.add_months(first, 1)
    raise ValueError("a period is a day, a week or a month")


def week_start(ts: Column) -> Column:
    """The Tuesday on which the reporting week of a moment begins, at UTC+8."""
    day = F.to_date(F.from_utc_timestamp(ts, "Asia/Shanghai"))
    return F.date_sub(day, F.pmod(F.weekday(day) - 1, F.lit(7)))


def time_deviation(parts: DataFrame, tasks: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Effective seconds against the task's expectation; flagged from half of it on."""
    running = sessions.where(F.col("ended_at").isNull()).groupBy("part_id").agg(F.max_by("started_at", "session_id").alias("open_since"))
    rows = parts.join(tasks.select("task_id", "expected_part_seconds"), "task_id").join(running, "part_id", "left")
    effective = F.coalesce("work_seconds_override", F.col("work_seconds") + elapsed(F.col("open_since"), now))
    rows = rows.withColumn("effective_seconds", effective)
    deviation = F.when(F.col("expected_part_seconds") > 0, F.round((F.col("effective_seconds") - F.col("expected_part_seconds")) / F.col("expected_part_seconds"), 4))
    return rows.withColumn("deviation", deviation).select("part_id", "task_id", "effective_seconds", "deviation", F.coalesce(F.abs("deviation") >= 0.5, F.lit(False)).alias("flagged"), F.col("status").isin("paused", "submitted", "rework", "completed").alias("reviewable"))


def task_order(tasks: DataFrame, completed: DataFrame) -> DataFrame:
    """The task list's order: completed last, then rank, later update, larger id."""
    rows = tasks.where(~F.col("deleted")).join(completed.select("task_id", "done"), "task_id", "left")
    return rows.orderBy(F.coalesce("done", F.lit(False)), "rank", F.desc("updated_at"), F.desc("task_id"))


def page(df: DataFrame, order_by: list[Column | str], number: int, size: int) -> tuple[DataFrame, int]:
    """(the page's rows, all rows); a number past the end gives the last page. Sizes are held to 1..100."""
    size = min(max(size, 1), 100)
    total = df.count()
    number = min(max(number, 1), max(1, -(-total // size)))
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size), total


def next_pending(parts: DataFrame) -> DataFrame:
    """Per task the first pending part by index."""
    return parts.where(F.col("status") == "pending").groupBy("task_id").agg(F.min_by("part_id", F.struct("part_index", "part_id")).alias("part_id"))


def next_reminder(events: DataFrame) -> DataFrame:
    """The oldest pending event by its time and id; no row where none is pending."""
    return events.where(F.col("status") == "pending").orderBy("created_at", "event_id").limit(1)


def reopened(tasks: DataFrame, added: DataFrame) -> DataFrame:
    """Tasks (task_id, status, rank, deleted) after parts were added to those of ``added`` (task_id): they are in progress, and what was completed comes behind all that aren't, by task_id where several do. Deleted tasks stay as they are."""
    rows = tasks.join(added.select("task_id").distinct().withColumn("__new", F.lit(True)), "task_id", "left")
    new = F.coalesce("__new", F.lit(False)) & ~F.col("deleted")
    again = new & (F.col("status") == "completed")
    back = numbered(rows.where(again), [F.col("task_id")], "__place").select("task_id", "__place")
    active = rows.agg(F.count_if(~F.col("deleted") & (F.col("status") != "completed")).alias("__active"))
    out = rows.join(back, "task_id", "left").join(F.broadcast(active))  # one row
    rank = F.when(F.col("__place").isNotNull(), F.col("__active") + F.col("__place")).otherwise(F.col("rank")).cast(tasks.schema["rank"].dataType)
    return out.withColumn("rank", rank).withColumn("status", F.when(new, "in_progress").otherwise(F.col("status"))).select(*tasks.columns)


def page_after(df: DataFrame, order_by: list[str], last: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows (1 to 100) behind the row whose ``order_by`` values are ``last``, or the first ones: nothing is counted or skipped, so page after page costs the same. order_by should end with a key and hold no nulls."""
    if last is not None:
        df = df.where(F.struct(*order_by) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, last, strict=True)]))
    return df.orderBy(*order_by).limit(min(max(size, 1), 100))


def task_status(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """ready without parts, completed if all are, else in_progress."""
    s = parts.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("c"))
    rows = tasks.where(~F.col("deleted")).select("task_id").join(s, "task_id", "left")
    return rows.select("task_id", F.when(F.coalesce("n", F.lit(0)) == 0, "ready").when(F.col("n") == F.col("c"), "completed").otherwise("in_progress").alias("status"))


def fan_out(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Changes (change_id, publisher, manager) to one notification for each active user named."""
    named = changes.withColumn("username", F.explode(F.array_distinct(F.array_compact(F.array("publisher", "manager"))))).drop("publisher", "manager")
    return named.join(users.where("is_active").select("username"), "username")
