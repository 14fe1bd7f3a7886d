"""Further reports and row operators: estimates, settlements, listings, pages, samples of masks, validation of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import text as T
from trackloom.operators import work
from trackloom.operators.ordering import numbered
from trackloom.operators.tracking import fix_spikes


def task_estimate(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Per live task: total, annotated and remaining amount, hours left as a range, parts that wait for review.

    The total is the data amount if that is one number, else the sum of the parts' images if all have some. Estimates that
    can't be relied upon are null: submitted parts of unknown size, totals that disagree or are exceeded, rework.
    """
    images, done = F.greatest(F.coalesce("image_count", F.lit(0)), F.lit(0)), F.col("status").isin("submitted", "completed")
    raw, progress = F.coalesce("image_count", F.lit(0)), F.greatest(F.coalesce("progress_count", F.lit(0)), F.lit(0))
    sums = parts.groupBy("task_id").agg(
        F.count("*").alias("n"), F.sum(images).alias("known"), F.bool_and(raw > 0).alias("measured"), F.bool_and(done).alias("complete"),
        F.sum(F.when(done, raw).when(raw > 0, F.least(progress, raw)).otherwise(progress)).alias("annotated_amount"),
        F.bool_or((raw <= 0) & done).alias("unsized"), F.bool_or(F.col("status") == "rework").alias("rework"), F.count_if(F.col("status") == "submitted").alias("pending_review_parts"),
    )
    amount, capacity = T.numeric_range(F.col("data_amount")), T.numeric_range(F.col("hourly_capacity"))
    rows = tasks.where(~F.col("deleted")).select("task_id", amount.alias("a"), capacity.alias("c")).join(sums, "task_id", "left")
    rows = rows.fillna(0, ["n", "known", "annotated_amount", "pending_review_parts"]).fillna(False, ["measured", "complete", "unsized", "rework"])
    total = F.when(F.col("a.lo") == F.col("a.hi"), F.col("a.lo")).when(F.col("measured"), F.col("known").cast("double")).otherwise(0.0)
    rows = rows.withColumn("total", total)
    remaining = F.when(F.col("complete"), 0.0).when(F.col("total") > 0, F.greatest(F.col("total") - F.col("annotated_amount"), F.lit(0.0)))
    off = F.col("measured") & F.col("a").isNotNull() & (F.col("total") != F.col("known"))
    uncertain = (F.col("unsized") | off | ((F.col("total") > 0) & (F.col("total") < F.col("annotated_amount"))) | ((F.col("total") > 0) & (F.col("known") > F.col("total"))) | F.col("rework")) & ~F.col("complete")
    rows = rows.withColumns({"r": remaining, "uncertain": uncertain})
    sure = ~F.col("uncertain")
    hours = lambda side: F.when(sure, F.round(F.col("r") / F.col(f"c.{side}"), 2))
    return rows.select(
        "task_id", F.nullif("total", F.lit(0.0)).alias("total_amount"), "annotated_amount", F.when(sure, F.col("r")).alias("remaining_amount"),
        hours("hi").alias("least_hours"), hours("lo").alias("most_hours"), "pending_review_parts",
    )


def completion(tasks: DataFrame, parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of each completed live task its actual hours, null unless every part was tracked, and when it was completed, null unless every part has a time of review or submission."""
    tracked = sessions.select("part_id").distinct().withColumn("tracked", F.lit(True))
    seconds = F.coalesce("work_seconds_override", "work_seconds", F.lit(0.0))
    end = F.coalesce(*[F.col(c) for c in ("reviewed_at", "submitted_at") if c in parts.columns])
    rows = parts.join(tracked, "part_id", "left").groupBy("task_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("c"), F.sum(seconds).alias("s"), F.count_if(F.coalesce("tracked", F.lit(False)) | F.col("work_seconds_override").isNotNull()).alias("t"),
        F.count(end).alias("e"), F.max(end).alias("last"),
    )
    rows = rows.join(tasks.where(~F.col("deleted")).select("task_id"), "task_id").where("c = n")
    return rows.select("task_id", F.when(F.col("t") == F.col("n"), F.round(F.col("s") / 3600, 3)).alias("actual_hours"), F.when(F.col("e") == F.col("n"), F.col("last")).alias("completed_at"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, 0 if it begins with none."""
    return F.coalesce(F.nullif(F.regexp_extract(text.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def settlement_parts(tasks: DataFrame, parts: DataFrame, users: DataFrame, day: str) -> DataFrame:
    """The parts submitted on a day, by the date that their time is written with: who did them, expected and actual hours. A task's hours are shared by its parts alike."""
    counts = parts.groupBy("task_id").agg(F.count("*").alias("total"))
    est, cap, amount = (leading_number(F.col(c)) for c in ("estimated_hours", "hourly_capacity", "data_amount"))
    each = F.when((est > 0) & (F.col("total") > 0), est / F.col("total")).when(cap > 0, amount / cap / F.col("total")).otherwise(0.0)
    own = parts.where(F.substring(F.col("submitted_at").cast("string"), 1, 10) == day)
    rows = own.join(tasks.where(~F.col("deleted")).select("task_id", "product_tag", "project", "estimated_hours", "hourly_capacity", "data_amount"), "task_id").join(counts, "task_id")
    rows = rows.join(users.select(F.col("username").alias("annotator"), "display_name"), "annotator", "left")
    actual = F.coalesce("work_seconds_override", "work_seconds", F.lit(0.0)) / 3600
    return rows.select("part_id", F.col("annotator").alias("username"), F.coalesce("display_name", F.lit("")).alias("display_name"), "product_tag", "project", each.alias("expected_hours"), actual.alias("actual_hours"))


def settlement_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("parts"), F.round(F.coalesce(F.sum("expected_hours"), F.lit(0.0)), 3).alias("total_expected_hours"), F.round(F.coalesce(F.sum("actual_hours"), F.lit(0.0)), 3).alias("total_actual_hours"))


def daily_submissions(tasks: DataFrame, parts: DataFrame, last_day: str, days: int) -> DataFrame:
    """(day, parts) of the up to seven days that end at ``last_day``, zeros included."""
    days = max(1, min(days, 7))
    end = F.lit(last_day).cast("date")
    calendar = parts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    live = parts.join(tasks.where(~F.col("deleted")).select("task_id"), "task_id", "left_semi")
    counts = live.groupBy(F.substring(F.col("submitted_at").cast("string"), 1, 10).try_cast("date").alias("day")).agg(F.count("*").alias("parts"))
    return calendar.join(counts, "day", "left").fillna(0, ["parts"])


def day_status(checked: DataFrame, users: DataFrame, day: str) -> DataFrame:
    """(username, checked_in, checked_in_count) of each account on a day: (annotator, day) rows are check-ins."""
    own = checked.where(F.col("day") == F.lit(day).cast("date"))
    total = own.agg(F.count("*").alias("checked_in_count"))
    rows = users.select("username").join(own.select(F.col("annotator").alias("username"), F.lit(True).alias("checked_in")), "username", "left")
    return rows.join(F.broadcast(total)).select("username", F.coalesce("checked_in", F.lit(False)).alias("checked_in"), "checked_in_count")


#: The order of the review list.
REVIEW_ORDER = ["submitted", "rework", "in_progress", "paused", "pending"]


def review_page(parts: DataFrame, number: int, size: int, status: str | None = None, like: str | None = None) -> tuple[DataFrame, int]:
    """(a page of parts, all): submitted ones first, then rework, in progress, paused, pending and the rest. ``like`` is looked for in annotator and, if there are such columns, name and path, with the wildcards of LIKE."""
    rows = parts if status is None else parts.where(F.col("status") == status)
    if like:
        fields = [c for c in ("name", "annotator", "work_path") if c in parts.columns]
        found = F.lit(False)
        for c in fields:
            found = found | F.coalesce(F.col(c).ilike(f"%{like}%"), F.lit(False))
        rows = rows.where(found)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REVIEW_ORDER)), F.col("status")), F.lit(0).cast("bigint")), F.lit(len(REVIEW_ORDER) + 1).cast("bigint"))
    return work.page(rows, [place, F.col("task_id"), F.col("part_index"), F.col("part_id")], number, size)


def directory_page(tasks: DataFrame, parts: DataFrame, number: int, size: int, status: str | None = None, query: str = "", tag: str | None = None) -> tuple[DataFrame, int]:
    """(a page of live tasks' parts, all): ``query`` is looked for as it is, without case, in tag, project and annotator. A number past the end gives no rows; sizes are held to 1..200."""
    live = tasks.where(~F.col("deleted")).select("task_id", "product_tag", "project", "rank")
    rows = parts.join(live, "task_id")
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if tag is None else rows.where(F.col("product_tag") == tag)
    if query:
        low = F.lit(query.lower())
        rows = rows.where(F.contains(F.lower("product_tag"), low) | F.contains(F.lower("project"), low) | F.coalesce(F.contains(F.lower("annotator"), low), F.lit(False)))
    size = min(max(size, 1), 200)
    return rows.orderBy("rank", "task_id", "part_index", "part_id").offset((max(number, 1) - 1) * size).limit(size), rows.count()


def latest(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows: a top-k report."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def rank_completed(tasks: DataFrame) -> DataFrame:
    """(task_id, completed_at) with ``place``: by completion time, the newest first, then id."""
    return numbered(tasks.where(F.col("completed_at").isNotNull()), [F.desc("completed_at"), F.asc("task_id")], "place")


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("users"), F.count_if((F.col("role") == "admin") & F.col("is_active")).alias("active_admins"))


def list_users(users: DataFrame, active_only: bool = False) -> DataFrame:
    rows = users.where("is_active") if active_only else users
    return rows.orderBy(F.desc("role"), "username")


def throughput_warning(runs: DataFrame, floor: float = 0.5) -> DataFrame:
    """Runs (run, frames, seconds, batch) with ``slow``: enough frames to tell, max(8, 2 batch), and fewer a second than the floor."""
    enough = F.col("frames") >= F.greatest(F.lit(8), 2 * F.col("batch"))
    return runs.withColumn("slow", enough & (F.col("seconds") > 0) & (F.col("frames") / F.col("seconds") < floor))


def validate_job(files: DataFrame, answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(job, errors): files (job, kind) and answers (job) counted against expected (job, images); kinds are labels, annotations, copied."""
    counts = files.groupBy("job").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("labels", "annotations", "copied")])
    rows = expected.join(counts, "job", "left").join(answers.groupBy("job").agg(F.count("*").alias("answers")), "job", "left").fillna(0)
    wrong = [F.when(F.col(c) != F.col("images"), F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(" of "), F.col("images").cast("string"))) for c in ("labels", "annotations", "copied", "answers")]
    return rows.select("job", F.array_compact(F.array(*wrong)).alias("errors"))


def segment_listing(segments: DataFrame, frames: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Segments (video_id, segment) with has_result, frame_count, num_tracks and the number of anomalies of their results."""
    key = ["video_id", "segment"]
    f = frames.groupBy(*key).agg(F.count_distinct("frame_id").alias("frame_count"), F.count_distinct("track_id").alias("num_tracks"))
    a = anomalies.groupBy(*key).agg(F.count("*").alias("anomalies"))
    rows = segments.select(*key).distinct().join(f, key, "left").join(a, key, "left")
    return rows.select(*key, F.col("frame_count").isNotNull().alias("has_result"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("frame_count", "num_tracks", "anomalies")])


def masks_to_boxes(pixels: DataFrame, least: int = 1) -> DataFrame:
    """Pixels (video_id, frame_id, object_id, class_id, x, y) as boxes of objects with ``least`` pixels or more: track_id is the object's plus 1, its class that of its first frame."""
    who = ["video_id", "object_id"]
    boxes = pixels.groupBy(*who, "frame_id").agg(F.count("*").alias("n"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.min("class_id").alias("c")).where(F.col("n") >= least)
    first = boxes.groupBy(*who).agg(F.min_by("c", "frame_id").alias("class_id"))
    return boxes.join(first, who).select("video_id", (F.col("object_id") + 1).alias("track_id"), "class_id", "frame_id", "x1", "y1", "x2", "y2")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """base with changes by key: they replace rows, or, with ``keep_old``, only fill in keys that aren't there. Of changes with one key the one with the largest ``version`` counts."""
    last = Window.partitionBy(*keys).orderBy(F.desc("version"))
    new = changes.withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*base.columns)
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti")) if keep_old else base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def legacy_events(parts: DataFrame, events: DataFrame) -> DataFrame:
    """Events that old parts lack: a submitted or completed part without any has a final one made, without credit."""
    old = parts.where(F.col("status").isin("submitted", "completed")).join(events.select("part_id"), "part_id", "left_anti")
    return old.select("part_id", F.col("annotator"), "submitted_at", F.coalesce("progress_count", F.lit(0)).cast("bigint").alias("cumulative"), F.lit(0).cast("bigint").alias("credited"), F.lit("legacy_import").alias("kind"))


def upsert_boxes(frames: DataFrame, boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """Track frames after single boxes were set: (video_id, track_id, class_id, frame_id, box), clipped to the picture, in place of the track's box of that frame, if it has one."""
    b = boxes.join(videos.select("video_id", "width", "height"), "video_id")
    clip = G.clip_bbox_editor(G.Box.of(), F.col("width"), F.col("height"))
    new = b.select("video_id", "track_id", "class_id", "frame_id", *[clip[c].alias(c) for c in ("x1", "y1", "x2", "y2")])
    key = ["video_id", "track_id", "frame_id"]
    return frames.select(*new.columns).join(new.select(*key), key, "left_anti").unionByName(new)


def replace_from(target: DataFrame, source: DataFrame, start: int, replace: bool = True, repair: bool = True, **spikes: float) -> DataFrame:
    """Each video's target track (video_id, track_id, class_id, frame_id, box) with the frames of the video's source track with the smallest id.

    With ``replace`` the target's frames from ``start`` on go first; the source's frames come in whole and take the place of the
    target's. With ``repair`` spikes from ``start`` on are mended (``fix_spikes``, which takes ``spikes``), with what lies before as
    their history.
    """
    first = source.groupBy("video_id").agg(F.min("track_id").alias("track_id"))
    ids = target.groupBy("video_id").agg(F.min("track_id").alias("__t"), F.min_by("class_id", "frame_id").alias("__c"))
    new = source.join(first, ["video_id", "track_id"], "left_semi").join(ids, "video_id")
    new = new.select("video_id", F.col("__t").alias("track_id"), F.col("__c").alias("class_id"), "frame_id", "x1", "y1", "x2", "y2")
    left = target.where(F.col("frame_id") < start) if replace else target
    both = left.select(*new.columns).join(new.select("video_id", "frame_id"), ["video_id", "frame_id"], "left_anti").select(*new.columns).unionByName(new)
    return fix_spikes(both, start_frame=start, **spikes).select(*new.columns) if repair else both


def visible(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """(username, task_id, sees, may_review) of each active account and the live tasks that it sees or may review: admins all of them, others those that they publish or manage; applicants may review what they don't see.

    Admins meet all tasks, which is their purpose, so the result is that large. Tasks are dealt over 256 keys, which are shuffled to
    128 partitions however few bytes they hold, as it is the rows made of them that take time. Names come in 16 lists: a task
    meets these, and its rows are their elements.
    """
    live = tasks.where(~F.col("deleted")) if "deleted" in tasks.columns else tasks
    active = users.where("is_active").select("username", (F.col("role") == "admin").alias("admin"))
    roles = {c: F.col(c) for c in ("publisher", "manager", "applicant") if c in tasks.columns}
    named = live.select("task_id", F.explode(F.array(*[F.struct(v.alias("username"), F.lit(c != "applicant").alias("sees")) for c, v in roles.items()])).alias("r")).select("task_id", "r.*").where("username is not null")
    own = named.groupBy("username", "task_id").agg(F.bool_or("sees").alias("sees")).join(active.where("not admin"), "username").select("username", "task_id", "sees")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("bigint"))
    lists = active.where("admin").groupBy(dealt("username", 16)).agg(F.collect_list("username").alias("names"))
    everywhere = lists.select("names", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))).alias("salt"))
    met = live.select("task_id", dealt("task_id", 256).alias("salt")).repartition(128, "salt").join(everywhere.hint("merge"), "salt")
    every = met.select(F.explode("names").alias("username"), "task_id", F.lit(True).alias("sees"))
    return own.unionByName(every).withColumn("may_review", F.lit(True))


def first_names(events: DataFrame) -> DataFrame:
    """(annotator, names): of each person the names of their events' projects, each once, in the order in which they came first."""
    first = events.groupBy("annotator", "name").agg(F.min(F.struct("submitted_at", "event_id")).alias("at"))
    ordered = first.groupBy("annotator").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("rows"))
    return ordered.select("annotator", F.transform("rows", lambda r: r["name"]).alias("names"))


def resolve_applicants(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows (with ``applicant``) and ``resolved``, ``error``: a username without case, else the only display name alike; a text that is neither stays. An account that isn't active, and a display name that several have, is an error."""
    key = F.lower(F.trim("applicant"))
    account = users.select(F.lower("username").alias("__k"), F.col("username").alias("__u"), F.col("is_active").alias("__a"))
    shown = users.groupBy(F.lower(F.trim("display_name")).alias("__k")).agg(F.count("*").alias("__n"), F.min("username").alias("__d"), F.bool_and("is_active").alias("__da"))
    out = rows.withColumn("__k", key).join(account, "__k", "left").join(shown, "__k", "left")
    given = F.coalesce(F.col("__k"), F.lit("")) != ""
    error = F.when(given & ~F.col("__a"), "inactive").when(given & (F.col("__n") > 1), "ambiguous")
    resolved = F.when(given & F.col("__a"), F.col("__u")).when(given & F.col("__da"), F.col("__d")).otherwise(F.trim("applicant"))
    return out.select(*rows.columns, F.when(error.isNull(), resolved).alias("resolved"), error.alias("error"))


def overlaid(parameters: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, value) of parameters (key, level, name, value): of each name the value of the highest level, so that a video's own settings lie over its project's and those over the defaults. Names of nested values are paths with dots."""
    return parameters.where(F.col("value").isNotNull()).groupBy(*key, "name").agg(F.max_by("value", "level").alias("value"))


def search(df: DataFrame, query: str) -> DataFrame:
    """The rows whose text fields, joined by blanks, hold the query, without case."""
    fields = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    text = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`") for c in fields]))
    return df.where(F.contains(text, F.lit(query.strip().lower()))) if query.strip() else df


def inside(path: Column, root: Column) -> Column:
    """Whether a normalised path is the root or lies below it."""
    base = F.regexp_replace(root, "/+$", "")
    return (F.regexp_replace(path, "/+$", "") == base) | path.startswith(F.concat(base, F.lit("/")))


def layout_errors(jobs: DataFrame, folders: tuple[str, ...] = ("labels", "annotations")) -> DataFrame:
    """(job, destination) of the output folders of jobs (job, input, output) that lie inside their input or around it."""
    rows = jobs.select("job", "input", F.explode(F.array(*[F.concat(F.regexp_replace("output", "/+$", ""), F.lit(f"/{f}")) for f in folders])).alias("destination"))
    return rows.where(inside(F.col("destination"), F.col("input")) | inside(F.col("input"), F.col("destination"))).select("job", "destination")


#: How states are called, and what stands for a date that isn't known.
STATES = {"awaiting_parts": "待补充 Part", "pending": "待领取", "in_progress": "执行中", "submitted": "待审核", "completed": "已完成", "mixed": "混合状态"}
UNKNOWN_DATE = "待估算"
LINE = "{tag} | {project} | {status} | {progress} | {hours}h | {due}"


def digest_lines(overview: DataFrame, schedule: DataFrame, tasks: DataFrame, most: int = 5) -> DataFrame:
    """(task_id, line) of the first unfinished tasks by their date: a top-k report, in text."""
    names = F.create_map(*[F.lit(x) for k in STATES.items() for x in k])
    rows = schedule.join(overview.where("state <> 'completed'").select("task_id", "state", "completed", "total"), "task_id").join(tasks.select("task_id", "product_tag", "project", "rank"), "task_id")
    flat = lambda c: F.regexp_replace(c, "[\r\n]", " ")
    values = {
        "tag": flat(F.col("product_tag")), "project": flat(F.col("project")), "status": F.element_at(names, F.col("state")), "progress": F.concat_ws("/", F.col("completed").cast("string"), F.col("total").cast("string")),
        "hours": F.format_string("%.2f", F.floor(F.col("hours") * 100 + 0.5) / 100), "due": F.coalesce(F.col("due").cast("string"), F.lit(UNKNOWN_DATE)),
    }
    order = [F.asc_nulls_last("due"), F.when(F.coalesce("rank", F.lit(0)) != 0, F.col("rank")).otherwise(1_000_000_000), F.col("task_id")]
    return rows.orderBy(*order).limit(most).select("task_id", T.rendered(F.lit(LINE), values).alias("line"))
