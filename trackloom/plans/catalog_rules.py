"""Queries over the rules of the work on tasks, and their SQL, written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import text as T
from trackloom.operators import boxes, changes, joins, reports, work
from trackloom.plans.catalog import DT, LEDGER, PRT, SES, SUB, TF, TSK, USR, VID, compared_sql, moment, query, rounded, spikes_sql
from trackloom.plans.fixtures import WINDOW

# Visibility and reminders


@query("p2_visible", TSK, USR, sql="""
, live as (select task_id, publisher, manager, concat('u', cast(task_id%29 as varchar)) as applicant from fx_tasks where not deleted),
named as (select task_id, publisher as username, true as sees from live union select task_id, manager, true from live union select task_id, applicant, false from live)
select username, task_id, bool_or(sees) as sees, true as may_review from named join fx_users using (username) where is_active and role<>'admin' group by all
union all
select username, task_id, true, true from live cross join fx_users where is_active and role='admin'""")
def _(t, u):
    return reports.visible(t.withColumn("applicant", F.concat(F.lit("u"), (F.col("task_id") % 29).cast("string"))), u)


@query("e12_reminders", SUB, USR, sql="""
, users as (select username, is_active and number%4<>0 as reached from (select *, cast(substr(username,2) as int) as number from fx_users)),
e as (select event_id, part_id as task_id, case when is_final then 'approved' else 'submitted' end as kind from fx_submissions),
tasks as (select distinct task_id, 'u' || task_id%50 as publisher, 'u' || task_id%37 as applicant from e),
own as (select task_id, 't' || task_id as rule_id, ['u' || task_id%50, 'u' || task_id%7] as usernames, task_id%2=0 as notify_applicant from tasks where task_id%3=0 and task_id%5<>0),
whole as (select * from own where (select count(*) from users u where reached and u.username in (usernames[1], usernames[2])) = len(list_distinct(usernames))),
told as (
  select event_id || ':task-rule:' || rule_id as reminder_id, event_id, rule_id, unnest(list_concat(usernames, case when notify_applicant then [applicant] else [] end)) as username
  from e join whole using (task_id) join tasks using (task_id) where kind='approved'
  union all
  select cast(event_id as varchar), event_id, 'global', unnest(['u21', 'u22', publisher]) from e join tasks using (task_id) where kind='submitted')
select distinct reminder_id, event_id, rule_id, username from told join users using (username) where reached""")
def _(s, u):
    events = s.select("event_id", F.col("part_id").alias("task_id"), F.when(F.col("is_final"), "approved").otherwise("submitted").alias("kind"))
    name = lambda n: F.concat(F.lit("u"), (F.col("task_id") % n).cast("string"))
    tasks = events.select("task_id").distinct().select("task_id", name(50).alias("publisher"), name(37).alias("applicant"))
    own = tasks.where("task_id % 3 = 0").select(F.concat(F.lit("t"), "task_id").alias("rule_id"), F.lit("approved").alias("kind"), "task_id", F.array(name(50), name(7)).alias("usernames"), F.lit(False).alias("notify_publisher"), (F.col("task_id") % 2 == 0).alias("notify_applicant"), (F.col("task_id") % 5 != 0).alias("enabled"))
    every = s.sparkSession.createDataFrame([("global", "submitted", None, ["u21", "u22"], True, False, True), ("off", "approved", None, ["u21"], True, True, False)], own.schema)
    users = u.withColumn("phone", F.when(F.substring("username", 2, 9).cast("int") % 4 == 0, " ").otherwise("1"))
    return changes.reminders(own.unionByName(every), events, tasks, users)


# Notifications


BEFORE = """select task_id, publisher, manager, status, rank%5 as priority, deleted from fx_tasks where task_id%13<>0"""
AFTER = """select task_id, publisher, case when task_id%17=0 then 'u1' else manager end as manager, case when task_id%7=0 then 'completed' else status end as status,
 case when task_id%6=0 then null when task_id%5=0 then rank%5+1 else rank%5 end as priority, deleted from fx_tasks"""


@query("e10_task_notifications", TSK, USR, sql=f"""
, b as ({BEFORE}), a as ({AFTER}),
told as (
  select a.task_id, 'created' as kind, a.manager as username from a left join b using (task_id) where b.task_id is null
  union all select a.task_id, 'priority', unnest([a.publisher, a.manager]) from a join b using (task_id) where a.priority<>b.priority and not a.deleted
  union all select a.task_id, 'completed', unnest([a.publisher, a.manager]) from a join b using (task_id) where a.status<>b.status and a.status='completed' and not a.deleted
  union all select a.task_id, 'manager', unnest([a.publisher, a.manager, b.manager]) from a join b using (task_id) where a.manager<>b.manager and not a.deleted)
select distinct task_id, kind, username from told join fx_users using (username) where is_active""")
def _(t, u):
    before = t.where("task_id % 13 <> 0").withColumn("priority", F.col("rank") % 5)
    priority = F.when(F.col("task_id") % 6 != 0, F.col("rank") % 5 + F.when(F.col("task_id") % 5 == 0, 1).otherwise(0))
    after = t.withColumn("priority", priority).withColumn("manager", F.when(F.col("task_id") % 17 == 0, "u1").otherwise(F.col("manager"))).withColumn("status", F.when(F.col("task_id") % 7 == 0, "completed").otherwise(F.col("status")))
    return changes.task_notifications(before, after, u)


#: Sessions stand for notifications; the last of each person's marks of all, and marks of single ones, for what was read.
NOTES = "select session_id as notification_id, annotator as username, started_at as created_at, case when session_id%19=0 then started_at end as read_at from fx_sessions"
MARKS = """select annotator as username, cast(0 as bigint) as notification_id, max(started_at) filter (session_id%7=0) as marked from fx_sessions where session_id%7=0 group by 1
 union all select annotator, session_id, started_at + interval 1 hour from fx_sessions where session_id%11=0 union all select annotator, session_id, started_at - interval 1 hour from fx_sessions where session_id%23=0"""


def notes(s):
    read = F.when(F.col("session_id") % 19 == 0, F.col("started_at"))
    rows = s.select(F.col("session_id").alias("notification_id"), F.col("annotator").alias("username"), F.col("started_at").cast("timestamp").alias("created_at"), read.cast("timestamp").alias("read_at"))
    every = s.where("session_id % 7 = 0").groupBy(F.col("annotator").alias("username")).agg(F.lit(0).cast("bigint").alias("notification_id"), F.max("started_at").cast("timestamp").alias("at"))
    one = lambda n, hours: s.where(f"session_id % {n} = 0").select(F.col("annotator").alias("username"), F.col("session_id").alias("notification_id"), (F.col("started_at") + F.expr(f"interval {hours} hour")).cast("timestamp").alias("at"))
    return changes.mark_read(rows, every.unionByName(one(11, 1)).unionByName(one(23, -1)))


@query("e10_read_marks", SES, sql=f"""
, n as ({NOTES}), m as ({MARKS}),
found as (select n.notification_id, min(marked) as marked from n join m on m.username=n.username and m.notification_id in (0, n.notification_id) and marked>=created_at group by 1)
select n.notification_id, epoch_us(coalesce(read_at, marked)) as read_us from n left join found using (notification_id)""")
def _(s):
    return notes(s).select("notification_id", F.unix_micros("read_at").alias("read_us"))


@query("e10_unread_counts", SES, sql=f"""
, n as ({NOTES}), m as ({MARKS}),
found as (select distinct n.notification_id from n join m on m.username=n.username and m.notification_id in (0, n.notification_id) and marked>=created_at)
select username, count(*) filter (read_at is null and f.notification_id is null) as unread, count(*) as notifications from n left join found f using (notification_id) group by 1""")
def _(s):
    return changes.unread_counts(notes(s))


@query("e11_due_snapshots", SES, sql="""
select cast(started_at + interval 8 hour as date) as report_date, epoch_us(min(started_at)) as ran_us from fx_sessions where hour(started_at + interval 8 hour)>=18 group by 1""")
def _(s):
    return changes.due_runs(s.select(F.col("started_at").cast("timestamp").alias("now"))).select("report_date", F.unix_micros("ran_at").alias("ran_us"))


@query("e14_due_reports", SES, sql="""
, r as (select started_at, started_at + interval 8 hour as t from fx_sessions),
done as (select distinct cast(t as date) as d from r where dayofmonth(t)%4=0)
select cast(t as date) as report_date, epoch_us(min(started_at)) as ran_us from r where strftime(t, '%H:%M')>='17:30' and isodow(t)<=5 and cast(t as date) not in (select d from done) group by 1""")
def _(s):
    now = s.select(F.col("started_at").cast("timestamp").alias("now"))
    day = F.from_utc_timestamp("now", "Asia/Shanghai").cast("date")
    done = now.select(day.alias("report_date")).where(F.dayofmonth("report_date") % 4 == 0)
    return changes.due_runs(now, "17:30", True, done).select("report_date", F.unix_micros("ran_at").alias("ran_us"))


@query("e5_review_resets", TSK, PRT, sql="""
select part_id from fx_parts join fx_tasks using (task_id) where expected_part_seconds<>case task_id%3 when 0 then 0 when 1 then expected_part_seconds else 600 end""")
def _(t, p):
    after = t.withColumn("expected_part_seconds", F.when(F.col("task_id") % 3 == 1, F.col("expected_part_seconds")).when(F.col("task_id") % 3 == 2, F.lit(600.0)))
    return changes.review_resets(t, after, p).select("part_id")


@query("e4_reopened", TSK, sql="""
, a as (select count(*) as n from fx_tasks where not deleted and status<>'completed'),
back as (select task_id, row_number() over (order by task_id) as k from fx_tasks where task_id%2=0 and not deleted and status='completed')
select task_id, case when task_id%2=0 and not deleted then 'in_progress' else status end as status, cast(case when k is not null then n+k else rank end as bigint) as rank from fx_tasks left join back using (task_id) cross join a""")
def _(t):
    return work.reopened(t.withColumn("rank", F.col("rank").cast("bigint")), t.where("task_id % 2 = 0")).select("task_id", "status", "rank")


@query("l4_next_reminder", SUB, sql="""
select event_id from fx_submissions where part_id%3=0 order by submitted_at, event_id limit 1""")
def _(s):
    status = F.when(F.col("part_id") % 3 == 0, "pending").otherwise("sent")
    return work.next_reminder(s.select("event_id", F.col("submitted_at").alias("created_at"), status.alias("status"))).select("event_id")


@query("l2_page_after", TSK, sql="""
select task_id, rank from fx_tasks where (rank, task_id)>(5, 100) order by rank, task_id limit 25""")
def _(t):
    return work.page_after(t, ["rank", "task_id"], (5, 100), 25).select("task_id", "rank")


# Production


EVENTS = LEDGER + """, pe as (select *, case when event_id%10=0 then 'legacy_import' else 'progress' end as event_kind, part_id%40 as task_id,
 case when part_id%3=0 then 'n' || part_id%7 else '' end as task_name, case when part_id%3=1 then 'p' || part_id%5 end as project, extract(isodow from submitted_at + interval 8 hour)>=6 as off from ev)"""


def production_events(s):
    own = work.credit_ledger(s)[0]
    kind = F.when(F.col("event_id") % 10 == 0, "legacy_import").otherwise("progress")
    name = F.when(F.col("part_id") % 3 == 0, F.concat(F.lit("n"), F.col("part_id") % 7)).otherwise("")
    return own.select("event_id", "annotator", "submitted_at", "credited", kind.alias("event_kind"), (F.col("part_id") % 40).alias("task_id"), name.alias("task_name"), F.when(F.col("part_id") % 3 == 1, F.concat(F.lit("p"), F.col("part_id") % 5)).alias("project"))


@query("a7_production_tasks", SUB, sql=EVENTS + f"""
, n as (select *, coalesce(nullif(task_name,''), nullif(project,''), cast(task_id as varchar)) as name from pe where event_kind<>'legacy_import' and submitted_at>={WINDOW[0]} and submitted_at<{WINDOW[1]} and credited>0 and not off),
f as (select annotator, name, row_number() over (partition by annotator order by min((submitted_at, event_id))) as first from n group by 1, 2)
select n.annotator, n.task_id, n.name, cast(sum(credited) as bigint) as image_count, any_value(first) as first from n join f on f.annotator=n.annotator and f.name=n.name group by 1, 2, 3""")
def _(s):
    return work.production_tasks(production_events(s), moment(WINDOW[0]), moment(WINDOW[1]), True)


@query("a7_production_summary", SUB, sql=EVENTS + f"""
select cast(coalesce(sum(credited) filter (own and not off),0) as bigint) as image_count, cast(coalesce(sum(credited) filter (own and off),0) as bigint) as excluded_weekend_count,
 count(*) filter (event_kind='legacy_import') as legacy_parts_excluded, {WINDOW[0]}<timestamp '2024-01-09 00:00:00' as includes_untracked_time
from (select *, event_kind<>'legacy_import' and submitted_at>={WINDOW[0]} and submitted_at<{WINDOW[1]} as own from pe)""")
def _(s):
    return work.production_summary(production_events(s), moment(WINDOW[0]), moment(WINDOW[1]), moment("timestamp '2024-01-09 00:00:00'"), True)


@query("k11_weekly_cells", SUB, USR, sql=EVENTS + f"""
, n as (select *, coalesce(nullif(task_name,''), nullif(project,''), cast(task_id as varchar)) as name from pe where event_kind<>'legacy_import' and submitted_at>={WINDOW[0]} and submitted_at<{WINDOW[1]} and credited>0),
f as (select annotator, name, min((submitted_at, event_id)) as came from n group by 1, 2),
p as (select annotator, string_agg(name, '；' order by came) as names from f group by 1)
select username, display_name || chr(9) || '2024-01-08' || chr(9) || '2024-01-14' || chr(9) || names as line from fx_users join p on annotator=username""")
def _(s, u):
    sums = work.production_tasks(production_events(s), moment(WINDOW[0]), moment(WINDOW[1]))
    names = sums.select("annotator", "first", "name").distinct().groupBy("annotator").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("names"))
    rows = u.join(names, F.col("annotator") == F.col("username"))
    return rows.select("username", T.weekly_cells(F.col("display_name"), moment(WINDOW[0]).cast("date"), moment(WINDOW[1]).cast("date"), F.col("names")).alias("line"))


# Edits and exports


@query("u7_replace_from", TF, sql=""", a as (select video_id, min(track_id) as t from fx_track_frames where class_id=0 group by 1), b as (select video_id, min(track_id) as t from fx_track_frames where class_id=1 group by 1),
new as (select f.video_id, a.t as track_id, 0 as class_id, frame_id, x1, y1, x2, y2 from fx_track_frames f join b on b.video_id=f.video_id and b.t=f.track_id join a on a.video_id=f.video_id),
both_ as (select * from new union all select f.video_id, f.track_id, class_id, frame_id, x1, y1, x2, y2 from fx_track_frames f join a on a.video_id=f.video_id and a.t=f.track_id
 where frame_id<40 and not exists (select 1 from new n where n.video_id=f.video_id and n.frame_id=f.frame_id))""" + spikes_sql("both_", 40) + """
select video_id, track_id, class_id, frame_id, round(x1,6) as x1, round(y2,6) as y2 from mended""")
def _(t):
    first = t.where("class_id = 0").groupBy("video_id").agg(F.min("track_id").alias("track_id"))
    target = t.where("class_id = 0").join(first, ["video_id", "track_id"], "left_semi")
    return rounded(reports.replace_from(target, t.where("class_id = 1"), 40).select("video_id", "track_id", "class_id", "frame_id", "x1", "y2"))


SIX = "printf('%.6f', floor(({})*1e6+0.5)/1e6)"
LINE = "class_id || ' ' || " + " || ' ' || ".join(SIX.format(v) for v in ("(x1+x2)/2/width", "(y1+y2)/2/height", "(x2-x1)/width", "(y2-y1)/height"))
CLIPPED = {c: f"least(greatest({c},0),{'width' if 'x' in c else 'height'})" for c in ("x1", "y1", "x2", "y2")}


@query("k4_export_files", DT, VID, sql=f""", ex as (select *, 'part' || video_id%3 || '_v' || video_id || '_frame_' || lpad(cast(f as varchar), 6, '0') as name from (select *, unnest(range(0, cast(frame_count as bigint), 10)) as f from fx_videos)),
b as (select name, det_idx, class_id, width, height, {LINE} as line, {", ".join(f"{e} as {c}" for c, e in CLIPPED.items())} from ex join fx_detections d on d.video_id=ex.video_id and d.video_frame_idx=f),
x as (select name, string_agg(line, chr(10) order by det_idx) as labels, string_agg(case when x2>x1 and y2>y1 then
 '<object><name>' || case class_id when 0 then 'person' when 1 then 'car' else 'class_2' end || '</name><pose>Unspecified</pose><truncated>' || (x1<=0 or y1<=0 or x2>=width or y2>=height)::int || '</truncated><difficult>0</difficult><bndbox>' ||
 '<xmin>' || cast(greatest(round_even(x1,0),0) as bigint) || '</xmin><ymin>' || cast(greatest(round_even(y1,0),0) as bigint) || '</ymin><xmax>' || cast(least(round_even(x2,0),width) as bigint) || '</xmax><ymax>' || cast(least(round_even(y2,0),height) as bigint) || '</ymax></bndbox></object>' end, '' order by det_idx) as objects from b group by 1)
select ex.video_id, 'part' || ex.video_id%3 as segment, ex.name, coalesce(labels,'') as labels,
 '<annotation><folder>images</folder><filename>' || ex.name || '.jpg</filename><size><width>' || width || '</width><height>' || height || '</height><depth>3</depth></size><segmented>0</segmented>' || coalesce(objects,'') || '</annotation>' as annotations
from ex left join x on x.name=ex.name""")
def _(d, v):
    segment = F.concat(F.lit("part"), F.col("video_id") % 3)
    labels = d.sparkSession.createDataFrame([(0, "person"), (1, "car")], "class_id int, label string")
    videos = v.withColumn("stem", F.concat(F.lit("v"), "video_id")).withColumn("part", segment)
    return boxes.export_files(d.withColumn("track_id", F.col("det_idx")).withColumn("part", segment), videos, 10, labels, "part")


RUNS = """, f as (select video_id%5 as run, frame_id, sum(x1)/1000 as seconds, count(*) as boxes from fx_detections group by all),
q as (select run, count(*) as frames, count(*)/sum(seconds) as fps, sum(boxes)/sum(seconds) as bps, median(seconds) as p50, list_sort(list(seconds))[cast(floor((count(*)-1)*0.95) as int)+1] as p95 from f group by run),
m as (select video_id%5 as run, sum(tp) as tp, sum(extra) as extra, sum(missed) as missed from cmp where video_id%5<>0 group by 1),
v as (select q.run, frames, fps, fps/(select fps from q where run=0) as speed_up, bps, p50, p95, tp/nullif(tp+extra,0) as pr, tp/nullif(tp+missed,0) as re from q left join m on m.run=q.run)"""
VALUES = ("fps", "speed_up", "bps", "p50", "p95", "pr", "re")
FIXED = lambda v, d: f"printf('%.{d}f', floor(({v})*1e{d}+0.5)/1e{d})"
CSV = "run || ',' || frames || ',' || " + " || ',' || ".join(f"coalesce({FIXED(v, 6)}, '')" for v in VALUES)
TABLE = "'| ' || run || ' | ' || frames || ' | ' || " + " || ' | ' || ".join(f"coalesce({FIXED(v, d)}, '-')" for v, d in zip(VALUES, (4, 2, 3, 3, 3, 3, 3), strict=True)) + " || ' |'"


@query("k9_summary_files", DT, sql=compared_sql("(video_id%5*9)") + RUNS + f"""
select 'summary.csv' as name, 'run,frames,fps,speed_up,boxes_per_second,p50,p95,precision,recall' || chr(10) || string_agg({CSV}, chr(10) order by run) || chr(10) as content from v
union all select 'summary.md', 'Compared with the output of `0`, which is no ground truth.' || chr(10) || chr(10) || '| run | frames | fps | speed_up | boxes_per_second | p50 | p95 | precision | recall |' || chr(10)
 || '|---:|---:|---:|---:|---:|---:|---:|---:|---:|' || chr(10) || string_agg({TABLE}, chr(10) order by run) || chr(10) from v""")
def _(d):
    shift = F.col("video_id") % 5 * 9
    other = d.where("det_idx % 5 <> 4").withColumn("x1", F.col("x1") + shift).withColumn("x2", F.col("x2") + shift)
    compared = boxes.compare_box_sets(joins.iou_join(d, other, 0.5), d, other).withColumn("run", F.col("video_id") % 5)
    frames = d.groupBy((F.col("video_id") % 5).alias("run"), "frame_id").agg((F.sum("x1") / 1000).alias("seconds"), F.count("*").alias("boxes"))
    return boxes.summary_files(boxes.summarize_runs(frames, 0, compared), "0").where("name <> 'summary.json'")


@query("x3_class_ids", DT, sql="""
, l as (select case when class_id=1 then 'class_' || object_key%40 else 'thing ' || object_key%25 end as label, object_key*100+frame_id as position from fx_detections),
known as (select 'thing 3' as label, 0 as class_id union all select 'class_5', 7),
fresh as (select label, row_number() over (order by min(position), label) as n from l where label not in (select label from known) group by 1)
select label, cast(class_id as bigint) as class_id from known
union all select label, coalesce(try_cast(nullif(regexp_extract(label, '^class_([0-9]+)$', 1), '') as bigint), 2+n-1) from fresh""")
def _(d):
    label = F.when(F.col("class_id") == 1, F.concat(F.lit("class_"), F.col("object_key") % 40)).otherwise(F.concat(F.lit("thing "), F.col("object_key") % 25))
    known = d.sparkSession.createDataFrame([("thing 3", 0), ("class_5", 7)], "label string, class_id bigint")
    return boxes.class_ids(d.select(label.alias("label"), (F.col("object_key") * 100 + F.col("frame_id")).alias("position")), known)


@query("g16_square", DT, sql="select video_id, frame_id, det_idx, round(x1*(1008/1920),6) as x1, round(y2*(1008/1080),6) as y2 from fx_detections")
def _(d):
    box = G.to_square(G.Box.of(), F.lit(1920), F.lit(1080))
    return rounded(d.select("video_id", "frame_id", "det_idx", box.x1.alias("x1"), box.y2.alias("y2")))
