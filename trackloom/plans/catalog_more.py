"""More registered queries: text rules, geometry, reports, edits and frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import text as T
from trackloom.operators import boxes, changes, fusion, lifecycle, reports, sampling, tracks, work
from trackloom.plans.catalog import DT, ORACLES, PAIRS, PRT, SES, SUB, TF, TSK, USR, VID, compared_sql, query, rounded, sides
from trackloom.plans.fixtures import oracle
from trackloom.plans.fusion_sql import F8, final_sql, merged_sql, suppressed_sql

ACT, ATK, APT = "fx_actions", "fx_action_tasks", "fx_action_parts"
NUM = "try_cast(nullif(regexp_extract({t}, '^(\\d+(\\.\\d+)?)\\s*([-–—~～]\\s*(\\d+(\\.\\d+)?))?$', {g}),'') as double)"
PLAIN = "regexp_replace(trim({c}), '[,，]', '', 'g')"


def lo(c: str) -> str:
    return NUM.format(t=PLAIN.format(c=c), g=1)


def hi(c: str) -> str:
    return f"coalesce({NUM.format(t=PLAIN.format(c=c), g=4)}, {lo(c)})"


def ranged(c: str, name: str) -> str:
    return f"case when {lo(c)}>0 and {lo(c)}<={hi(c)} then {lo(c)} end as {name}lo, case when {lo(c)}>0 and {lo(c)}<={hi(c)} then {hi(c)} end as {name}hi"


@query("x4_numeric_range", TSK, sql=f"select task_id, {ranged('data_amount', 'a')}, {ranged('hourly_capacity', 'c')} from fx_tasks")
def _(t):
    a, c = T.numeric_range(F.col("data_amount")), T.numeric_range(F.col("hourly_capacity"))
    return t.select("task_id", a["lo"].alias("alo"), a["hi"].alias("ahi"), c["lo"].alias("clo"), c["hi"].alias("chi"))


@query("x5_filled_hours", TSK, sql=f"select task_id, case when alo is not null and clo is not null and elo is null then case when alo/chi=ahi/clo then printf('%.2f', alo/chi) else printf('%.2f-%.2f', alo/chi, ahi/clo) end else est end as hours from (select task_id, est, {ranged('data_amount', 'a')}, {ranged('hourly_capacity', 'c')}, {ranged('est', 'e')} from (select *, case when task_id%3=0 then '7.5' when task_id%3=1 then 'soon' else '' end as est from fx_tasks))")
def _(t):
    est = F.expr("case when task_id%3=0 then '7.5' when task_id%3=1 then 'soon' else '' end")
    return t.select("task_id", T.filled_hours(est, F.col("data_amount"), F.col("hourly_capacity")).alias("hours"))


@query("x6_registration_errors", TSK, sql=f"select task_id, array_to_string(list_filter([case when p='' then 'project' end, case when d is null or try_cast(d as date) is null then 'application_date' end, case when alo is null then 'data_amount' end, case when clo is null then 'hourly_capacity' end], lambda x: x is not null), ',') as errors from (select task_id, case when task_id%5=0 then '' else 'p' end as p, case task_id%4 when 0 then '2024-02-30' when 1 then 'soon' when 2 then null else '2024-02-29' end as d, {ranged('data_amount', 'a')}, {ranged('hourly_capacity', 'c')} from fx_tasks)")
def _(t):
    p, d = F.expr("case when task_id%5=0 then ' ' else 'p' end"), F.expr("case task_id%4 when 0 then '2024-02-30' when 1 then 'soon' when 2 then null else '2024-02-29' end")
    return t.select("task_id", F.array_join(T.registration_errors(p, d, F.col("data_amount"), F.col("hourly_capacity")), ",").alias("errors"))


@query("x7_work_path", PRT, sql=r"select part_id, case part_index%6 when 0 then '/abs/x' when 1 then case when task_id%2=0 then '/data/a/b' else 'D:\data\a\b' end when 2 then case when task_id%2=0 then '/data' else 'D:\data' end when 3 then 'C:/z' when 4 then case when task_id%2=0 then '/data/c' else 'D:\data\c' end else '\\srv\x' end as path from fx_parts")
def _(p):
    root = F.when(F.col("task_id") % 2 == 0, "/data/").otherwise("D:\\data\\")
    path = F.element_at(F.array(*map(F.lit, ["/abs/x", "a/b", ".", "C:/z", " /c/ ".strip().strip("/"), "\\\\srv\\x"])), (F.col("part_index") % 6 + 1).cast("int"))
    return p.select("part_id", T.work_path(root, path).alias("path"))


@query("x9_part_name", PRT, sql="select part_id, case task_id%4 when 0 then '' when 1 then 'cam_' when 2 then 'cam-' else 'cam_' end || 'part_' || case when part_index*300<1000 then lpad(cast(part_index*300 as varchar),3,'0') else cast(part_index*300 as varchar) end as name from fx_parts")
def _(p):
    prefix = F.element_at(F.array(*map(F.lit, ["  ", "cam_", "cam-", "cam"])), (F.col("task_id") % 4 + 1).cast("int"))
    return p.select("part_id", T.part_name(prefix, F.col("part_index") * 300).alias("name"))


@query("x10_task_name", TSK, sql=f"select task_id, case when task_id%3=0 then '{T.UNNAMED}' else project end || ' · ' || case when task_id%2=0 then '{T.PLAIN}' else product_tag end as name from fx_tasks")
def _(t):
    return t.select("task_id", T.task_name(F.when(F.col("task_id") % 3 != 0, F.col("project")), F.when(F.col("task_id") % 2 == 0, " ").otherwise(F.col("product_tag"))).alias("name"))


@query("x12_rendered", TSK, sql="select task_id, '{' || project || '} has rank ' || rank || ' of ' || product_tag as text from fx_tasks")
def _(t):
    return t.select("task_id", T.rendered(F.lit("{{{project}}} has rank {rank} of {tag}"), {"project": F.col("project"), "rank": F.col("rank"), "tag": F.col("product_tag")}).alias("text"))


@query("x13_question", TSK, sql="select task_id, case when task_id%7=0 then 'Own?' when task_id%4=0 then 'Locate all the instances that matches the following description: ' || project || '</c>' || product_tag || '.' when task_id%4=1 then 'Locate all the instances that matches the following description: ' || project || '.' when task_id%4=2 then 'Locate a single instance that matches the following description: ' || project || '.' else 'Locate all the instances that match the following description: ' || project || '.' end as question from fx_tasks")
def _(t):
    task = F.element_at(F.array(*map(F.lit, ["detect", "detect", "ground_single", "ground_multi"])), (F.col("task_id") % 4 + 1).cast("int"))
    categories = F.when(F.col("task_id") % 4 == 0, F.array("project", F.lit(" "), "product_tag"))
    return t.select("task_id", T.question(task, F.col("project"), categories, F.when(F.col("task_id") % 7 == 0, "Own?")).alias("question"))


@query("x14_run_case", PRT, sql="select part_id, case part_index%4 when 0 then 'standard' when 1 then 'batch' end as runtime, case part_index%4 when 0 then 'slow' when 1 then 'hybrid' end as mode, case part_index%4 when 0 then 1 when 1 then part_index end as batch from fx_parts")
def _(p):
    name = F.expr("case part_index%4 when 0 then ' Standard-slow' when 1 then concat('batch-hybrid-', part_index) when 2 then 'batch-fast-0' else 'standard-best' end")
    c = T.run_case(name)
    return p.select("part_id", c["runtime"].alias("runtime"), c["mode"].alias("mode"), c["batch"].cast("bigint").alias("batch"))


@query("x2_class_id", PRT, sql="select part_id, case when status='rework' then 1 when status='in_progress' then 2 when task_id%2=0 then 5 else 9 end as class_id from fx_parts")
def _(p):
    ids = F.create_map(F.lit("rework"), F.lit(1), F.lit("in progress"), F.lit(2), F.lit("known prompt"), F.lit(5))
    label = F.concat(F.lit("  "), F.upper(F.replace("status", F.lit("_"), F.lit(" \n "))))
    return p.select("part_id", T.class_id(label, ids, F.when(F.col("task_id") % 2 == 0, "Known  prompt").otherwise("other"), F.lit(9)).alias("class_id"))


@query("x3_class_name", DT, sql="select video_id, frame_id, det_idx, case class_id when 0 then 'person' when 1 then 'car' else 'class_2' end as name from fx_detections")
def _(d):
    return d.select("video_id", "frame_id", "det_idx", T.class_name(F.col("class_id"), F.create_map(F.lit("0"), F.lit("person"), F.lit("1"), F.lit("car"))).alias("name"))


@query("k10_manifest_lines", PRT, sql="select part_id, 'd/' || part_index || chr(9) || coalesce(bbox_count,0) as line from fx_parts")
def _(p):
    return p.select("part_id", T.manifest_line(F.concat(F.lit("d/"), "part_index"), F.col("bbox_count")).alias("line"))


@query("k11_cells", TSK, sql="select task_id, case task_id%3 when 0 then '''=' || project when 1 then 'a b ' || project else '' end as cell from fx_tasks")
def _(t):
    return t.select("task_id", T.cell(F.expr("case task_id%3 when 0 then concat('=', project) when 1 then concat(' a\\t\\r\\nb ', project) end")).alias("cell"))


SIX = "printf('%.6f', floor(({v})*1e6+0.5)/1e6)"


@query("k8_scored_lines", DT, sql="select video_id, frame_id, det_idx, case when b>a and d>c then class_id || ' ' || " + " || ' ' || ".join(SIX.format(v=v) for v in ("(a+b)/2/1000", "(c+d)/2/600", "(b-a)/1000", "(d-c)/600", "score")) + " end as line from (select *, least(greatest(x1,0),1000) as a, least(greatest(x2,0),1000) as b, least(greatest(y1,0),600) as c, least(greatest(y2,0),600) as d from fx_detections)")
def _(d):
    return d.select("video_id", "frame_id", "det_idx", T.scored_line(F.col("class_id"), G.Box.of(), F.lit(1000), F.lit(600), F.col("score")).alias("line"))


@query("g2_clip_editor", DT, sql="select video_id, frame_id, det_idx, " + ", ".join(f"least(greatest({c},0),{1000 if 'x' in c else 600}) as {c}" for c in tracks.BOX) + " from fx_detections")
def _(d):
    c = G.clip_bbox_editor(G.Box.of(), F.lit(1000), F.lit(600))
    return d.select("video_id", "frame_id", "det_idx", *[c[k].alias(k) for k in tracks.BOX])


@query("g3_yolo_to_xyxy", DT, sql="select video_id, frame_id, det_idx, case when b>a and d>c then round(a,6) end as x1, case when b>a and d>c then round(d,6) end as y2 from (select *, least(greatest(x1,0),999) as a, least(greatest(x2,0),999) as b, least(greatest(y1,0),599) as c, least(greatest(y2,0),599) as d from fx_detections)")
def _(d):
    w, h = F.lit(1000.0), F.lit(600.0)
    box = G.yolo_to_xyxy((F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h, (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h, w, h)
    return rounded(d.select("video_id", "frame_id", "det_idx", box["x1"].alias("x1"), box["y2"].alias("y2")))


@query("g4_xywh", DT, sql="select video_id, frame_id, det_idx, (x1+x2)/2 as cx, (y1+y2)/2 as cy, x2-x1 as w, y2-y1 as h, x2 as back from fx_detections")
def _(d):
    m = G.bbox_to_xywh(G.Box.of())
    return d.select("video_id", "frame_id", "det_idx", *[m[c].alias(c) for c in ("cx", "cy", "w", "h")], G.xywh_to_bbox(m["cx"], m["cy"], m["w"], m["h"]).x2.alias("back"))


@query("g7_round_half_even", DT, sql="select video_id, frame_id, det_idx, cast(case when x1/2<1279 then round_even(x1/2,0) else 0 end as int) as x1, cast(case when x1/2<1279 then round_even(least(x2/2,1279),0) else 0 end as int) as x2 from fx_detections")
def _(d):
    b = G.Box(*[F.col(c) / 2 for c in tracks.BOX])
    r = G.round_bbox_int(b, F.lit(1280), F.lit(720))
    return d.select("video_id", "frame_id", "det_idx", r["x1"].alias("x1"), r["x2"].alias("x2"))


@query("g8_buffered_iou", DT, sql="select video_id, frame_id, det_idx, round(case when i>0 then i/(2*a-i) else 0 end,6) as iou from (select *, greatest(w-40,0)*h as i, w*h as a from (select *, (x2-x1)*1.5 as w, (y2-y1)*1.5 as h from fx_detections))")
def _(d):
    b = G.Box.of()
    return rounded(d.select("video_id", "frame_id", "det_idx", G.buffered_iou(b, G.Box(b.x1 + 40, b.y1, b.x2 + 40, b.y2), 0.5).alias("iou")))


@query("g9_depth_bin", DT, sql="select video_id, frame_id, det_idx, cast(case when hi>lo then least(greatest(floor((hi-p)/(hi-lo)*4),0),3) else 0 end as int) as bin from (select *, y2+0.5*(y2-y1) as p, min(y2+0.5*(y2-y1)) over w as lo, max(y2+0.5*(y2-y1)) over w as hi from fx_detections window w as (partition by video_id, frame_id))")
def _(d):
    depth = G.pseudo_depth(G.Box.of(), 0.5)
    span = d.groupBy("video_id", "frame_id").agg(F.min(depth).alias("lo"), F.max(depth).alias("hi"))
    return d.join(span, ["video_id", "frame_id"]).select("video_id", "frame_id", "det_idx", G.depth_bin(depth, F.col("lo"), F.col("hi"), 4).alias("bin"))


@query("g10_affinities", DT, sql="select video_id, frame_id, det_idx, round(case when sqrt(ax*ax+ay*ay)>1e-6 and sqrt(bx*bx+b2*b2)>1e-6 then ((ax*bx+ay*b2)/(sqrt(ax*ax+ay*ay)*sqrt(bx*bx+b2*b2))+1)/2 else 0.5 end,6) as direction, round(least(h,60)/greatest(h,60),6) as height from (select *, cast(det_idx-1 as double) as ax, cast(class_id as double) as ay, x2-x1 as bx, y2-y1-95 as b2, y2-y1 as h from fx_detections)")
def _(d):
    b = G.Box.of()
    sixty = G.Box(b.x1, F.lit(0.0), b.x2, F.lit(60.0))
    way = G.direction_affinity((F.col("det_idx") - 1).cast("double"), F.col("class_id").cast("double"), b.x2 - b.x1, b.y2 - b.y1 - 95)
    return rounded(d.select("video_id", "frame_id", "det_idx", way.alias("direction"), G.height_affinity(b, sixty).alias("height")))


@query("g13_percent_boxes", DT, sql="select video_id, frame_id, det_idx, cast(round_even(x1,0) as int) as x1, cast(round_even(x2,0) as int) as x2 from fx_detections where x2<1900")
def _(d):
    w, h = F.lit(1920.0), F.lit(1080.0)
    r = G.percent_to_xyxy(F.round(F.col("x1") / w * 100, 9), F.col("y1") / h * 100, F.round((F.col("x2") - F.col("x1")) / w * 100, 9), (F.col("y2") - F.col("y1")) / h * 100, w, h)
    return d.where("x2 < 1900").select("video_id", "frame_id", "det_idx", r["x1"].alias("x1"), r["x2"].alias("x2"))


@query("g16_grid", DT, sql="select video_id, frame_id, det_idx, round(x1/1000*1920,6) as x from fx_detections")
def _(d):
    return rounded(d.select("video_id", "frame_id", "det_idx", G.scale_grid(F.col("x1"), F.lit(1920)).alias("x")))


@query("g18_crop_window", DT, sql="select video_id, frame_id, det_idx, cast(x as int) as x1, cast(greatest(-x,0) as int) as l, cast(greatest(x+400-1500,0) as int) as r from (select *, round_even((x1+x2)/2-200,0) as x from fx_detections)")
def _(d):
    c = G.crop_window(G.Box.of(), F.lit(400.0), F.lit(300.0), F.lit(1500.0), F.lit(1000.0))
    return d.select("video_id", "frame_id", "det_idx", c["x1"].alias("x1"), c["left"].alias("l"), c["right"].alias("r"))


# Reports


@query("a10_task_estimate", TSK, PRT, sql=f""", s as (select task_id, count(*) as n, sum(greatest(image_count,0)) as known, bool_and(image_count>0) as measured, bool_and(status in ('submitted','completed')) as complete,
 sum(case when status in ('submitted','completed') then image_count when image_count>0 then least(greatest(progress_count,0),image_count) else greatest(progress_count,0) end) as annotated, bool_or(image_count<=0 and status in ('submitted','completed')) as unsized, bool_or(status='rework') as rework, count(*) filter (status='submitted') as waiting from fx_parts group by 1),
r as (select t.task_id, {ranged('data_amount', 'a')}, {ranged('hourly_capacity', 'c')}, coalesce(known,0) as known, coalesce(measured,false) as measured, coalesce(complete,false) as complete, coalesce(annotated,0) as annotated, coalesce(unsized,false) as unsized, coalesce(rework,false) as rework, coalesce(waiting,0) as waiting from fx_tasks t left join s on s.task_id=t.task_id where not deleted),
u as (select *, case when alo=ahi then alo when measured then known else 0 end as total from r),
v as (select *, case when complete then 0 when total>0 then greatest(total-annotated,0) end as rem, coalesce((unsized or (measured and alo is not null and total<>known) or (total>0 and total<annotated) or (total>0 and known>total) or rework) and not complete, false) as unsure from u)
select task_id, cast(nullif(total,0) as double) as total_amount, cast(annotated as bigint) as annotated_amount, cast(case when not unsure then rem end as double) as remaining_amount, case when not unsure then round(rem/chi,2) end as least_hours, case when not unsure then round(rem/clo,2) end as most_hours, waiting as pending_review_parts from v""")
def _(t, p):
    return reports.task_estimate(t, p)


@query("a3_completion", TSK, PRT, SES, sql=""", s as (select distinct part_id from fx_sessions), g as (select p.task_id, count(*) as n, count(*) filter (p.status='completed') as c, sum(coalesce(work_seconds_override, work_seconds)) as secs, count(*) filter (s.part_id is not null or work_seconds_override is not null) as t, count(submitted_at) as e, max(submitted_at) as last from fx_parts p left join s on s.part_id=p.part_id join fx_tasks k on k.task_id=p.task_id and not deleted group by 1)
select task_id, case when t=n then round(secs/3600,3) end as actual_hours, case when e=n then last end as completed_at from g where c=n""")
def _(t, p, s):
    return reports.completion(t, p, s)


LEADING = "coalesce(try_cast(nullif(regexp_extract(cast({c} as varchar), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1),'') as double),0)"
EST, CAP, AMT = (LEADING.format(c=c) for c in ("estimated_hours", "hourly_capacity", "data_amount"))
SETTLED = f""", pc as (select task_id, count(*) as total from fx_parts group by 1), r as (select part_id, p.annotator as username, coalesce(display_name,'') as display_name, product_tag, project,
 case when {EST}>0 then {EST}/total when {CAP}>0 then {AMT}/{CAP}/total else 0 end as expected_hours, coalesce(work_seconds_override, work_seconds)/3600 as actual_hours
 from fx_parts p join fx_tasks t on t.task_id=p.task_id and not deleted join pc on pc.task_id=p.task_id left join fx_users u on u.username=p.annotator where strftime(p.submitted_at,'%Y-%m-%d')=(select strftime(max(submitted_at),'%Y-%m-%d') from fx_parts where submitted_at is not null and annotator is not null))"""


def settled(t: DataFrame, p: DataFrame, u: DataFrame) -> DataFrame:
    day = str(p.where("annotator is not null").agg(F.max("submitted_at")).first()[0])[:10]
    return reports.settlement_parts(t, p, u, day)


@query("a8_settlement_parts", TSK, PRT, USR, sql=SETTLED + " select part_id, username, display_name, product_tag, project, round(expected_hours,6) as expected_hours, round(actual_hours,6) as actual_hours from r")
def _(t, p, u):
    return rounded(settled(t, p, u))


@query("a8_settlement_totals", TSK, PRT, USR, sql=SETTLED + " select count(*) as parts, round(coalesce(sum(expected_hours),0),3) as total_expected_hours, round(coalesce(sum(actual_hours),0),3) as total_actual_hours from r")
def _(t, p, u):
    return reports.settlement_totals(settled(t, p, u))


@query("a8_daily_submissions", TSK, PRT, sql=", d as (select cast(unnest(generate_series(date '1995-03-10', date '1995-03-16', interval 1 day)) as date) as day) select d.day, count(p.part_id) as parts from d left join (select part_id, cast(submitted_at as date) as day from fx_parts join fx_tasks using (task_id) where not deleted) p on p.day=d.day group by 1")
def _(t, p):
    return reports.daily_submissions(t, p, "1995-03-16", 9)


@query("a9_day_status", SES, USR, sql=", c as (select distinct annotator from fx_sessions where cast(started_at + interval 8 hour as date)=date '2024-01-11') select username, c.annotator is not null as checked_in, (select count(*) from c) as checked_in_count from fx_users left join c on c.annotator=username")
def _(s, u):
    return reports.day_status(changes.check_ins(s), u, "2024-01-11")


@query("a22_user_counts", USR, sql="select count(*) as users, count(*) filter (role='admin' and is_active) as active_admins from fx_users")
def _(u):
    return reports.user_counts(u)


@query("l8_active_users", USR, sql="select username, role from fx_users where is_active")
def _(u):
    return reports.list_users(u, True).select("username", "role")


@query("l2_review_page", PRT, sql="select part_id, status from fx_parts where annotator ilike '%u1%' order by case status when 'submitted' then 1 when 'rework' then 2 when 'in_progress' then 3 when 'paused' then 4 when 'pending' then 5 else 6 end, task_id, part_index, part_id limit 25 offset 25")
def _(p):
    return reports.review_page(p, 2, 25, like="u1")[0].select("part_id", "status")


@query("l3_directory_page", TSK, PRT, sql="select part_id, project from fx_parts p join fx_tasks t using (task_id) where not deleted and p.status='rework' and (contains(lower(product_tag),'high') or contains(lower(project),'high') or coalesce(contains(lower(annotator),'high'),false)) order by rank, task_id, part_index, part_id limit 50 offset 50")
def _(t, p):
    return reports.directory_page(t, p, 2, 50, "rework", "HIGH")[0].select("part_id", "project")


@query("l5_latest_events", SUB, sql="select event_id from fx_submissions order by submitted_at desc, event_id desc limit 200")
def _(s):
    return reports.latest(s, "submitted_at", "event_id", 200).select("event_id")


@query("w13_rank_completed", TSK, PRT, SES, sql=""", g as (select p.task_id, count(*) as n, count(*) filter (p.status='completed') as c, count(submitted_at) as e, max(submitted_at) as last from fx_parts p join fx_tasks k on k.task_id=p.task_id and not deleted group by 1)
select task_id, row_number() over (order by last desc, task_id) as place from g where c=n and e=n""")
def _(t, p, s):
    return reports.rank_completed(reports.completion(t, p, s)).select("task_id", F.col("place").cast("bigint").alias("place"))


@query("w12_first_names", SUB, sql=", n as (select annotator, 'n' || part_id%7 as name, min((submitted_at, event_id)) as f from fx_submissions group by 1,2) select annotator, string_agg(name, ',' order by f) as names from n group by 1")
def _(s):
    return reports.first_names(s.withColumn("name", F.concat(F.lit("n"), (F.col("part_id") % 7).cast("string")))).select("annotator", F.array_join("names", ",").alias("names"))


@query("a16_throughput_warning", DT, sql="select video_id as run, count(*)>=10 and count(*)/(count(*)*(1+video_id%4)*0.8)<0.5 as slow from fx_detections group by video_id")
def _(d):
    runs = d.groupBy(F.col("video_id").alias("run")).agg(F.count("*").alias("frames")).withColumns({"seconds": F.col("frames") * (1 + F.col("run") % 4) * 0.8, "batch": F.lit(5)})
    return reports.throughput_warning(runs).select("run", "slow")


@query("a19_masks", DT, sql="select video_id, object_key+1 as track_id, 0 as class_id, frame_id, cast(min(x) as bigint) as x1, cast(max(x)+1 as bigint) as x2 from (select *, unnest([cast(x1 as bigint), cast(x2 as bigint), cast(x1 as bigint)+7]) as x from fx_detections where det_idx<4) group by all having count(*)>=3")
def _(d):
    x = F.explode(F.array(*[F.col(c).cast("bigint") for c in ("x1", "x2")], F.col("x1").cast("bigint") + 7)).alias("x")
    pixels = d.where("det_idx < 4").select("video_id", "frame_id", F.col("object_key").alias("object_id"), F.lit(0).alias("class_id"), x, F.col("y1").cast("bigint").alias("y"))
    return reports.masks_to_boxes(pixels, 3).select("video_id", "track_id", "class_id", "frame_id", "x1", "x2")


@query("a21_segment_listing", TF, sql=", s as (select distinct video_id, unnest(range(0,12)) as segment from fx_track_frames), f as (select video_id, cast(floor(frame_id/20) as bigint) as segment, count(distinct frame_id) as fc, count(distinct track_id) as nt from fx_track_frames group by 1,2), a as (select video_id, cast(floor(frame_id/20) as bigint) as segment, count(*) as n from fx_track_frames where x2-x1>60 group by 1,2) select s.video_id, cast(s.segment as bigint) as segment, fc is not null as has_result, coalesce(fc,0) as frame_count, coalesce(nt,0) as num_tracks, coalesce(n,0) as anomalies from s left join f on f.video_id=s.video_id and f.segment=s.segment left join a on a.video_id=s.video_id and a.segment=s.segment")
def _(t):
    at = F.floor(F.col("frame_id") / 20).cast("bigint").alias("segment")
    segments = t.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("segment"))
    return reports.segment_listing(segments, t.select("video_id", at, "frame_id", "track_id"), t.where("x2 - x1 > 60").select("video_id", at))


@query("a15_validate_job", DT, sql=", f as (select video_id as job, count(*) filter (det_idx<>3) as l, count(*) filter (det_idx<>4) as a, count(*) as c from fx_detections group by 1) select job, array_to_string(list_filter([case when l<>c then 'labels ' || l || ' of ' || c end, case when a<>c then 'annotations ' || a || ' of ' || c end], lambda x: x is not null), ',') as errors from f")
def _(d):
    job = F.col("video_id").alias("job")
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("det_idx") != 3, "labels"), F.when(F.col("det_idx") != 4, "annotations"), F.lit("copied")))).alias("kind")
    found = reports.validate_job(d.select(job, kinds), d.select(job), d.groupBy(job).agg(F.count("*").alias("images")))
    return found.select("job", F.array_join("errors", ",").alias("errors"))


@query("a13_precision_recall", DT, sql=compared_sql("(video_id%5*9)") + """, f as (select video_id%5 as run, frame_id, sum(x1)/1000 as seconds, count(*) as boxes from fx_detections group by all),
q as (select run, count(*) as frames, count(*)/sum(seconds) as fps, sum(boxes)/sum(seconds) as bps, median(seconds) as p50, list_sort(list(seconds))[cast(floor((count(*)-1)*0.95) as int)+1] as p95 from f group by run),
m as (select video_id%5 as run, sum(tp) as tp, sum(extra) as extra, sum(missed) as missed from cmp where video_id%5<>0 group by 1)
select q.run, frames, round(fps,6) as fps, round(bps,6) as boxes_per_second, round(p50,6) as p50, round(p95,6) as p95, round(fps/(select fps from q where run=0),6) as speed_up,
round(tp/nullif(tp+extra,0),6) as precision, round(tp/nullif(tp+missed,0),6) as recall from q left join m on m.run=q.run""")
def _(d):
    other = d.where("det_idx % 5 <> 4").withColumn("x1", F.col("x1") + F.col("video_id") % 5 * 9).withColumn("x2", F.col("x2") + F.col("video_id") % 5 * 9)
    compared = boxes.compare_box_sets(fusion.iou_join(d, other, 0.5), d, other).withColumn("run", F.col("video_id") % 5)
    frames = d.groupBy((F.col("video_id") % 5).alias("run"), "frame_id").agg((F.sum("x1") / 1000).alias("seconds"), F.count("*").alias("boxes"))
    return rounded(boxes.summarize_runs(frames, 0, compared))


# Edits and events


@query("u6_upsert_boxes", TF, VID, sql="select video_id, track_id, class_id, frame_id, case when frame_id%10=0 then least(greatest(x1-500,0),1920) else x1 end as x1, case when frame_id%10=0 then least(greatest(x2-500,0),1920) else x2 end as x2 from fx_track_frames")
def _(t, v):
    new = t.where("frame_id % 10 = 0").withColumns({"x1": F.col("x1") - 500, "x2": F.col("x2") - 500})
    return reports.upsert_boxes(t, new, v).select("video_id", "track_id", "class_id", "frame_id", "x1", "x2")


@query("u9_upsert", USR, sql="select username, case when username like '%3' then 'renamed' else display_name end as display_name, role, is_active from fx_users union all select 'v' || username, display_name, role, is_active from fx_users where username like '%5'")
def _(u):
    old = u.where("username like '%3'").withColumn("display_name", F.lit("renamed"))
    new = u.where("username like '%5'").withColumn("username", F.concat(F.lit("v"), "username"))
    versions = old.withColumn("version", F.lit(2)).unionByName(old.withColumn("display_name", F.lit("older")).withColumn("version", F.lit(1))).unionByName(new.withColumn("version", F.lit(1)))
    return reports.upsert(u, versions, ["username"])


@query("u10_legacy_events", PRT, SUB, sql="select part_id, annotator, submitted_at, cast(coalesce(progress_count,0) as bigint) as cumulative, cast(0 as bigint) as credited, 'legacy_import' as kind from fx_parts p where status in ('submitted','completed') and not exists (select 1 from fx_submissions s where s.part_id=p.part_id)")
def _(p, s):
    return reports.legacy_events(p, s)


@query("e2_paired_sessions", ACT, sql="select part_id, actor, started_at, ended_at, round(epoch(ended_at)-epoch(started_at),1) as seconds from (select part_id, actor, action, ts as started_at, case when lead(action) over w in ('pause','submit','return') then lead(ts) over w end as ended_at from fx_actions where action in ('resume','rework','pause','submit','return') window w as (partition by part_id order by ts, action_id)) where action in ('resume','rework')")
def _(a):
    return rounded(lifecycle.paired_sessions(a, ["resume", "rework"], ["pause", "submit", "return"]), 1)


for kind in ("parts", "sessions", "events", "rejects", "comments"):
    query(f"e1_replay_{kind}", ACT, ATK, APT)(lambda a, t, p, kind=kind: lifecycle.replay(a, t, p)[kind])


EDITS = """, e as (select part_id as edit_id, part_id, case part_id%5 when 0 then 'u0' when 1 then coalesce(annotator,'x') when 2 then 'u20' when 3 then publisher else 'x' end as actor, case when part_id%7=0 then 'n' end as name,
 case when part_id%7=1 then cast(image_count-5 as bigint) end as image_count, case when part_id%7=2 then cast(9 as bigint) end as progress_count, case when part_id%7=3 then cast(part_id%3-1 as bigint) end as bbox_count, case when part_id%7=4 then cast(part_id%5-1 as double)*1000000 end as work_seconds from fx_parts p join fx_tasks t using (task_id))"""


@query("e8_validate_edits", PRT, TSK, USR, sql=EDITS + """, r as (select e.*, coalesce(publisher=actor,false) or exists (select 1 from fx_users u where u.username=actor and role='admin' and is_active) as owns, coalesce(annotator=actor,false) as mine, p.status, p.progress_count as credited from e join fx_parts p using (part_id) join fx_tasks t using (task_id))
select edit_id, case when work_seconds is not null and not (work_seconds between 0 and 2678400) then 'work_seconds' when work_seconds is not null and not owns then 'permission' when bbox_count is not null and bbox_count<0 then 'bbox_count'
 when bbox_count is not null and not owns and not (mine and status in ('in_progress','paused','rework','submitted')) then 'permission' when not owns and (name is not null or image_count is not null) then 'permission' when owns and image_count<credited then 'image_count' when progress_count is not null and not mine then 'permission' end as reason from r""")
def _(p, t, u):
    both = p.join(t.select("task_id", "publisher"), "task_id")
    e = both.selectExpr("part_id as edit_id", "part_id", "case part_id%5 when 0 then 'u0' when 1 then coalesce(annotator,'x') when 2 then 'u20' when 3 then publisher else 'x' end as actor", "case when part_id%7=0 then 'n' end as name", "cast(null as string) as work_path",
                        "case when part_id%7=1 then cast(image_count-5 as bigint) end as image_count", "case when part_id%7=2 then cast(9 as bigint) end as progress_count", "case when part_id%7=3 then cast(part_id%3-1 as bigint) end as bbox_count", "case when part_id%7=4 then cast(part_id%5-1 as double)*1000000 end as work_seconds")
    return lifecycle.validate_edits(e, p, t, u, p.select("part_id", F.col("progress_count").alias("credited"))).select("edit_id", "reason")


@query("e11_daily_snapshot", TSK, PRT, sql="select task_id, publisher, date '2024-01-31' as report_date from fx_tasks where not deleted and status<>'completed'")
def _(t, p):
    return lifecycle.daily_snapshot(t, reports.task_estimate(t, p), "2024-01-31").select("task_id", "publisher", "report_date")


@query("e11_visible_counts", TSK, PRT, USR, sql=", s as (select task_id, publisher, manager from fx_tasks where not deleted and status<>'completed'), n as (select username, count(*) as own from (select distinct task_id, unnest([publisher, manager]) as username from s) group by 1) select u.username, case when role='admin' then (select count(*) from s) else coalesce(own,0) end as tasks from fx_users u left join n on n.username=u.username where is_active")
def _(t, p, u):
    return lifecycle.visible_counts(lifecycle.daily_snapshot(t, reports.task_estimate(t, p), "2024-01-31"), u)


# Frames and fusion


@query("n1_validate_plans", VID, sql="select video_id, case when video_id%3=0 then 'bounds,overlap' when video_id%3=1 then 'default_interval,interval' end as errors from fx_videos where video_id%3<2")
def _(v):
    plans = v.select("video_id", F.when(F.col("video_id") % 3 == 1, -1).otherwise(10).alias("default_interval"))
    s = F.expr("case video_id%3 when 0 then array(struct(5 as s, 20 as e, 4 as i), struct(20 as s, 60 as e, 4 as i)) when 1 then array(struct(5 as s, 20 as e, 0 as i)) else array(struct(0 as s, 49 as e, 1 as i)) end")
    segments = v.select("video_id", F.explode(s).alias("x")).select("video_id", F.col("x.s").alias("start_frame"), F.col("x.e").alias("end_frame"), F.col("x.i").alias("interval"))
    return sampling.validate_plans(plans, segments, v).select("video_id", F.array_join("errors", ",").alias("errors"))


@query("n5_plan_stats", VID, sql="select video_id, cast(7 as bigint) as n, 5 as first, 31 as last from fx_videos")
def _(v):
    segments = v.select("video_id", F.lit(5).alias("start_frame"), F.lit(31).alias("end_frame"), F.lit(5).alias("interval"))
    return sampling.plan_stats(sampling.segment_frames(segments))


@query("n8_uniform_sample", DT, sql="select video_id, frame_id, det_idx from (select *, row_number() over (partition by video_id order by frame_id, det_idx) as r from fx_detections) where (r-1)%7=0")
def _(d):
    return sampling.uniform_sample(d, 7, ["frame_id", "det_idx"], ["video_id"]).select("video_id", "frame_id", "det_idx")


@query("n11_inference_frames", VID, sql="select video_id, f as frame, f+frame_offset as frame_id, f>=4 and f<34 and (f-4)%3=0 as chosen from (select *, cast(unnest(range(0, frame_count)) as int) as f from fx_videos)")
def _(v):
    return sampling.inference_frames(v, 4, 30, 3)


@query("l1_task_order", TSK, PRT, sql=", d as (select task_id, bool_and(status='completed') as done from fx_parts group by 1) select t.task_id from fx_tasks t left join d on d.task_id=t.task_id where not deleted")
def _(t, p):
    return work.task_order(t, p.groupBy("task_id").agg(F.bool_and(F.col("status") == "completed").alias("done"))).select("task_id")


CAND = f", {PAIRS}, c as (select *, round(score,9) as s from cand where mean_iou>=0.3 and normalized_gap<=1.5), rk as (select *, row_number() over (partition by video_id, f_idx order by s desc, b_idx) as rf, row_number() over (partition by video_id, b_idx order by s desc, f_idx) as rb from c), mb as (select * from rk where rf=1 and rb=1), fw as (select distinct video_id, idx from fwd), bw as (select distinct video_id, idx from bwd)"
FORWARD = "select video_id, 'forward' as direction, idx as tracklet_idx, 'f' || idx as component from fw"
PAIRED = "select video_id, 'backward' as direction, b_idx as tracklet_idx, 'f' || f_idx as component from mb"
FUSION = {
    "f1_bidirectional": ("bidirectional_iou", f"{FORWARD} union all {PAIRED} union all select video_id, 'backward', idx, 'b' || idx from bw where (video_id, idx) not in (select (video_id, b_idx) from mb)"),
    "f2_forward_only": ("forward_only", FORWARD),
    "f3_backward_only": ("backward_only", "select video_id, 'backward' as direction, idx as tracklet_idx, 'b' || idx as component from bw"),
    "f4_forward_primary": ("bidirectional_iou_forward_primary", f"{FORWARD} union all {PAIRED}"),
    "f5_forward_unique": ("bidirectional_iou_forward_unique", f"{FORWARD} union all {PAIRED} union all select video_id, 'backward', idx, 'b' || idx from bw where (video_id, idx) not in (select (video_id, b_idx) from c)"),
}
for name, (method, sql) in FUSION.items():
    query(name, DT, sql=f"{CAND} {sql}")(lambda d, method=method: fusion.fuse(*sides(d), method, 0.3).select("video_id", "direction", "tracklet_idx", "component"))

ORACLES["f6_all_pairs_components"] = oracle(f"""{CAND}, n as (select distinct video_id, 'f' || f_idx as node, 'forward' as direction, f_idx as idx from c union select video_id, 'b' || b_idx, 'backward', b_idx from c),
e as (select video_id, 'f' || f_idx as a, 'b' || b_idx as z from c union select video_id, 'b' || b_idx, 'f' || f_idx from c),
reach as (select video_id, node as a, node as z from n union select r.video_id, r.a, e.z from reach r join e on e.video_id=r.video_id and e.a=r.z),
root as (select r.video_id, r.a, min((m.direction, m.idx)) as low from reach r join n m on m.video_id=r.video_id and m.node=r.z group by 1,2)
select n.video_id, direction, idx as tracklet_idx, dense_rank() over (partition by n.video_id order by low) as component from n join root on root.video_id=n.video_id and root.a=n.node""", DT).replace("with ", "with recursive ", 1)

ORACLES["f8_merge_components"] = oracle(merged_sql(CAND) + F8, DT, VID).replace("with ", "with recursive ", 1)
ORACLES["f9_final_tracks"] = oracle(merged_sql(CAND) + final_sql(5, 2), DT, VID).replace("with ", "with recursive ", 1)

ORACLES["f7_suppression"] = oracle(suppressed_sql(CAND, FUSION["f1_bidirectional"][1], 0.3), DT)

CORNERS = "[('xmin', cast(greatest(round_even(a,0),0) as bigint)), ('ymin', cast(greatest(round_even(c,0),0) as bigint)), ('xmax', cast(least(round_even(b,0),1920) as bigint)), ('ymax', cast(least(round_even(d,0),1080) as bigint))]"
ORACLES["k5_voc"] = oracle(f""", q as (select *, video_id || '_' || frame_id as image, least(greatest(x1,0),1920) as a, least(greatest(x2,0),1920) as b, least(greatest(y1,0),1080) as c, least(greatest(y2,0),1080) as d from fx_detections),
o as (select image, string_agg('<object><name>class ' || class_id || '</name><pose>Unspecified</pose><truncated>' || (a<=0 or c<=0 or b>=1920 or d>=1080)::int || '</truncated><difficult>0</difficult><bndbox>' || array_to_string(list_transform({CORNERS}, lambda t: '<' || t[1] || '>' || t[2] || '</' || t[1] || '>'), '') || '</bndbox></object>', '' order by det_idx) as t from q where b>a and d>c group by 1)
select image, '<annotation><folder>images</folder><filename>' || image || '</filename><size><width>1920</width><height>1080</height><depth>3</depth></size><segmented>0</segmented>' || coalesce(t,'') || '</annotation>' as xml from (select distinct image from q) left join o using (image)""", DT)


@query("f7_suppression", DT)
def _(d):
    return fusion.fuse(*sides(d), "bidirectional_iou_nms", 0.3)


# Accounts, parameters and texts


@query("x11_applicants", TSK, USR, sql="""select task_id, case when error is null then case when a.is_active then a.username when d.ok then d.username else applicant end end as resolved, error from (
select r.*, case when applicant<>'' and not a.is_active then 'inactive' when applicant<>'' and d.n>1 then 'ambiguous' end as error from (select task_id, case task_id%4 when 0 then upper(publisher) when 1 then 'user ' || substr(publisher,2) when 2 then 'nobody' else '' end as applicant from fx_tasks) r
left join fx_users a on lower(a.username)=lower(applicant) left join (select lower(display_name) as k, count(*) as n, min(username) as username, bool_and(is_active) as ok from fx_users group by 1) d on d.k=lower(applicant)) e
left join fx_users a on lower(a.username)=lower(applicant) left join (select lower(display_name) as k, min(username) as username, bool_and(is_active) as ok from fx_users group by 1) d on d.k=lower(applicant)""")
def _(t, u):
    name = F.expr("case task_id%4 when 0 then upper(publisher) when 1 then concat(' user ', substr(publisher,2)) when 2 then 'nobody' else '' end")
    return reports.resolve_applicants(t.select("task_id", name.alias("applicant")), u).select("task_id", "resolved", "error")


@query("x15_overlaid", VID, sql="select video_id, name, case when name='tracking.iou' and video_id%3=0 then '0.5' when name='tracking.iou' and video_id%2=0 then '0.4' when name='tracking.iou' then '0.3' else '15' end as value from fx_videos, (select unnest(['tracking.iou','tracking.max_missed']) as name)")
def _(v):
    row = lambda level, name, value: v.select("video_id", F.lit(level).alias("level"), F.lit(name).alias("name"), value.alias("value"))
    levels = row(0, "tracking.iou", F.lit("0.3")).unionByName(row(0, "tracking.max_missed", F.lit("15"))).unionByName(row(1, "tracking.iou", F.when(F.col("video_id") % 2 == 0, "0.4"))).unionByName(row(2, "tracking.iou", F.when(F.col("video_id") % 3 == 0, "0.5")))
    return reports.overlaid(levels, ["video_id"])


@query("p1_search", TSK, sql="select task_id from fx_tasks where contains(lower(concat_ws(' ', product_tag, project, publisher, status, manager, data_amount, hourly_capacity)), 'high f')")
def _(t):
    return reports.search(t.select("task_id", "product_tag", "project", "publisher", "status", "manager", "data_amount", "hourly_capacity"), " HIGH F").select("task_id")


@query("p4_layout_errors", TSK, sql="select task_id as job, case task_id%4 when 0 then '/in/' || task_id || '/out/' || f when 1 then '/in' || '/' || f else '/o/' || f end as destination from fx_tasks, (select unnest(['labels','annotations']) as f) where task_id%4=0")
def _(t):
    jobs = t.select(F.col("task_id").alias("job"), F.concat(F.lit("/in/"), "task_id").alias("input"), F.expr("case task_id%4 when 0 then concat('/in/', task_id, '/out/') when 1 then '/in/' else '/o' end").alias("output"))
    return reports.layout_errors(jobs)


OVERVIEW = "o as (select t.task_id, product_tag, project, rank, coalesce(c,0) as completed, coalesce(n,0) as total, case when coalesce(n,0)=0 then 'awaiting_parts' when c=n then 'completed' when p=n then 'pending' when s+c=n then 'submitted' when a>0 then 'in_progress' else 'mixed' end as state from fx_tasks t left join (select task_id, count(*) as n, count(*) filter (status='completed') as c, count(*) filter (status='pending') as p, count(*) filter (status='submitted') as s, count(*) filter (status in ('in_progress','paused','rework')) as a from fx_parts group by 1) q on q.task_id=t.task_id where not deleted)"
_SCHEDULE = ORACLES["w11_schedule"].split("select task_id, round(hours,6)")[0]
ORACLES["e13_digest_lines"] = (
    _SCHEDULE
    + ", w as (select task_id, hours, case when days is not null then list_filter(list_transform(range(0, days*2+8), lambda i: date '2024-02-02' + cast(i as int)), lambda x: isodow(x)<6)[days] end as due from e), "
    + OVERVIEW
    + " select w.task_id, product_tag || ' | ' || project || ' | ' || case state "
    + " ".join(f"when '{k}' then '{v}'" for k, v in reports.STATES.items())
    + f" end || ' | ' || completed || '/' || total || ' | ' || printf('%.2f', floor(hours*100+0.5)/100) || 'h | ' || coalesce(cast(due as varchar), '{reports.UNKNOWN_DATE}') as line from w join o on o.task_id=w.task_id where state<>'completed' order by due nulls last, case when coalesce(rank,0)<>0 then rank else 1000000000 end, w.task_id limit 5"
)


@query("e13_digest_lines", TSK, PRT)
def _(t, p):
    done = p.groupBy("task_id").agg(F.bool_and(F.col("status") == "completed").alias("done"))
    return reports.digest_lines(work.task_overview(t, p), work.schedule(t, done, 5000, "2024-02-02"), t)
