"""Registered queries of listings, manifests, documents and exports, over paths and rows derived from the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import sampling, tracks
from trackloom.plans.catalog import DT, PRT, SUB, TF, TSK, VID, query, rounded
from trackloom.sources import files, labels

#: Paths of three files for most frames of the videos, one data set for each third of them.
PATHS = """select '/d/' || video_id%3 || '/' || k || '/v' || video_id || '_' || frame_id || s as path, 1 as length from (select distinct video_id, frame_id from fx_detections) d
 cross join (select 'images' as k, '.jpg' as s union all select 'labels', '.txt' union all select 'annotations', '.xml') n where not (k='labels' and video_id%10=3 and frame_id=7) and not (k='images' and video_id%10=4 and frame_id=9)"""


def paths(d: DataFrame) -> DataFrame:
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in (("images", ".jpg"), ("labels", ".txt"), ("annotations", ".xml"))])).alias("n")
    rows = d.select("video_id", "frame_id").distinct().select("video_id", "frame_id", kind).select("video_id", "frame_id", "n.*")
    rows = rows.where("not (k='labels' and video_id%10=3 and frame_id=7) and not (k='images' and video_id%10=4 and frame_id=9)")
    return rows.select(F.expr("'/d/' || video_id%3 || '/' || k || '/v' || video_id || '_' || frame_id || s").alias("path"), F.lit(1).alias("length"))


@query("s8_samples", DT, sql="select 'v' || video_id || '_' || frame_id as stem, '/d/' || video_id%3 as root from (select distinct video_id, frame_id from fx_detections) where not (video_id%10=3 and frame_id=7) and not (video_id%10=4 and frame_id=9)")
def _(d):
    return files.scan_samples(paths(d))[0].select("stem", "root")


@query("s8_errors", DT, sql="select '/d/' || video_id%3 as root, '/d/' || video_id%3 || '/images/v' || video_id || '_7.jpg' as path, 'no label' as error from (select distinct video_id from fx_detections where frame_id=7) where video_id%10=3")
def _(d):
    return files.scan_samples(paths(d))[1]


@query("s8_warnings", DT, sql="select '/d/' || video_id%3 as root, count(*) as labels, count(*) as annotations from (select distinct video_id from fx_detections where frame_id=9) where video_id%10=4 group by 1")
def _(d):
    return files.scan_samples(paths(d))[2]


@query("s9_work_folders", DT, sql=f", p as ({PATHS}), f as (select regexp_extract(path, '^/(d/[0-9]+)/', 1) as relative_path, path from p) select relative_path, cast(2 as bigint) as depth, 'annotations,images,labels' as markers, count(*) filter (contains(path,'/images/')) as image_count from f group by 1")
def _(d):
    found = files.discover_folders(paths(d), "/", ["images", "labels", "annotations"], 4, 2)
    return found.select("relative_path", F.col("depth").cast("bigint").alias("depth"), F.array_join("markers", ",").alias("markers"), "image_count")


@query("s10_image_folders", DT, sql=f", p as ({PATHS}) select regexp_replace(path,'/[^/]*$','') as folder, count(*) as images from p where path like '%.jpg' group by 1")
def _(d):
    return files.list_image_folders(paths(d), "/out", paths(d).limit(0)).select("folder", "images")


@query("s10_media", DT, sql=f", p as ({PATHS}) select path from p where path like '/d/1/%.jpg'")
def _(d):
    return files.list_media(paths(d), "/d/1")[0].select("path")


MANIFEST = "case part_id%5 when 0 then 'p/' || part_id when 1 then 'p\\' || part_id || chr(9) || part_index when 2 then 'n' || part_index || chr(9) || '/abs/' || part_id when 3 then 'n' || chr(9) || 'q/' || task_id || chr(9) || 'x' else 'same' || chr(9) || chr(9) || '3' end"


@query("s7_manifest", PRT, sql="select part_id as line_no, case part_id%5 when 0 then 'p / ' || part_id when 1 then 'p / ' || part_id else 'n' || part_index end as name, case part_id%5 when 0 then '/data/p/' || part_id when 1 then '/data/p/' || part_id else '/abs/' || part_id end as work_path, case part_id%5 when 1 then part_index end as image_count from fx_parts where part_id%5<3")
def _(p):
    lines = p.select(F.col("part_id").alias("line_no"), F.expr(MANIFEST.replace("'p\\'", "'p\\\\'")).alias("value"))
    return files.parse_manifest(lines, "/data/")[0]


@query("s7_manifest_errors", PRT, sql="select part_id as line_no, case part_id%5 when 3 then 'count' else 'path' end as error from fx_parts where part_id%5>=3")
def _(p):
    lines = p.select(F.col("part_id").alias("line_no"), F.expr(MANIFEST.replace("'p\\'", "'p\\\\'")).alias("value"))
    return files.parse_manifest(lines, "/data/")[1]


@query("s6_task_table", TSK, sql="select task_id as line_no, case when task_id%3=0 then '' else project end as project, data_amount, publisher as applicant from fx_tasks where task_id%3<>0")
def _(t):
    rows = t.select(F.col("task_id").alias("line_no"), F.concat_ws("\t", F.col("data_amount"), F.lit("x"), F.when(F.col("task_id") % 3 == 0, "").otherwise(F.col("project")), F.col("publisher")).alias("value"))
    head = rows.sparkSession.createDataFrame([(-1, "数据量\t无关\t项目\t申请人")], "line_no bigint, value string")
    return files.parse_task_table(head.unionByName(rows)).select("line_no", "project", "data_amount", "applicant")


@query("s13_dimensions", VID, sql="select 'cam' || video_id || '_1920_1080_' || (20+video_id%10) || '_x.mp4' as video, case when video_id%10=5 then 640 else 1920 end as width, case when video_id%10=5 then 25 else 20+video_id%10 end as fps from fx_videos where video_id%10<>5 union all select 'cam' || video_id || '_19_1080_25.mp4', 640, 25 from fx_videos where video_id%10=5")
def _(v):
    name = F.expr("case when video_id%10=5 then 'cam' || video_id || '_19_1080_25.mp4' else 'cam' || video_id || '_1920_1080_' || (20+video_id%10) || '_x.mp4' end")
    named = v.select(name.alias("video"))
    supplied = named.select("video", F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(25).alias("fps"))
    return files.video_dimensions(named, supplied).select("video", "width", F.col("fps").cast("bigint").alias("fps"))


@query("j14_prelabels", DT, sql=", v as (select distinct video_id from fx_detections), n as (select video_id, count(*) filter (det_idx%2=0) as labels from fx_detections where video_id%4<>0 group by 1) select '/v/V' || v.video_id || '.mp4' as video, case when n.video_id is null then 'skipped' when labels=0 then 'skipped' else 'ready' end as status from v left join n on n.video_id=v.video_id")
def _(d):
    videos = d.select(F.concat(F.lit("/v/V"), "video_id", F.lit(".mp4")).alias("path")).distinct()
    labelled = d.where("video_id % 4 <> 0").select(F.expr("'/p/v' || video_id || '/' || frame_id || '_' || det_idx || (case when det_idx%2=0 then '.txt' else '.xml' end)").alias("path"))
    return files.prelabel_plan(videos, labelled).select("video", "status")


@query("k2_flat_rows", TF, VID, sql="select t.video_id, frame_id, track_id, cast(case when ok then round_even(a,0) else 0 end as int) as x1, cast(case when ok then round_even(d,0) else 0 end as int) as y2 from (select *, b>a and d>c as ok from (select t.*, least(greatest(x1,0),1919) as a, least(greatest(x2,0),1919) as b, least(greatest(y1,0),1079) as c, least(greatest(y2,0),1079) as d from fx_track_frames t)) t join fx_videos v on v.video_id=t.video_id")
def _(t, v):
    return files.flat_rows(t, v).select("video_id", "frame_id", "track_id", "x1", "y2")


@query("k1_tracking_documents", TF, VID, sql="select v.video_id, coalesce(n,0) as num_tracks, frames, first from fx_videos v left join (select video_id, count(distinct track_id) as n, count(*) as frames, min(frame_id) as first from fx_track_frames group by 1) t on t.video_id=v.video_id")
def _(t, v):
    docs = labels.to_tracking_results(t, v)
    kind = "struct<metadata:struct<num_tracks:bigint>,tracks:array<struct<num_frames:bigint,start_frame_id:bigint>>>"
    d = docs.select("video_id", F.from_json("document", kind).alias("d"))
    total = F.aggregate("d.tracks", F.lit(0).cast("bigint"), lambda a, x: a + x["num_frames"])
    return d.select("video_id", F.col("d.metadata.num_tracks").alias("num_tracks"), F.when(F.size("d.tracks") > 0, total).alias("frames"), F.array_min(F.transform("d.tracks", lambda x: x["start_frame_id"])).alias("first"))


@query("k6_keyframe_documents", TF, VID, sql=", r as (select t.*, max(video_frame_idx) over (partition by t.video_id, track_id) as last, dense_rank() over (partition by t.video_id order by track_id)-1 as item from fx_track_frames t join fx_videos v on v.video_id=t.video_id) select cast(video_id as varchar) as document, item, video_frame_idx+1 as frame, true as enabled, round(x1/1920*100,6) as x from r union all select cast(r.video_id as varchar), item, video_frame_idx+2, false, round(x1/1920*100,6) from r join fx_videos v on v.video_id=r.video_id where video_frame_idx=last and last+1<frame_count")
def _(t, v):
    docs = files.to_label_studio(t, v.withColumn("video_path", F.lit("a.mp4"))).select(F.col("video_id").cast("string").alias("document"), F.col("document").alias("value"))
    rows = files.label_studio_keyframes(docs)
    return rounded(rows.select("document", F.col("item").cast("bigint").alias("item"), F.col("frame").cast("bigint").alias("frame"), "enabled", "x"))


@query("s12_projects", TF, sql="select video_id, track_id, class_id, frame_id, x1, x2 from fx_track_frames")
def _(t):
    return files.read_projects(files.project_documents(t)).select("video_id", "track_id", "class_id", "frame_id", "x1", "x2")


@query("k7_anomaly_documents", TF, sql="select video_id, count(distinct track_id) as tracks from fx_track_frames group by 1")
def _(t):
    docs = files.anomaly_documents(*tracks.area_anomalies(t), {"high": 3.0})
    return docs.select("video_id", F.size(F.from_json("document", "struct<tracks:array<struct<track_id:bigint>>>")["tracks"]).cast("bigint").alias("tracks"))


@query("n4_export_sampled", DT, VID, sql="select v.video_id, f as frame, count(d.video_id) as boxes from (select video_id, cast(unnest(range(0, frame_count, 7)) as bigint) as f from fx_videos) v left join fx_detections d on d.video_id=v.video_id and d.video_frame_idx=f group by all")
def _(d, v):
    at = v.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("frame_count") - 1).cast("bigint"), F.lit(7).cast("bigint"))).alias("frame"))
    out = sampling.export_sampled(d.withColumn("track_id", F.col("object_key")), at, v)
    return out.select("video_id", "frame", F.col("boxes").cast("bigint").alias("boxes"))


@query("n9_tiered_sample", TF, VID, sql=""", m as (select video_id, video_frame_idx as f, sqrt(power((x1+x2)/2-lag((x1+x2)/2) over w,2)+power((y1+y2)/2-lag((y1+y2)/2) over w,2)) as m
 from fx_track_frames window w as (partition by video_id, track_id order by video_frame_idx)),
p as (select video_id, f, sum(m) as m, count(m) as n from m group by all),
scores as (select video_id, k, sum(m)/greatest(sum(n),1) as s from (select *, unnest(range(cast(greatest(ceil((f-59)/15),0) as bigint), cast(floor(f/15) as bigint)+1)) as k from p) group by all),
grid as (select video_id, unnest(range(0, cast(frame_count as bigint))) as f from fx_videos),
best as (select g.video_id, g.f, coalesce(max(s),0) as s from (select *, unnest(range(cast(greatest(ceil((f-59)/15),0) as bigint), cast(floor(f/15) as bigint)+1)) as k from grid) g left join scores c on c.video_id=g.video_id and c.k=g.k group by 1,2),
cuts as (select video_id, quantile_cont(s,0.5) as a, quantile_cont(s,0.75) as b, quantile_cont(s,0.9) as c from best group by 1)
select b.video_id, f as frame from best b join cuts q on q.video_id=b.video_id where f % (case when s>c then 2 when s>q.b then 5 when s>a then 10 else 20 end)=0""")
def _(t, v):
    return sampling.tiered_sample(t, v)


@query("n10_select_frames", VID, sql="select video_id, f as frame, 'v' || video_id || '_' || (f+1) as name from (select video_id, unnest(range(0, cast(frame_count as bigint), 12)) as f from fx_videos)")
def _(v):
    return sampling.select_frames(v.withColumn("stem", F.concat(F.lit("v"), "video_id")), 12)


@query("n12_benchmark_frames", VID, sql="select video_id, k as position, 5+k*9 as frame, k<1 as warm_up from (select video_id, frame_count, unnest(range(0,9)) as k from fx_videos) where 5+k*9<frame_count")
def _(v):
    return sampling.benchmark_frames(v, 5, 9, 8)


@query("n13_answer_labels", SUB, sql="select cast(event_id as varchar) as image, case when event_id%3=0 then '' else '4 ' || printf('%.6f', floor((200+event_id%100)/1000.0*1e6+0.5)/1e6) || ' 0.300000 ' || printf('%.6f', floor(0.2*1e6+0.5)/1e6) || ' 0.200000 1.000000' end as content from fx_submissions")
def _(s):
    answer = F.when(F.col("event_id") % 3 != 0, F.expr("'<ref>Car </ref><box><' || (100+event_id%100) || '><200><' || (300+event_id%100) || '><400></box>'"))
    rows = s.select(F.col("event_id").cast("string").alias("image"), F.lit(1000).alias("width"), F.lit(1000).alias("height"), answer.alias("answer"))
    return labels.answers_to_labels(rows, F.create_map(F.lit("car"), F.lit(4))).select("image", "content")
