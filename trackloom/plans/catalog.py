"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import boxes, changes, fusion, joins, sampling, tracking, tracks, work
from trackloom.plans.fixtures import NOW, WINDOW, fixture, oracle
from trackloom.plans.tracker_sql import tracker_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TF, DT, VID, USR, TSK, PRT, SES, SUB = "fx_track_frames", "fx_detections", "fx_videos", "fx_users", "fx_tasks", "fx_parts", "fx_sessions", "fx_submissions"


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Registers f(*views) under a name, with its SQL over the same views."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[fixture(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def moment(text: str) -> Column:
    return F.expr(text)


AREA = "greatest(x2-x1,0)*greatest(y2-y1,0)"
VALID = f"case when {AREA}>=1 then {AREA} end"
PROFILE = f"""stats as (select video_id, track_id, count({VALID}) as n_valid, quantile_cont({VALID},0.5) as med, quantile_cont({VALID},0.1) as lo, quantile_cont({VALID},0.9) as hi
 from fx_track_frames group by all),
mads as (select t.video_id, t.track_id, quantile_cont(case when {AREA}>=1 then abs({AREA}-med) end,0.5) as m from fx_track_frames t join stats s on t.video_id=s.video_id and t.track_id=s.track_id group by all),
profile as (select s.video_id, s.track_id, n_valid, case when n_valid>=5 then med else 0 end as median, case when n_valid>=5 then lo else 0 end as p10,
 case when n_valid>=5 then hi else 0 end as p90, case when n_valid>=5 then m else 0 end as mad from stats s join mads d on s.video_id=d.video_id and s.track_id=d.track_id)"""
FLAGGED = f"""rows as (select t.video_id, t.track_id, frame_id, {AREA} as area, median, mad, last_value({VALID} ignore nulls) over (partition by t.video_id, t.track_id order by frame_id rows between unbounded preceding and 1 preceding) as previous
 from fx_track_frames t join profile p on t.video_id=p.video_id and t.track_id=p.track_id where n_valid>=5),
measured as (select *, case when median>0 then area/median else 0 end as ratio, case when mad>0 then 0.6745*(area-median)/mad else 0 end as robust_z, case when previous>0 then greatest(area,previous)/greatest(least(area,previous),1e-9) end as change from rows),
flagged as (select *, list_filter([case when area<1 then 'degenerate_area' when ratio>=3 then 'high_area_ratio' when ratio<=0.3 then 'low_area_ratio' end,
 case when area>=1 and change>=2 and abs(area-previous)>=500 then 'frame_area_jump' end, case when area>=1 and abs(robust_z)>=6 then 'robust_z' end], lambda x: x is not null) as reasons from measured)"""


@query("a14_area_profile", TF, sql=f", {PROFILE} select video_id, track_id, n_valid, round(median,6) as median, round(p10,6) as p10, round(p90,6) as p90, round(mad,6) as mad from profile")
def _(t):
    return rounded(tracks.area_profile(t))


@query("q1_area_anomalies", TF, sql=f", {PROFILE}, {FLAGGED}, marked as (select *, case when frame_id-lag(frame_id) over w > 3 then 1 when lag(frame_id) over w is null then 1 else 0 end as fresh from flagged where len(reasons)>0 window w as (partition by video_id, track_id order by frame_id)), numbered as (select *, sum(fresh) over (partition by video_id, track_id order by frame_id) as segment from marked) select video_id, track_id, cast(segment as bigint) as segment, min(frame_id) as start_frame, max(frame_id) as end_frame, count(*) as n_frames, round(min(area),6) as min_area, round(max(area),6) as max_area, round(min(ratio),6) as min_ratio, round(max(ratio),6) as max_ratio, round(max(change),6) as max_change, round(max(abs(robust_z)),6) as max_abs_z, array_to_string(list_sort(list_distinct(flatten(list(reasons)))),',') as reasons from numbered group by video_id, track_id, segment")
def _(t):
    return rounded(tracks.area_anomalies(t)[1].withColumn("reasons", F.array_join("reasons", ",")).withColumn("segment", F.col("segment").cast("bigint")))


@query("w1_smooth_tracks", TF, VID, sql="""select video_id, track_id, class_id, frame_id, video_frame_idx, """ + ", ".join(f"round(case when n>1 then (case when cx2>cx1 and cy2>cy1 then c{c} else {c} end) else {c} end,6) as {c}" for c in tracks.BOX) + """ from (select *, """ + ", ".join(f"least(greatest(s{c},0), {'1919' if 'x' in c else '1079'}) as c{c}" for c in tracks.BOX) + """ from (select t.*, """ + ", ".join(f"avg({c}) over w as s{c}" for c in tracks.BOX) + """, count(*) over (partition by t.video_id, track_id) as n from fx_track_frames t join fx_videos v on t.video_id=v.video_id window w as (partition by t.video_id, track_id order by frame_id rows between 2 preceding and 2 following)))""")
def _(t, v):
    return rounded(tracks.smooth_tracks(t, v, 5))


LEAD = "select *, lead(frame_id) over w as nf, " + ", ".join(f"lead({c}) over w as n{c}" for c in tracks.BOX) + " from fx_track_frames window w as (partition by video_id, track_id order by frame_id)"
FILL = ", ".join(f"round({c}+(n{c}-{c})*((f-frame_id)/(nf-frame_id)),6) as {c}" for c in tracks.BOX)


@query("w2_interpolate_short_gaps", TF, sql=f"select video_id, track_id, class_id, frame_id, x1, y1, x2, y2, false as filled from fx_track_frames union all select video_id, track_id, class_id, f as frame_id, {FILL}, true from (select *, unnest(range(frame_id+1, nf)) as f from ({LEAD}) where nf-frame_id-1>0 and nf-frame_id-1<5)")
def _(t):
    return rounded(tracks.interpolate_short_gaps(t, 5)[0])


@query("w4_densify", TF, VID, sql="select video_id, track_id, class_id, f as frame_id, " + ", ".join(f"round({c}+coalesce((n{c}-{c})*(case when nf is null or f<frame_id then 0.0 else (f-frame_id)/(nf-frame_id) end),0),6) as {c}" for c in tracks.BOX) + f" from (select *, unnest(range(case when pf is null then greatest(frame_id-3,0) else frame_id end, case when nf is null then least(frame_id+3, greatest(49,frame_id))+1 else nf end)) as f from (select l.*, lag(frame_id) over (partition by l.video_id, track_id order by frame_id) as pf from ({LEAD}) l join fx_videos v on l.video_id=v.video_id))")
def _(t, v):
    return rounded(tracks.densify(t, v, 3))


@query("w3_interpolate_range", TF, sql=", ends as (select video_id, track_id, min(frame_id) as a, max(frame_id) as b from fx_track_frames where frame_id<=20 group by all having count(*)>1) select video_id, track_id, class_id, frame_id, x1, y1, x2, y2 from fx_track_frames t where not exists (select 1 from ends e where e.video_id=t.video_id and e.track_id=t.track_id and t.frame_id>a and t.frame_id<b) union all select video_id, track_id, class_id, f, " + ", ".join(f"round({c}+(n{c}-{c})*((f-a)/(b-a)),6)" for c in tracks.BOX) + " from (select s.*, a, b, " + ", ".join(f"n.{c} as n{c}" for c in tracks.BOX) + ", unnest(range(a+1,b)) as f from ends e join fx_track_frames s on s.video_id=e.video_id and s.track_id=e.track_id and s.frame_id=a join fx_track_frames n on n.video_id=e.video_id and n.track_id=e.track_id and n.frame_id=b)")
def _(t):
    early = t.where("frame_id <= 20").groupBy("video_id", "track_id").agg(F.min("frame_id").alias("frame_b"), F.max("frame_id").alias("frame_a"), F.count("*").alias("n")).where("n > 1")
    return rounded(tracks.interpolate_range(t, early))


@query("a11_tracklet_quality", TF, sql="select q.video_id, q.track_id, n, round(jitter,6) as jitter, round(n/(1+jitter),6) as quality, class_id from (select video_id, track_id, count(*) as n, coalesce(avg(j),0) as jitter, any_value(class_id) as class_id from (select *, sqrt(power((x1+x2)/2-lag((x1+x2)/2) over w,2)+power((y1+y2)/2-lag((y1+y2)/2) over w,2)) as j from fx_track_frames window w as (partition by video_id, track_id order by frame_id)) group by all) q")
def _(t):
    return rounded(tracks.tracklet_quality(t))


@query("a18_clip_plan", TF, VID, sql="select e.video_id, track_id, cast(cw+cw%2 as int) as clip_w, cast(ch+ch%2 as int) as clip_h, greatest(first-5,0) as start_frame, least(last+5, greatest(frame_count-1,last)) as end_frame from (select video_id, track_id, cast(greatest(ceil(max(x2-x1)*1.2),32) as bigint) as cw, cast(greatest(ceil(max(y2-y1)*1.2),32) as bigint) as ch, min(frame_id) as first, max(frame_id) as last from fx_track_frames group by all) e join fx_videos v on e.video_id=v.video_id")
def _(t, v):
    return tracks.clip_plan(t, v, 5, 1.2, 32)


@query("a20_track_listing", TF, sql=f""", {PROFILE}, {FLAGGED},
begun as (select video_id, track_id, case when coalesce(frame_id-lag(frame_id) over w > 3, true) then 1 else 0 end as fresh from flagged where len(reasons)>0 window w as (partition by video_id, track_id order by frame_id)),
found as (select video_id, track_id, sum(fresh) as n from begun group by all)
select t.video_id, t.track_id, min(frame_id) as start_frame, max(frame_id) as end_frame, count(*) as num_frames, round(quantile_cont({AREA},0.5),6) as median_area,
 array_to_string(list_sort(list(frame_id)),',') as frame_ids, coalesce(any_value(n),0) as area_anomaly_count
from fx_track_frames t left join found f on f.video_id=t.video_id and f.track_id=t.track_id group by all""")
def _(t):
    return rounded(tracks.track_listing(t).withColumn("frame_ids", F.array_join("frame_ids", ",")))


@query("u3_merge_tracks", TF, sql="select video_id, case when track_id%16=8 then track_id-8 else track_id end as track_id, class_id, frame_id, video_frame_idx, x1, y1, x2, y2 from fx_track_frames t where not (track_id%16=8 and exists (select 1 from fx_track_frames b where b.video_id=t.video_id and b.track_id=t.track_id-8 and b.frame_id=t.frame_id))")
def _(t):
    merges = t.where("track_id % 16 = 8").select("video_id", F.col("track_id").alias("from_id"), (F.col("track_id") - 8).alias("into_id")).distinct()
    return tracks.merge_tracks(t, merges)


@query("u4_split_tracks", TF, sql="select t.video_id, case when t.track_id%5=0 and frame_id>50 then top+k else t.track_id end as track_id, class_id, frame_id, video_frame_idx, x1, y1, x2, y2 from fx_track_frames t join (select video_id, max(track_id) as top from fx_track_frames group by 1) m on m.video_id=t.video_id left join (select video_id, track_id, row_number() over (partition by video_id order by track_id) as k from (select distinct video_id, track_id from fx_track_frames where track_id%5=0)) s on s.video_id=t.video_id and s.track_id=t.track_id")
def _(t):
    return tracks.split_tracks(t, t.where("track_id % 5 = 0").select("video_id", "track_id", F.lit(50).alias("frame")).distinct())


@query("u5_delete_frames", TF, sql="select * from fx_track_frames where not ((track_id%4=0 and frame_id>40) or (track_id%4=1 and frame_id<12) or (track_id%4=2 and frame_id between 10 and 30) or track_id%4=3 and track_id%3=0)")
def _(t):
    op = F.expr("case track_id%4 when 0 then 'delete_after' when 1 then 'delete_before' when 2 then 'delete_between' else case when track_id%3=0 then 'delete_track' end end")
    a = F.expr("case track_id%4 when 0 then 40 when 1 then 12 else 30 end")
    return tracks.edit_tracks(t, t.select("video_id", "track_id", op.alias("op"), a.alias("frame_a"), F.lit(10).alias("frame_b")).distinct())


@query("u2_append_tracks", TF, sql="select * from fx_track_frames union all select e.video_id, top+k, 9, frame_id, video_frame_idx, x1, y1, x2, y2 from fx_track_frames e join (select video_id, max(track_id) as top from fx_track_frames group by 1) m on m.video_id=e.video_id join (select video_id, track_id, row_number() over (partition by video_id order by track_id) as k from (select distinct video_id, track_id from fx_track_frames where class_id=1)) i on i.video_id=e.video_id and i.track_id=e.track_id where class_id=1")
def _(t):
    return tracks.append_tracks(t, t.where("class_id = 1"), 9)


@query("u8_frames_between", TF, sql="select video_id, frame_id, count(*) as n, array_to_string(list_sort(list(track_id)),',') as track_ids from fx_track_frames where frame_id between 10 and 29 group by all")
def _(t):
    return tracks.frames_between(t, 10, 20).select("video_id", "frame_id", F.size("boxes").cast("bigint").alias("n"), F.array_join(F.transform("boxes", lambda b: b["track_id"]), ",").alias("track_ids"))


@query("g_geometry", DT, sql="""select video_id, frame_id, det_idx, round((x2-x1)*(y2-y1),6) as area, round((x1+x2)/2,6) as cx, round((y1+y2)/2,6) as cy,
 case when least(x2,1279)>least(x1,1279) and least(y2,719)>least(y1,719) then least(x1,1279) end as clip_x1, cast((object_key*37+80)%256 as int) as color_r,
 round(y2+0.5*(y2-y1),6) as depth from fx_detections""")
def _(d):
    b = G.Box.of()
    cx, cy = G.center(b)
    return rounded(d.select("video_id", "frame_id", "det_idx", G.area(b).alias("area"), cx.alias("cx"), cy.alias("cy"), G.clip_bbox(b, F.lit(1280), F.lit(720))["x1"].alias("clip_x1"), G.track_color(F.col("object_key"))["r"].alias("color_r"), G.pseudo_depth(b, 0.5).alias("depth")))


IOU = "greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)"


@query("j11_iou_join", DT, sql=f"select video_id, frame_id, l, r, round(i/(aa+ab-i),6) as iou from (select a.video_id, a.frame_id, a.det_idx as l, b.det_idx as r, {IOU} as i, (a.x2-a.x1)*(a.y2-a.y1) as aa, (b.x2-b.x1)*(b.y2-b.y1) as ab from fx_detections a join fx_detections b on a.video_id=b.video_id and a.frame_id+1=b.frame_id) where i>0 and i/(aa+ab-i)>=0.5")
def _(d):
    later = d.withColumn("frame_id", F.col("frame_id") - 1)
    return rounded(fusion.iou_join(d, later, 0.5).select("video_id", "frame_id", "l", "r", "iou"))


PAIRS = f"""fwd as (select video_id, object_key as idx, frame_id, x1,y1,x2,y2, count(*) over (partition by video_id, object_key) as n from fx_detections where det_idx%5<>4),
bwd as (select video_id, object_key as idx, frame_id, x1+class_id*8 as x1, y1, x2+class_id*8 as x2, y2, count(*) over (partition by video_id, object_key) as n from fx_detections where frame_id%7<>3),
pr as (select a.video_id, a.idx as f_idx, b.idx as b_idx, a.frame_id, a.n as fn, b.n as bn, case when {IOU}>0 then {IOU}/((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-{IOU}) else 0 end as iou,
 sqrt(power((a.x1+a.x2)/2-(b.x1+b.x2)/2,2)+power((a.y1+a.y2)/2-(b.y1+b.y2)/2,2)) as gap, (sqrt(power(a.x2-a.x1,2)+power(a.y2-a.y1,2))+sqrt(power(b.x2-b.x1,2)+power(b.y2-b.y1,2)))/2 as diag
 from fwd a join bwd b on a.video_id=b.video_id and a.frame_id=b.frame_id),
ov as (select video_id, f_idx, b_idx, count(*) as n, avg(iou) as mean_iou, count(*)/least(any_value(fn),any_value(bn)) as overlap_ratio, (arg_min(gap,frame_id)+arg_max(gap,frame_id))/2 as end_gap, avg(diag) as mean_diag from pr group by all having count(*)>=3),
cand as (select *, end_gap/greatest(mean_diag,1) as normalized_gap, mean_iou*overlap_ratio as score from ov)"""


def sides(d: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    shift = F.col("class_id") * 8
    f = d.where("det_idx % 5 <> 4").select("video_id", F.col("object_key").alias("tracklet_idx"), "frame_id", *tracks.BOX, *more)
    b = d.where("frame_id % 7 <> 3").select("video_id", F.col("object_key").alias("tracklet_idx"), "frame_id", (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2", *more)
    return f, b


@query("a12_pair_overlap", DT, sql=f", {PAIRS} select video_id, f_idx, b_idx, n, round(mean_iou,6) as mean_iou, round(overlap_ratio,6) as overlap_ratio, round(end_gap,6) as end_gap, round(mean_diag,6) as mean_diag, round(normalized_gap,6) as normalized_gap, round(score,6) as score from cand")
def _(d):
    return rounded(tracks.pair_overlap(*sides(d)))


@query("f0_candidate_pairs", DT, sql=f", {PAIRS} select video_id, f_idx, b_idx, round(score,6) as score from cand where mean_iou>=0.3 and normalized_gap<=1.5")
def _(d):
    return rounded(fusion.candidate_pairs(*sides(d), 0.3).select("video_id", "f_idx", "b_idx", "score"))


@query("l7_mutual_best", DT, sql=f", {PAIRS}, ranked as (select *, row_number() over (partition by video_id, f_idx order by round(score,9) desc, b_idx) as rf, row_number() over (partition by video_id, b_idx order by round(score,9) desc, f_idx) as rb from cand where mean_iou>=0.3 and normalized_gap<=1.5) select video_id, f_idx, b_idx, round(score,6) as score from ranked where rf=1 and rb=1")
def _(d):
    return rounded(tracks.mutual_best(fusion.candidate_pairs(*sides(d), 0.3).withColumn("score", F.round("score", 9))).select("video_id", "f_idx", "b_idx", "score"))


@query("f6_all_pairs_components", DT)
def _(d):
    f, b = sides(d)
    return fusion.connected_components(fusion.candidate_pairs(f, b, 0.3))


def all_frames(v: DataFrame) -> DataFrame:
    return v.select("video_id", F.explode(F.sequence(F.col("frame_offset").cast("bigint"), (F.col("frame_offset") + F.col("frame_count") - 1).cast("bigint"))).alias("frame_id"))


TRACKER_QUERIES = {
    "t1_sort_tracker": "sort", "t2_bytetrack": "bytetrack", "t3_oc_sort": "oc_sort", "t4_bot_sort": "bot_sort", "t5_hybrid_sort": "hybrid_sort",
    "t6_deep_oc_sort": "deep_oc_sort", "t7_cbiou": "cbiou", "t8_sparse_track": "sparse_track",
}
for name, method in TRACKER_QUERIES.items():
    by_score, by_filter = method != "sort", method in ("sort", "bytetrack")
    query(name, DT, VID, sql=tracker_sql(0.6 if by_score else 0.0, not by_filter))(lambda d, v, method=method: rounded(tracking.run_tracker(d, method, frames=all_frames(v))))


#: Objects keep apart, so a detection stays whose object both gets a track by a score of 0.6 and is seen ten times: from that
#: score on in the forward pass, up to it in the backward one.
FILTERED = """, begun as (select video_id, object_key, min(frame_id) filter (score>=0.6) as f, max(frame_id) filter (score>=0.6) as t from fx_detections group by all),
tracked as (select d.* from fx_detections d join begun b on b.video_id=d.video_id and b.object_key=d.object_key and (d.frame_id>=f or d.frame_id<=t)),
kept as (select video_id, frame_id, count(*) as n from (select *, count(*) over (partition by video_id, object_key) as long from tracked) where long>=10 group by all),
given as (select video_id, frame_id, count(*) as n from fx_detections group by all),
frames as (select video_id, unnest(range(cast(frame_offset as bigint), cast(frame_offset+frame_count as bigint))) as frame_id from fx_videos)
select f.video_id, f.frame_id, coalesce(g.n,0) as n_in, coalesce(k.n,0) as n_out, coalesce(g.n,0)-coalesce(k.n,0) as removed
from frames f left join given g on g.video_id=f.video_id and g.frame_id=f.frame_id left join kept k on k.video_id=f.video_id and k.frame_id=f.frame_id"""


@query("t11_filter_detections", DT, VID, sql=FILTERED)
def _(d, v):
    kept = fusion.filter_detections(d, all_frames(v), v)
    return fusion.filter_counts(d, kept, all_frames(v))


def spikes_sql(source: str, start: int = 0) -> str:
    """Common tables up to ``mended``: the tracks of ``source`` as fix_spikes leaves them. A row is held against the last ten normal ones before it, so a recursion goes along each track."""
    median = lambda x: f"list_aggregate(s.{x}, 'median')"
    wide = f"coalesce(len(s.areas)>=3 and (r.w*r.h>{median('areas')}*4 or r.w>{median('widths')}*3 or r.h>{median('heights')}*3), false)"
    normal = f"r.w*r.h>0 and not {wide}"
    kept = lambda x, v: f"case when {normal} then list_slice(list_append(s.{x}, {v}), -10, -1) else s.{x} end"
    box = ", ".join(f"case when fixed then lo.{c}+(hi.{c}-lo.{c})*((m.frame_id-lo.frame_id)/(hi.frame_id-lo.frame_id)) else m.{c} end as {c}" for c in tracks.BOX)
    return f""", r as materialized (select video_id, track_id, class_id, frame_id, x1, y1, x2, y2, greatest(x2-x1,0) as w, greatest(y2-y1,0) as h,
 row_number() over (partition by video_id, track_id order by frame_id) as k, count(*) over (partition by video_id, track_id) as n from {source}),
s as (select distinct video_id, track_id, cast(0 as bigint) as k, cast([] as double[]) as areas, cast([] as double[]) as widths, cast([] as double[]) as heights, false as odd from r
 union all select s.video_id, s.track_id, r.k, {kept('areas', 'r.w*r.h')}, {kept('widths', 'r.w')}, {kept('heights', 'r.h')}, r.n>=5 and (r.w*r.h<=0 or {wide} and r.frame_id>={start})
 from s join r on r.video_id=s.video_id and r.track_id=s.track_id and r.k=s.k+1),
o as (select r.*, s.odd, max(case when not s.odd then r.k end) over (partition by r.video_id, r.track_id order by r.k) as before,
 min(case when not s.odd then r.k end) over (partition by r.video_id, r.track_id order by r.k rows between current row and unbounded following) as after from r join s on s.video_id=r.video_id and s.track_id=r.track_id and s.k=r.k),
g as (select *, sum(fresh) over (partition by video_id, track_id order by k) as run from (select *, case when frame_id-lag(frame_id) over (partition by video_id, track_id order by k)=1 then 0 else 1 end as fresh from o where odd)),
runs as (select video_id, track_id, run, min(frame_id) as run_start, max(frame_id) as run_end, count(*) as size, min(before) as before, min(after) as after from g group by all having count(*)<=10 and min(before) is not null and min(after) is not null),
m as (select o.*, u.run_start is not null as fixed, u.run_start, u.run_end, u.before as b, u.after as a from o left join g on g.video_id=o.video_id and g.track_id=o.track_id and g.k=o.k
 left join runs u on u.video_id=g.video_id and u.track_id=g.track_id and u.run=g.run),
mended as (select m.video_id, m.track_id, m.class_id, m.frame_id, {box}, fixed, run_start, run_end, lo.frame_id as anchor_before, hi.frame_id as anchor_after from m
 left join r lo on lo.video_id=m.video_id and lo.track_id=m.track_id and lo.k=m.b left join r hi on hi.video_id=m.video_id and hi.track_id=m.track_id and hi.k=m.a)"""


@query("q2_fix_spikes", TF, sql=spikes_sql("fx_track_frames") + " select video_id, track_id, class_id, frame_id, " + ", ".join(f"round({c},6) as {c}" for c in tracks.BOX) + ", fixed, run_start, run_end, anchor_before, anchor_after from mended")
def _(t):
    return rounded(tracking.fix_spikes(t))


@query("q2_fixed_intervals", TF, sql=spikes_sql("fx_track_frames") + " select video_id, track_id, run_start, run_end, anchor_before, anchor_after, count(*) as frames from mended where fixed group by all")
def _(t):
    return tracking.fixed_intervals(tracking.fix_spikes(t))


@query("n_sampled_frames", VID, sql="select video_id, unnest(list_sort(list_distinct(list_concat(list_filter(range(0,frame_count,10), lambda f: not (f between 15 and 25)), list_concat(range(15,26,4), [25]))))) as frame from fx_videos")
def _(v):
    plans = v.select("video_id", F.lit(10).alias("default_interval"))
    segments = v.select("video_id", F.lit(15).alias("start_frame"), F.lit(25).alias("end_frame"), F.lit(4).alias("interval"))
    return sampling.sampled_frames(plans, segments, v).select("video_id", F.col("frame").cast("bigint").alias("frame"))


@query("n6_segment_video", DT, sql="select video_id, cast(floor(video_frame_idx/12) as bigint) as segment, video_frame_idx%12+1 as local_frame, det_idx from fx_detections")
def _(d):
    return sampling.segment_video(d, 12).select("video_id", "segment", "local_frame", "det_idx")


@query("n7_split_dataset", DT, sql="select video_id, sample, cast((row_number() over (partition by video_id order by sample)-1)%4 as int) as part from (select distinct video_id, frame_id as sample from fx_detections)")
def _(d):
    return sampling.split_round_robin(d.select("video_id", F.col("frame_id").alias("sample")).distinct(), 4, ["sample"], ["video_id"])


@query("k3_yolo_frames", DT, VID, sql="select v.video_id, concat('frame_', lpad(cast(f as varchar), 6, '0'), '.txt') as file_name, coalesce(string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, floor((x1+x2)/2/width*1e6+0.5)/1e6, floor((y1+y2)/2/height*1e6+0.5)/1e6, floor((x2-x1)/width*1e6+0.5)/1e6, floor((y2-y1)/height*1e6+0.5)/1e6), chr(10) order by det_idx),'') as content from (select *, unnest(range(frame_offset, frame_offset+frame_count)) as f from fx_videos) v left join fx_detections d on d.video_id=v.video_id and d.frame_id=f group by all")
def _(d, v):
    return sampling.to_yolo_frames(d.withColumn("order", F.col("det_idx")), v)


@query("a1_part_summary", PRT, sql="select task_id, " + ", ".join(f"count(*) filter (status='{s}') as {s}" for s in work.STATUSES) + ", count(*) as total, count(*) filter (status in ('submitted','completed')) as annotated from fx_parts group by task_id")
def _(p):
    return work.part_summary(p)


@query("a2_actor_summary", PRT, sql="select task_id, annotator, count(*) as total, count(*) filter (status='rework') as rework, count(*) filter (status='in_progress') as in_progress from fx_parts where annotator is not null group by all")
def _(p):
    return work.actor_part_summary(p)


SUMMARY = "s as (select task_id, " + ", ".join(f"count(*) filter (status='{s}') as {s}" for s in work.STATUSES) + ", count(*) as total from fx_parts group by task_id)"


@query("a3_task_overview", TSK, PRT, sql=f", {SUMMARY}, o as (select t.task_id, project, " + ", ".join(f"coalesce({s},0) as {s}" for s in [*work.STATUSES, "total"]) + " from fx_tasks t left join s on s.task_id=t.task_id where not deleted) select *, case when total=0 then 'awaiting_parts' when completed=total then 'completed' when pending=total then 'pending' when submitted+completed=total then 'submitted' when in_progress+paused+rework>0 then 'in_progress' else 'mixed' end as state, case when total>0 then round(completed*100.0/total,1) else 0 end as completion_percent from o")
def _(t, p):
    return work.task_overview(t, p)


A4 = f""", c as (select task_id, annotator, {", ".join(f"count(*) filter (status='{s}') as {s}" for s in work.STATUSES)}, sum(case when status in ('submitted','completed') then coalesce(bbox_count,1) else 0 end) as boxes, sum(greatest(progress_count,0)) as images, sum(coalesce(work_seconds_override,0)) as o from fx_parts where annotator is not null group by all),
w as (select task_id, s.annotator, sum(greatest(epoch(coalesce(ended_at,{NOW}))-epoch(started_at),0)) as ss from fx_sessions s join fx_parts p on p.part_id=s.part_id where work_seconds_override is null group by all),
a4 as (select coalesce(c.task_id,w.task_id) as task_id, coalesce(c.annotator,w.annotator) as annotator, {", ".join(f"coalesce({s},0) as {s}" for s in work.STATUSES)}, cast(coalesce(boxes,0) as bigint) as boxes, cast(coalesce(images,0) as bigint) as images, round(coalesce(o,0)+coalesce(ss,0),3) as seconds from c full join w on c.task_id=w.task_id and c.annotator=w.annotator)"""


@query("a4_annotator_statistics", PRT, SES, sql=A4 + " select *, case when seconds>0 then round(boxes*3600/seconds,3) else 0 end as boxes_per_hour, case when seconds>0 then round(images*3600/seconds,3) else 0 end as images_per_hour from a4")
def _(p, s):
    return work.annotator_statistics(p, s, moment(NOW))


@query("a5_task_statistics", PRT, SES, sql=A4 + " select task_id, " + ", ".join(f"cast(sum({s}) as bigint) as {s}" for s in [*work.STATUSES, "boxes", "images"]) + ", round(sum(seconds),3) as seconds, count(*) as annotators from a4 group by task_id")
def _(p, s):
    return rounded(work.task_statistics(work.annotator_statistics(p, s, moment(NOW))), 3)


CLIPPED = f"greatest(epoch(least(coalesce(ended_at,{NOW}),{WINDOW[1]}))-epoch(greatest(started_at,{WINDOW[0]})),0)"


@query("j9_overlap_join", SES, sql=f"select session_id, part_id, annotator, started_at, ended_at, round({CLIPPED},3) as clipped_seconds from fx_sessions where started_at<{WINDOW[1]} and coalesce(ended_at,{NOW})>{WINDOW[0]}")
def _(s):
    return rounded(work.overlap_join(s, moment(WINDOW[0]), moment(WINDOW[1]), moment(NOW)), 3)


@query("j9_all_days", SES, sql=f""", days as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as begins)
select session_id, begins, round(epoch(least(coalesce(ended_at,{NOW}),begins+interval 1 day)-greatest(started_at,begins)),3) as clipped_seconds
from fx_sessions join days on started_at<begins+interval 1 day and coalesce(ended_at,{NOW})>begins and coalesce(ended_at,{NOW})>started_at""")
def _(s):
    days = s.sparkSession.range(1).select(F.explode(F.sequence(moment("timestamp '2024-01-01'"), moment("timestamp '2024-01-31'"), F.expr("interval 1 day"))).alias("begins"))
    found = joins.window_overlaps(s, days.withColumn("ends", F.col("begins") + F.expr("interval 1 day")), moment(NOW))
    return rounded(found.select("session_id", "begins", "clipped_seconds"), 3)


@query("a6_admin_statistics", TSK, PRT, SES, USR, sql=f""", cl as (select part_id, sum({CLIPPED}) as c from fx_sessions where started_at<{WINDOW[1]} and coalesce(ended_at,{NOW})>{WINDOW[0]} group by 1),
p as (select annotator, t.task_id, case when product_tag is null or product_tag='' then '{work.UNTAGGED}' else product_tag end as tag, coalesce(submitted_at>={WINDOW[0]} and submitted_at<{WINDOW[1]},false) as done, progress_count, bbox_count, p.status, work_seconds_override as o, coalesce(c,0) as c from fx_parts p join fx_tasks t on t.task_id=p.task_id and not deleted left join cl on cl.part_id=p.part_id where annotator is not null),
f as (select annotator, task_id, tag, done::int as done, case when done then greatest(progress_count,0) else 0 end as images, case when done and status in ('submitted','completed') then coalesce(bbox_count,1) else 0 end as boxes, case when done and o is not null then o else c end as seconds from p where done or c>0),
g as (select case grouping(annotator,task_id,tag) when 3 then 'user' when 1 then 'user_task' when 6 then 'tag' else 'total' end as kind, annotator, task_id, tag, count(*) as parts, cast(coalesce(sum(done),case when grouping(annotator,task_id,tag)=7 then null end) as bigint) as completed, cast(sum(images) as bigint) as images, cast(sum(boxes) as bigint) as boxes, round(sum(seconds),3) as seconds, count(distinct task_id) as tasks from f group by grouping sets ((annotator),(annotator,task_id),(tag),()))
select * from g union all select 'user', username, null, null, 0,0,0,0,0,0 from fx_users where username not in (select annotator from f)""")
def _(t, p, s, u):
    return work.admin_statistics(t, p, s, u, moment(WINDOW[0]), moment(WINDOW[1]), moment(NOW))


LEDGER = ", h as (select *, coalesce(max(cumulative) over w,0) as high, coalesce(bool_or(is_final) over w,false) as fin from fx_submissions window w as (partition by part_id order by submitted_at,event_id rows between unbounded preceding and 1 preceding)), e as (select event_id, part_id, annotator, submitted_at, cumulative, is_final, cast(case when fin then 0 else greatest(cumulative-high,0) end as bigint) as credited, fin, high from h), ev as (select event_id, part_id, annotator, submitted_at, cumulative, is_final, credited from e where not (not fin and cumulative<high) and (is_final or credited>0))"


@query("w8_credit_ledger", SUB, sql=LEDGER + " select * from ev")
def _(s):
    return work.credit_ledger(s)[0]


@query("a17_submission_state", SUB, sql=LEDGER + " select part_id, cast(sum(credited) as bigint) as credited, bool_or(is_final) as finalised from ev group by 1")
def _(s):
    return work.submission_state(work.credit_ledger(s)[0])


@query("a7_production_report", SUB, USR, sql=LEDGER + f", r as (select annotator, credited, extract(isodow from submitted_at + interval 8 hour)>=6 as off from ev where submitted_at>={WINDOW[0]} and submitted_at<{WINDOW[1]}) select username, display_name, cast(coalesce(sum(case when not off then credited else 0 end),0) as bigint) as credited, cast(coalesce(sum(case when off then credited else 0 end),0) as bigint) as excluded, count(*) filter (not off) as events from fx_users left join r on username=annotator group by all")
def _(s, u):
    return work.production_report(work.credit_ledger(s)[0], u, moment(WINDOW[0]), moment(WINDOW[1]), True)


@query("a8_attendance", SES, sql=f", f as (select cast(started_at as date) as day, annotator, min(started_at) as t from fx_sessions group by all), d as (select cast(unnest(generate_series(date '2024-01-10', date '2024-01-16', interval 1 day)) as date) as day) select d.day, count(t) as check_ins, min(t) as earliest from d left join f on f.day=d.day group by d.day")
def _(s):
    return work.attendance(s, "2024-01-10", 7)


RANKED = "select *, cast(row_number() over (order by rank, updated_at desc, task_id desc) as int) as new_rank from fx_tasks where not deleted and status<>'completed'"


@query("w9_normalize_ranks", TSK, sql=f"select *, new_rank<>rank as changed from ({RANKED})")
def _(t):
    return work.normalize_ranks(t)


MOVED = f", r as ({RANKED}), m as (select max(task_id) as moved from r), x as (select r.*, moved, (select new_rank from r, m where task_id=moved) as here from r, m)"


def moved(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranked = work.normalize_ranks(t)
    return work.move_rank(ranked, ranked.agg(F.max("task_id")).first()[0], 3)


@query("w10_move_rank", TSK, sql=MOVED + " select task_id, new_rank, cast(case when task_id=moved then least(3,(select count(*) from r)) else new_rank-(new_rank>here)::int+((new_rank-(new_rank>here)::int)>=least(3,(select count(*) from r)))::int end as int) as moved_rank from x")
def _(t):
    return moved(t)[0].select("task_id", "new_rank", "moved_rank")


@query("w10_move_audit", TSK, sql=MOVED + ", y as (select *, cast(case when task_id=moved then 3 else new_rank-(new_rank>here)::int+((new_rank-(new_rank>here)::int)>=3)::int end as int) as mr from x) select task_id, 'update_ordering' as action, 'rank' as field, cast(new_rank as varchar) as old, cast(mr as varchar) as new from y where mr<>new_rank")
def _(t):
    return moved(t)[1]


@query("w11_schedule", TSK, PRT, sql=""", d as (select task_id, bool_and(status='completed') as done from fx_parts group by 1),
n as (select *, try_cast(replace(data_amount,',','') as double) as amount, try_cast(hourly_capacity as double) as hourly from fx_tasks where not deleted),
s as (select t.task_id, coalesce(done,false) as done, case when rank<>0 then rank else 1000000000 end as r, updated_at, case when estimated_hours>0 then estimated_hours when hourly>0 then coalesce(amount/hourly,0) else 0 end as hours from n t left join d on d.task_id=t.task_id),
c as (select *, sum(case when done then 0 else hours end) over (order by r, updated_at, task_id rows unbounded preceding) as cumulative_hours from s),
e as (select *, case when not done and hours>0 then cast(greatest(ceil(round(cumulative_hours/(5000*8),9)),1) as int) end as days from c)
select task_id, round(hours,6) as hours, round(cumulative_hours,4) as cumulative_hours, days, case when days is not null then list_filter(list_transform(range(0, days*2+8), lambda i: date '2024-02-02' + cast(i as int)), lambda x: isodow(x)<6)[days] end as due from e""")
def _(t, p):
    done = p.groupBy("task_id").agg(F.bool_and(F.col("status") == "completed").alias("done"))
    return work.schedule(t, done, 5000, "2024-02-02").withColumn("hours", F.round("hours", 6)).withColumn("cumulative_hours", F.round("cumulative_hours", 4))


@query("d2_periods", SUB, sql="select event_id, cast(date_trunc('day', l) as date) as day, cast(date_trunc('day', l) as date)+1 as next_day, cast(date_trunc('month', l) as date) as month, cast(date_trunc('month', l) + interval 1 month as date) as next_month from (select event_id, submitted_at + interval 8 hour as l from fx_submissions)")
def _(s):
    (d, nd), (m, nm) = (work.period_bounds(F.col("submitted_at"), p) for p in ("day", "month"))
    return s.select("event_id", d.alias("day"), nd.alias("next_day"), m.alias("month"), nm.alias("next_month"))


@query("d2_week_totals", SUB, sql="select cast(submitted_at + interval 8 hour as date) - cast((isodow(cast(submitted_at + interval 8 hour as date))+5)%7 as int) as week, count(*) as events, cast(sum(cumulative) as bigint) as cumulative from fx_submissions group by 1")
def _(s):
    return s.groupBy(work.week_start(F.col("submitted_at")).alias("week")).agg(F.count("*").alias("events"), F.sum("cumulative").cast("bigint").alias("cumulative"))


@query("q3_time_deviation", PRT, TSK, SES, sql=f", o as (select part_id, arg_max(started_at, session_id) as since from fx_sessions where ended_at is null group by 1), e as (select p.part_id, p.task_id, p.status, expected_part_seconds as x, coalesce(work_seconds_override, work_seconds + case when since is null then 0 else greatest(epoch({NOW})-epoch(since),0) end) as eff from fx_parts p join fx_tasks t on t.task_id=p.task_id left join o on o.part_id=p.part_id) select part_id, task_id, round(eff,3) as effective_seconds, case when x>0 then round((eff-x)/x,4) end as deviation, coalesce(abs(case when x>0 then round((eff-x)/x,4) end)>=0.5,false) as flagged, status in ('paused','submitted','rework','completed') as reviewable from e")
def _(p, t, s):
    return work.time_deviation(p, t, s, moment(NOW)).withColumn("effective_seconds", F.round("effective_seconds", 3))


@query("l4_next_pending", PRT, sql="select task_id, arg_min(part_id, part_index) as part_id from fx_parts where status='pending' group by 1")
def _(p):
    return work.next_pending(p)


@query("e4_task_status", TSK, PRT, sql="select t.task_id, case when count(p.part_id)=0 then 'ready' when count(*) filter (p.status='completed')=count(p.part_id) then 'completed' else 'in_progress' end as status from fx_tasks t left join fx_parts p on p.task_id=t.task_id where not deleted group by 1")
def _(t, p):
    return work.task_status(t, p)


@query("j8_fan_out", TSK, USR, sql="select change_id, username from (select distinct task_id as change_id, unnest([publisher, concat('u', cast(task_id%50 as varchar))]) as username from fx_tasks) join fx_users using (username) where is_active")
def _(t, u):
    return work.fan_out(t.select(F.col("task_id").alias("change_id"), "publisher", F.concat(F.lit("u"), (F.col("task_id") % 50).cast("string")).alias("manager")), u).select("change_id", "username")


@query("e2_accumulated_seconds", SES, sql="select part_id, count(*) as sessions, count(*) filter (ended_at is null) as open, round(coalesce(sum(greatest(epoch(ended_at)-epoch(started_at),0)),0),3) as seconds from fx_sessions group by 1")
def _(s):
    return rounded(changes.accumulated(s), 3)


EDITED = "select *, case when task_id%3=0 then 'X' else project end as new_project, case when task_id%5=0 then null else rank end as new_rank from fx_tasks"


@query("e5_field_changes", TSK, sql=f", n as ({EDITED}) select task_id, 'project' as field, project as old, new_project as new from n where project is distinct from new_project union all select task_id, 'rank', cast(rank as varchar), cast(new_rank as varchar) from n where rank is distinct from new_rank")
def _(t):
    after = t.withColumn("project", F.when(F.col("task_id") % 3 == 0, "X").otherwise(F.col("project"))).withColumn("rank", F.when(F.col("task_id") % 5 != 0, F.col("rank")))
    return changes.field_changes(t, after, "task_id", ["project", "rank"])


@query("e7_add_parts", PRT, sql=r""", k as (select distinct task_id, case when part_index%2=0 then 'a/b' else 'c:\data\x' end as key, max(part_index) over (partition by task_id) as top from fx_parts where part_index<=2),
n as (select task_id, part_index, case part_index%5 when 0 then 'A/b' when 1 then 'a//b' when 2 then './a/b/' when 3 then 'c:/data/X' else 'a/b/../c' end as path, case part_index%5 when 0 then 'A/b' when 1 then 'a/b' when 2 then 'a/b' when 3 then 'c:\data\x' else 'a/c' end as key from fx_parts where part_index>2),
f as (select n.*, k.key is null and row_number() over (partition by n.task_id, n.key order by part_index)=1 as accepted from n left join k on n.task_id=k.task_id and n.key=k.key)
select f.task_id, part_index, path, accepted, case when accepted then top+count(*) filter (accepted) over (partition by f.task_id order by part_index) end as new_index from f join (select distinct task_id, top from k) t on t.task_id=f.task_id""")
def _(p):
    old = p.where("part_index <= 2").select("task_id", "part_index", F.when(F.col("part_index") % 2 == 0, "a/b").otherwise("C:\\Data\\x").alias("path"))
    path = F.expr("case part_index%5 when 0 then 'A/b' when 1 then 'a//b' when 2 then './a/b/' when 3 then 'c:/data/X' else 'a/b/../c' end")
    return changes.add_parts(old, p.where("part_index > 2").select("task_id", "part_index", path.alias("path")))


@query("e9_history", SUB, sql="select part_id, string_agg(cast(event_id as varchar)||':'||annotator, ',' order by submitted_at, event_id) as events from fx_submissions group by 1")
def _(s):
    lines = F.transform("events", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["annotator"]))
    return changes.history(s, "part_id", "submitted_at", "event_id", ["annotator"]).select("part_id", F.array_join(lines, ",").alias("events"))


@query("e10_status_changes", PRT, sql="select * from (select task_id, part_index, lag(status) over (partition by task_id order by part_index) as old, status from fx_parts) where old is distinct from status")
def _(p):
    return changes.status_changes(p, "task_id", "part_index")


@query("e14_check_ins", SES, sql="select annotator, cast(started_at + interval 8 hour as date) as day, min(started_at) as checked_in_at from fx_sessions group by all")
def _(s):
    return changes.check_ins(s)


@query("e15_soft_delete", TSK, sql="select task_id, cast(row_number() over (order by rank, updated_at desc, task_id desc) as int) as new_rank from fx_tasks where not deleted and status<>'completed' and task_id%7<>0")
def _(t):
    return changes.soft_delete(t, t.where("task_id % 7 = 0"))[0].select("task_id", "new_rank")


@query("e15_delete_audit", TSK, sql="select task_id, 'delete_task' as action, 'deleted' as field, '0' as old, '1' as new from fx_tasks where not deleted and task_id%7=0")
def _(t):
    return changes.soft_delete(t, t.where("task_id % 7 = 0"))[1]


HELD = "coalesce(annotator='u7' and status in ('in_progress','paused','rework'),false)"


@query("e6_reassign", TSK, PRT, SES, sql=f"select part_id, case when {HELD} then 'pending' else status end as status, case when not {HELD} then annotator end as annotator, case when {HELD} then 0 else work_seconds end as work_seconds, case when not {HELD} then submitted_at end as submitted_at from fx_parts")
def _(t, p, s):
    return changes.reassign(t, p, s, "u7", "u1")["parts"].select("part_id", "status", "annotator", "work_seconds", "submitted_at")


@query("e6_reassigned_tasks", TSK, PRT, SES, sql="select task_id, case when publisher='u7' then 'u1' else publisher end as publisher, case when manager<>'u7' then manager when publisher='u7' then 'u1' else publisher end as manager from fx_tasks")
def _(t, p, s):
    return changes.reassign(t, p, s, "u7", "u1")["tasks"].select("task_id", "publisher", "manager")


@query("e6_reassigned_sessions", TSK, PRT, SES, sql=f"select session_id from fx_sessions where part_id not in (select part_id from fx_parts where {HELD.replace('u7', 'u3')})")
def _(t, p, s):
    return changes.reassign(t, p, s, "u3", "u1")["sessions"].select("session_id")


KEYS = "select video_id, track_id, frame_id as frame, video_frame_idx%41<>40 as enabled, x1, y1, x2, y2 from (select distinct on (video_id, track_id, frame_id) * from fx_track_frames order by video_id, track_id, frame_id, x2, y2)"


@query("w5_expand_keyframes", TF, sql=f""", k as ({KEYS}), l as (select *, bool_or(not enabled) over w as stopped, lead(frame) over v as nf, lead(x2) over v as nx2 from k window w as (partition by video_id, track_id order by frame rows between unbounded preceding and current row), v as (partition by video_id, track_id order by frame))
select video_id, track_id, f as frame, f-1 as video_frame_idx, round(coalesce(x2+(nx2-x2)*((f-frame)/(nf-frame)),x2),6) as x2 from (select *, unnest(generate_series(frame, coalesce(greatest(nf-1,frame),frame))) as f from l where not stopped)""")
def _(t):
    keys = t.groupBy("video_id", "track_id", F.col("frame_id").alias("frame")).agg(F.min(F.struct("x2", "y2", "x1", "y1")).alias("b")).select("video_id", "track_id", "frame", (F.col("frame") % 41 != 40).alias("enabled"), "b.*")
    return rounded(boxes.expand_keyframes(keys).select("video_id", "track_id", "frame", "video_frame_idx", "x2"))


@query("k4_export_frames", DT, VID, sql="select v.video_id, cast(f as bigint) as video_frame_idx, count(d.video_id) as boxes from (select video_id, unnest(range(0, frame_count, 6)) as f from fx_videos) v left join fx_detections d on d.video_id=v.video_id and d.video_frame_idx=f group by all")
def _(d, v):
    return boxes.export_frames(d, v, 6)


@query("k5_voc", DT, VID)
def _(d, v):
    images = d.select("video_id", "frame_id").distinct().join(v, "video_id")
    image = F.concat_ws("_", "video_id", "frame_id").alias("image")
    return boxes.to_voc(d.select(image, F.col("det_idx").alias("order"), F.concat(F.lit("class "), "class_id").alias("name"), *tracks.BOX), images.select(image, "width", "height"))


def compared_sql(shift: str, least: float = 0.5) -> str:
    """Common tables up to ``cmp``: the images' tp, extra and missed, their pairs being gone through one after another, the best first."""
    return f""", o as materialized (select video_id, frame_id, det_idx, x1+{shift} as x1, y1, x2+{shift} as x2, y2 from fx_detections where det_idx%5<>4),
w as materialized (select * from fx_detections),
c as materialized (select video_id, frame_id, l, r, row_number() over (partition by video_id, frame_id order by i/u desc, l desc, r desc) as k from (
 select a.video_id, a.frame_id, a.det_idx as l, b.det_idx as r, {IOU} as i, (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-{IOU} as u from w a join o b on a.video_id=b.video_id and a.frame_id=b.frame_id) where i>0 and i/u>={least}),
s as (select distinct video_id, frame_id, cast(0 as bigint) as k, cast([] as int[]) as ls, cast([] as int[]) as rs from c
 union all select s.video_id, s.frame_id, c.k, case when list_contains(ls, l) or list_contains(rs, r) then ls else list_append(ls, l) end,
 case when list_contains(ls, l) or list_contains(rs, r) then rs else list_append(rs, r) end from s join c on c.video_id=s.video_id and c.frame_id=s.frame_id and c.k=s.k+1),
tp as (select video_id, frame_id, max(len(ls)) as tp from s group by all),
n1 as (select video_id, frame_id, count(*) as n from w group by all), n2 as (select video_id, frame_id, count(*) as n from o group by all),
cmp as (select video_id, frame_id, coalesce(tp,0) as tp, coalesce(n2.n,0)-coalesce(tp,0) as extra, coalesce(n1.n,0)-coalesce(tp,0) as missed from n1 full join n2 using (video_id, frame_id) left join tp using (video_id, frame_id))"""


@query("q4_compare_box_sets", DT, sql=compared_sql("9") + " select * from cmp")
def _(d):
    other = d.where("det_idx % 5 <> 4").withColumn("x1", F.col("x1") + 9).withColumn("x2", F.col("x2") + 9)
    return boxes.compare_box_sets(fusion.iou_join(d, other, 0.5), d, other)


@query("a13_run_summary", DT, sql=""", f as (select video_id%5 as run, frame_id, sum(x1)/1000 as seconds, count(*) as boxes from fx_detections group by all),
r as (select run, count(*) as frames, count(*)/sum(seconds) as fps, sum(boxes)/sum(seconds) as bps, median(seconds) as p50, list_sort(list(seconds))[cast(floor((count(*)-1)*0.95) as int)+1] as p95 from f group by run)
select run, frames, round(fps,6) as fps, round(bps,6) as boxes_per_second, round(p50,6) as p50, round(p95,6) as p95, round(fps/(select fps from r where run=0),6) as speed_up from r""")
def _(d):
    frames = d.groupBy((F.col("video_id") % 5).alias("run"), "frame_id").agg((F.sum("x1") / 1000).alias("seconds"), F.count("*").alias("boxes"))
    return rounded(boxes.summarize_runs(frames, 0))


def tracklets(d: DataFrame) -> DataFrame:
    f, b = sides(d, "class_id")  # an object is of one class
    return f.withColumn("direction", F.lit("forward")).unionByName(b.withColumn("direction", F.lit("backward")))


@query("f8_merge_components", DT, VID)
def _(d, v):
    return rounded(fusion.merge_components(tracklets(d), fusion.fuse(*sides(d), iou=0.3), v))


@query("f9_final_tracks", DT, VID)
def _(d, v):
    members = fusion.fuse(*sides(d), iou=0.3)
    return rounded(fusion.final_tracks(fusion.merge_components(tracklets(d), members, v), members, v, 5, 5))
