"""SQL for merged components and final tracks, written from the rules of fusion."""

from __future__ import annotations

BOX = ("x1", "y1", "x2", "y2")


def _iou(a: str, b: str) -> str:
    both = f"greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0)"
    size = lambda t: f"({t}.x2-{t}.x1)*({t}.y2-{t}.y1)"
    return f"(case when {both}>0 then {both}/({size(a)}+{size(b)}-{both}) else 0 end)"


def merged_sql(candidates: str) -> str:
    """Common tables up to ``members`` and ``merged``. ``candidates`` are those up to c, the pairs (video_id, f_idx, b_idx), and fwd, bwd, fw, bw."""
    mean = ", ".join(f"avg({c}) filter (near) as {c}, any_value(l{c}) as l{c}" for c in BOX)
    clipped = ", ".join(f"least(greatest({c},0),{'width' if c[0] == 'x' else 'height'}-1) as c{c}" for c in BOX)
    out = ", ".join(f"case when n>1 and cx2>cx1 and cy2>cy1 then c{c} else l{c} end as {c}" for c in BOX)
    return f"""{candidates}, nodes as (select distinct video_id, 'f' || f_idx as node, 'forward' as direction, f_idx as idx from c union select video_id, 'b' || b_idx, 'backward', b_idx from c),
edges as (select video_id, 'f' || f_idx as a, 'b' || b_idx as z from c union select video_id, 'b' || b_idx, 'f' || f_idx from c),
reach as (select video_id, node as a, node as z from nodes union select r.video_id, r.a, e.z from reach r join edges e on e.video_id=r.video_id and e.a=r.z),
root as (select r.video_id, r.a, min((m.direction, m.idx)) as low from reach r join nodes m on m.video_id=r.video_id and m.node=r.z group by 1,2),
comp as (select n.video_id, direction, idx, 'c' || dense_rank() over (partition by n.video_id order by low) as component from nodes n join root on root.video_id=n.video_id and root.a=n.node),
every as (select video_id, 'forward' as direction, idx from fw union all select video_id, 'backward', idx from bw),
members as (select e.video_id, e.direction, e.idx, coalesce(component, substr(e.direction,1,1) || e.idx) as component from every e left join comp c on c.video_id=e.video_id and c.direction=e.direction and c.idx=e.idx),
frames as (select t.*, class_id from (select video_id, 'forward' as direction, idx, frame_id, x1, y1, x2, y2 from fwd union all select video_id, 'backward', idx, frame_id, x1, y1, x2, y2 from bwd) t
 join (select distinct video_id, object_key, class_id from fx_detections) d on d.video_id=t.video_id and d.object_key=t.idx),
jumps as (select *, sqrt(power((x1+x2)/2-lag((x1+x2)/2) over w,2)+power((y1+y2)/2-lag((y1+y2)/2) over w,2)) as jump from frames window w as (partition by video_id, direction, idx order by frame_id)),
quality as (select video_id, direction, idx, count(*) as n, count(*)/(1+coalesce(avg(jump),0)) as quality, any_value(class_id) as voted from jumps group by 1,2,3),
named as (select m.*, n, quality, voted, (m.direction='backward', m.idx) as ahead from members m join quality q on q.video_id=m.video_id and q.direction=m.direction and q.idx=m.idx),
votes as (select video_id, component, voted, sum(n) as votes, min(ahead) as ahead from named group by 1,2,3),
classes as (select video_id, component, arg_min(voted, (-votes, ahead)) as class_id from votes group by 1,2),
led as (select f.video_id, component, frame_id, x1, y1, x2, y2, row_number() over (partition by f.video_id, component, frame_id order by quality desc, ahead) as place
 from frames f join named n on n.video_id=f.video_id and n.direction=f.direction and n.idx=f.idx),
beside as (select a.video_id, a.component, a.frame_id, a.x1, a.y1, a.x2, a.y2, b.x1 as lx1, b.y1 as ly1, b.x2 as lx2, b.y2 as ly2,
 {_iou('a', 'b')}>=0.5 or sqrt(power((a.x1+a.x2)/2-(b.x1+b.x2)/2,2)+power((a.y1+a.y2)/2-(b.y1+b.y2)/2,2))<=greatest(5, sqrt(power(b.x2-b.x1,2)+power(b.y2-b.y1,2))/2) as near
 from led a join led b on b.video_id=a.video_id and b.component=a.component and b.frame_id=a.frame_id and b.place=1),
averaged as (select video_id, component, frame_id, count(*) as n, {mean} from beside group by 1,2,3),
clipped as (select a.*, {clipped} from averaged a join fx_videos v on v.video_id=a.video_id),
merged as (select m.video_id, m.component, frame_id, class_id, {out} from clipped m join classes k on k.video_id=m.video_id and k.component=m.component)"""


F8 = " select video_id, component, frame_id, class_id, " + ", ".join(f"round({c},6) as {c}" for c in BOX) + " from merged"


def final_sql(least: int, near: int) -> str:
    smooth = ", ".join(f"avg({c}) over w as s{c}" for c in BOX)
    clipped = ", ".join(f"least(greatest(s{c},0),{'width' if c[0] == 'x' else 'height'}-1) as c{c}" for c in BOX)
    return f""", long as (select video_id, component, count(*) as n from merged group by 1,2 having count(*)>={least}),
first as (select m.video_id, m.component, min((m.direction='backward', idx)) as first from members m join long l on l.video_id=m.video_id and l.component=m.component group by 1,2),
ids as (select video_id, component, row_number() over (partition by video_id order by first) as track_id from first),
own as (select m.video_id, track_id, frame_id, class_id, x1, y1, x2, y2, {smooth}, count(*) over (partition by m.video_id, track_id) as n from merged m join ids i on i.video_id=m.video_id and i.component=m.component
 window w as (partition by m.video_id, track_id order by frame_id rows between {near} preceding and {near} following)),
cut as (select o.*, {clipped} from own o join fx_videos v on v.video_id=o.video_id)
select video_id, track_id, frame_id, class_id, """ + ", ".join(f"round(case when n>1 and cx2>cx1 and cy2>cy1 then c{c} else {c} end,6) as {c}" for c in BOX) + " from cut"


def suppressed_sql(candidates: str, members: str, iou: float) -> str:
    """The components of ``members`` that a greedy choice by score keeps; a recursion goes through a video's components, the best first, with those kept so far."""
    return f"""{candidates}, members as ({members}),
frames as (select video_id, 'forward' as direction, idx, frame_id, x1, y1, x2, y2 from fwd union all select video_id, 'backward', idx, frame_id, x1, y1, x2, y2 from bwd),
jumps as (select *, sqrt(power((x1+x2)/2-lag((x1+x2)/2) over w,2)+power((y1+y2)/2-lag((y1+y2)/2) over w,2)) as jump from frames window w as (partition by video_id, direction, idx order by frame_id)),
quality as (select video_id, direction, idx, count(*) as n, count(*)/(1+coalesce(avg(jump),0)) as quality, min(frame_id) as start from jumps group by 1,2,3),
scored as (select m.video_id, component, max(n)+max(quality)+0.25*count(*) as score, min(start) as start, min((m.direction='backward', idx)) as ahead
 from members m join quality q on q.video_id=m.video_id and q.direction=m.direction and q.idx=m.tracklet_idx group by 1,2),
placed as (select *, row_number() over (partition by video_id order by score desc, ahead) as k from scored),
met as (select a.video_id, a.direction as ad, a.idx as ai, b.direction as bd, b.idx as bi, count(*) as n, avg({_iou('a', 'b')}) as mean_iou,
 (arg_min(sqrt(power((a.x1+a.x2)/2-(b.x1+b.x2)/2,2)+power((a.y1+a.y2)/2-(b.y1+b.y2)/2,2)), a.frame_id)+arg_max(sqrt(power((a.x1+a.x2)/2-(b.x1+b.x2)/2,2)+power((a.y1+a.y2)/2-(b.y1+b.y2)/2,2)), a.frame_id))/2 as end_gap,
 avg((sqrt(power(a.x2-a.x1,2)+power(a.y2-a.y1,2))+sqrt(power(b.x2-b.x1,2)+power(b.y2-b.y1,2)))/2) as diag
 from frames a join frames b on b.video_id=a.video_id and b.frame_id=a.frame_id and (a.direction, a.idx)<(b.direction, b.idx) group by 1,2,3,4,5 having count(*)>=3),
near as (select m.* from met m join quality p on p.video_id=m.video_id and p.direction=ad and p.idx=ai join quality q on q.video_id=m.video_id and q.direction=bd and q.idx=bi
 where mean_iou>={iou} and m.n/least(p.n, q.n)>=0.6 and end_gap/greatest(diag,1)<=1.5),
sides as (select n.video_id, x.component as a, y.component as b from near n join members x on x.video_id=n.video_id and x.direction=ad and x.tracklet_idx=ai
 join members y on y.video_id=n.video_id and y.direction=bd and y.tracklet_idx=bi where x.component<>y.component),
beside as (select video_id, a, list(distinct b) as others from (select * from sides union all select video_id, b, a from sides) group by 1,2),
listed as (select p.*, coalesce(others, []) as others from placed p left join beside b on b.video_id=p.video_id and b.a=p.component),
s as (select distinct video_id, cast(0 as bigint) as k, cast([] as varchar[]) as kept from listed
 union all select s.video_id, l.k, case when list_has_any(s.kept, l.others) then s.kept else list_append(s.kept, l.component) end from s join listed l on l.video_id=s.video_id and l.k=s.k+1),
stays as (select video_id, unnest(arg_max(kept, k)) as component from s group by 1),
ordered as (select l.video_id, l.component, row_number() over (partition by l.video_id order by start, score desc, ahead)-1 as position from listed l join stays t on t.video_id=l.video_id and t.component=l.component)
select m.video_id, m.direction, m.tracklet_idx, m.component, position from members m join ordered o on o.video_id=m.video_id and o.component=m.component"""
