"""SQL for the trackers on the fixture of detections: its objects keep apart, so a track is an object's detections without a gap of more than 15 frames."""

from __future__ import annotations

AXES = "xywh"


def tracker_sql(start: float, observed: bool) -> str:
    """Rows of a pass in each direction. ``start`` is the least score that begins a track; ``observed``: velocities are taken from the observations.

    A step of the recursion is a frame. An axis of the motion model has a place p and a velocity v, all four share the
    covariance (a, b, c), in 32 bits; m is the last measurement.
    """
    each = lambda f, *between: ", ".join(f(x) for x in AXES)
    seen = "d.object_key is not null and s.live"
    new = f"d.object_key is not null and not s.live and d.score >= {start}"
    pa, pb, pc = "(s.a + 2::float * s.b + s.c + 0.01::float)", "(s.b + s.c)", "(s.c + 0.01::float)"
    ga, gb = f"({pa} / ({pa} + 0.1::float))", f"({pb} / ({pa} + 0.1::float))"
    place = lambda x: f"(s.p{x} + s.v{x})"
    off = lambda x: f"(d.m{x}::float - {place(x)})"
    p = lambda x: f"case when {seen} then {place(x)} + {ga} * {off(x)} when {new} then d.m{x}::float else {place(x)} end as p{x}"
    own = (lambda x: f"((d.m{x} - s.m{x}) / (s.k + 1 - s.seen))::float") if observed else (lambda x: f"s.v{x} + {gb} * {off(x)}")
    v = lambda x: f"case when {seen} then {own(x)} when {new} then 0::float else s.v{x} end as v{x}"
    corner = lambda x, size, sign: f"case when fresh then {'xy'[x == 'y']}{1 if sign == '-' else 2} else (p{x} {sign} greatest(p{size}, 1::float) / 2::float)::double end"
    boxes = ", ".join(f"round({corner(x, size, sign)}, 6) as {x}{n}" for n, sign in ((1, "-"), (2, "+")) for x, size in (("x", "w"), ("y", "h")))
    return f""", steps as materialized (select video_id, object_key, frame_id, direction, case when direction = 'forward' then frame_id else 51 - frame_id end as k, det_idx, class_id, score, x1, y1, x2, y2,
        (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my, greatest(x2 - x1, 0) as mw, greatest(y2 - y1, 0) as mh from fx_detections cross join (select unnest(['forward', 'backward']) as direction) w),
    s as (select distinct video_id, direction, object_key, 0 as k, false as live, 0 as misses, 0 as seen, 0 as begun, 0 as ended, false as fresh, false as here,
        {each(lambda x: f"0::float as p{x}")}, {each(lambda x: f"0::float as v{x}")}, {each(lambda x: f"0::double as m{x}")}, 1::float as a, 0::float as b, 1::float as c from steps
      union all select s.video_id, s.direction, s.object_key, s.k + 1, case when {seen} or {new} then true else s.live and s.misses < 15 end,
        case when {seen} or {new} then 0 else s.misses + 1 end, case when {seen} or {new} then s.k + 1 else s.seen end, case when {new} then s.k + 1 else s.begun end,
        case when s.live and d.object_key is null and s.misses >= 15 then s.k + 1 else s.ended end, {new}, {seen} or {new}, {each(p)}, {each(v)}, {each(lambda x: f"coalesce(d.m{x}, s.m{x})")},
        case when {seen} then {pa} - {ga} * {pa} when {new} then 1::float else {pa} end, case when {seen} then {pb} - {ga} * {pb} when {new} then 0::float else {pb} end,
        case when {seen} then {pc} - {gb} * {pb} when {new} then 1::float else {pc} end
      from s left join steps d on d.video_id = s.video_id and d.direction = s.direction and d.object_key = s.object_key and d.k = s.k + 1 where s.k < 50),
    ends as (select video_id, direction, object_key, begun, max(misses) filter (k = 50 or ended = k) as misses, max(case when ended = k then k end) as ended, min(k) as k from s where begun > 0 and (live or ended = k) group by all),
    begins as (select e.*, row_number() over (partition by e.video_id, e.direction order by e.begun, d.det_idx) as number
      from ends e join steps d on d.video_id = e.video_id and d.direction = e.direction and d.object_key = e.object_key and d.k = e.begun),
    tracks as (select *, row_number() over (partition by video_id, direction order by coalesce(ended, 1000), number) - 1 as tracklet_idx from begins)
    select d.video_id, d.direction, d.frame_id, d.det_idx, t.tracklet_idx, t.number, d.class_id, t.misses, {boxes}
    from s join steps d on d.video_id = s.video_id and d.direction = s.direction and d.object_key = s.object_key and d.k = s.k
    join tracks t on t.video_id = s.video_id and t.direction = s.direction and t.object_key = s.object_key and t.begun = s.begun where s.here"""
