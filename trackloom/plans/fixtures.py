"""Annotation tables derived from the given tables. The same text defines them for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")

VIEWS = {
    "fx_videos": """select distinct cast(floor(c_custkey/6) as bigint) as video_id, 1920 as width, 1080 as height,
        50 as frame_count, 1 as frame_offset, cast(25 as double) as fps from customer""",
    "fx_detections": """select *, cast(row_number() over (partition by video_id, frame_id order by object_key) - 1 as int) as det_idx from (
        select cast(floor(c_custkey/6) as bigint) as video_id, n_nationkey*2+r_regionkey+1 as frame_id,
        n_nationkey*2+r_regionkey as video_frame_idx, c_custkey as object_key, cast(c_nationkey % 3 as int) as class_id,
        cast(100+(c_custkey%6)*280+(n_nationkey*2+r_regionkey)*(1+c_custkey%4) as double) as x1,
        cast(80+(c_custkey%6)*130+(n_nationkey*2+r_regionkey)*(c_custkey%3) as double) as y1,
        cast(100+(c_custkey%6)*280+(n_nationkey*2+r_regionkey)*(1+c_custkey%4)+60+c_custkey%9 as double) as x2,
        cast(80+(c_custkey%6)*130+(n_nationkey*2+r_regionkey)*(c_custkey%3)+90+c_custkey%7 as double) as y2,
        cast(50+((c_custkey*7+n_nationkey*2+r_regionkey)%50) as double)/100.0 as score
        from customer cross join nation cross join region
        where r_regionkey<2 and (c_custkey*31+(n_nationkey*2+r_regionkey)*17)%11<>0) d""",
    "fx_track_frames": """select user_id%8 as video_id, user_id as track_id, cast(user_id%3 as int) as class_id,
        cast(rn*4+event_id%3 as bigint) as frame_id, cast(rn*4+event_id%3 as bigint) as video_frame_idx,
        cast(user_id*11%1500-(case when user_id%50=7 then 2000 else 0 end) as double) as x1, cast(user_id*7%700 as double) as y1,
        cast(user_id*11%1500-(case when user_id%50=7 then 2000 else 0 end)+(20+event_id%7)*(case when event_id%29=0 then 5 else 1 end) as double) as x2,
        cast(user_id*7%700+(30+event_id%5)*(case when event_id%29=0 then 5 else 1 end) as double) as y2
        from (select e.*, row_number() over (partition by user_id order by ts,event_id) as rn from events e) q""",
    "fx_users": """select distinct concat('u',cast(user_id as varchar(20))) as username,
        concat('User ',cast(user_id as varchar(20))) as display_name,
        case when user_id%20=0 then 'admin' else 'user' end as role, user_id%17<>0 as is_active from events""",
    "fx_tasks": """select o_orderkey as task_id, o_orderpriority as product_tag, o_orderstatus as project,
        concat('u',cast(o_custkey%40 as varchar(20))) as publisher, o_orderdate as updated_at, o_orderkey%37 as rank,
        o_custkey%19=0 as deleted,
        case when o_orderkey%5=0 then cast(0 as double) else cast(o_orderkey%90 as double) end as estimated_hours,
        cast(600 as double)*(o_orderkey%4) as expected_part_seconds,
        case when o_orderkey%11=0 then 'completed' else 'in_progress' end as status, concat('u',cast(o_custkey%23 as varchar(20))) as manager,
        case when o_orderkey%3=0 then '1,200' when o_orderkey%3=1 then cast(o_orderkey%900 as varchar(20)) else '100-200' end as data_amount,
        case when o_orderkey%4=0 then '0' when o_orderkey%4=1 then '80-100' else '50' end as hourly_capacity from orders""",
    "fx_parts": """select l_orderkey*100+rn as part_id, l_orderkey as task_id, rn as part_index, cast(l_quantity as int) as image_count,
        cast(floor(l_quantity*(1-l_discount)) as int) as progress_count,
        case when l_linenumber%3=0 then null else cast(l_partkey%200 as int) end as bbox_count,
        case when l_returnflag='A' then 'completed' when l_returnflag='R' then 'rework'
             when l_linestatus='F' then 'submitted' when l_linenumber%2=0 then 'pending' else 'in_progress' end as status,
        case when l_returnflag='N' and l_linestatus<>'F' and l_linenumber%2=0 then null
             else concat('u',cast(l_suppkey%150 as varchar(20))) end as annotator,
        case when l_returnflag in ('A','R') or l_linestatus='F' then l_shipdate end as submitted_at,
        cast(floor(l_extendedprice/10) as double) as work_seconds,
        case when l_linenumber=7 then cast(1800 as double) end as work_seconds_override
        from (select l.*, row_number() over (partition by l_orderkey
              order by l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice,l_quantity) as rn from lineitem l) q""",
    "fx_sessions": """select event_id as session_id, (user_id%50)*100+1+event_id%3 as part_id,
        concat('u',cast(user_id as varchar(20))) as annotator, ts as started_at,
        case when event_type<>'error' then ts + interval '1' minute * cast(floor(value) as int) end as ended_at from events""",
    "fx_submissions": """select event_id, (user_id%50)*100+1+event_id%3 as part_id, concat('u',cast(user_id as varchar(20))) as annotator,
        ts as submitted_at,
        10*(row_number() over (partition by (user_id%50)*100+1+event_id%3 order by ts,event_id)) as cumulative,
        event_type='purchase' as is_final from events""",
    "fx_actions": """select event_id as action_id, ts, cast(user_id%25 as bigint) as task_id, concat('u',cast(event_id%5 as varchar(20))) as actor,
        case event_id%11 when 0 then 'claim' when 1 then 'pause' when 2 then 'resume' when 3 then 'claim' when 4 then 'submit' when 5 then 'approve'
             when 6 then 'reject' when 7 then 'progress' when 8 then 'rework' when 9 then 'submit' else 'return' end as action,
        case when event_id%11 not in (0,3) then cast((user_id%25)*10+1+cast(floor(event_id/11) as bigint)%4 as bigint) end as part_id,
        case when event_id%11=7 then cast(event_id%120 as bigint) end as value from events""",
    "fx_action_tasks": """select distinct cast(user_id%25 as bigint) as task_id, 'u1' as publisher, concat('u',cast(user_id%25%5 as varchar(20))) as manager from events""",
    "fx_action_parts": """select distinct cast(user_id%25 as bigint)*10+k as part_id, cast(user_id%25 as bigint) as task_id, k as part_index, cast(100 as bigint) as image_count
        from events cross join (select distinct cast(event_id%6+1 as bigint) as k from events) n""",
}
#: The moment that stands for now in reports over open sessions.
NOW = "timestamp '2024-01-31 12:00:00'"
WINDOW = ("timestamp '2024-01-08 00:00:00'", "timestamp '2024-01-15 00:00:00'")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"from {t}" in VIEWS[name] or f"join {t}" in VIEWS[name]}
    text = VIEWS[name]
    for t in used:
        for word in ("from", "join"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """The views that a query needs, then the query; a body with a step of its own calls for a recursive one."""
    return ("with recursive " if "union all select s." in body else "with ") + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + "\n" + body
