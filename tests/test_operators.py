"""Small cases with known answers, and invariants of the order-dependent operators."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import fusion, reports, sampling, tracking, tracks, work
from trackloom.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"
FRAME = "video_id bigint, track_id bigint, class_id int, frame_id bigint, x1 double, y1 double, x2 double, y2 double"


def frames(spark, rows):
    return spark.createDataFrame([(0, t, c, f, float(x), 0.0, float(x + 10), 10.0) for t, c, f, x in rows], FRAME)


def test_geometry(spark):
    one = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (-5.0, 0.0, 10.5, 4.5), strict=True)])
    b = G.Box.of()
    r = one.select(G.clip_bbox(b, F.lit(8), F.lit(8)).alias("c"), G.round_bbox_int(b, F.lit(100), F.lit(100)).alias("r"), G.clip_bbox(b, F.lit(0), F.lit(0)).alias("gone"), G.iou(b, b).alias("iou")).first()
    assert tuple(r["c"]) == (0.0, 0.0, 7.0, 4.5)
    assert tuple(r["r"]) == (0, 0, 10, 4)  # half to even
    assert r["gone"] is None and r["iou"] == 1.0


def test_gap_fill_is_strict(spark):
    t = frames(spark, [(1, 0, 0, 0), (1, 0, 3, 30), (1, 0, 9, 90)])
    out, gaps = tracks.interpolate_short_gaps(t, 3)
    assert [(r.frame_id, r.x1) for r in out.orderBy("frame_id").collect()] == [(0, 0.0), (1, 10.0), (2, 20.0), (3, 30.0), (9, 90.0)]
    assert gaps.count() == 1


def test_sampling_plan(spark):
    videos = spark.createDataFrame([(0, 20)], "video_id int, frame_count int")
    plans = spark.createDataFrame([(0, 2)], "video_id int, default_interval int")
    segments = spark.createDataFrame([(0, 11, 19, 7)], "video_id int, start_frame int, end_frame int, interval int")
    got = sorted(r.frame for r in sampling.sampled_frames(plans, segments, videos).collect())
    assert got == [0, 2, 4, 6, 8, 10, 11, 18, 19]
    bad = spark.createDataFrame([(0, 1, 5, 1), (0, 5, 9, 0), (0, 15, 25, 1)], segments.schema)
    assert sampling.validate_plans(plans, bad, videos).first().errors == ["bounds", "interval", "overlap"]


def test_split_and_merge(spark):
    t = frames(spark, [(1, 7, f, f) for f in (3, 4, 5, 6)])
    s = tracks.split_tracks(t, spark.createDataFrame([(0, 1, 4)], "video_id bigint, track_id bigint, frame int"))
    assert sorted((r.track_id, r.frame_id) for r in s.collect()) == [(1, 3), (1, 4), (2, 5), (2, 6)]
    m = tracks.merge_tracks(s, spark.createDataFrame([(0, 2, 1)], "video_id bigint, from_id bigint, into_id bigint"))
    assert sorted((r.track_id, r.frame_id) for r in m.collect()) == [(1, 3), (1, 4), (1, 5), (1, 6)]


def test_append_renumbers(spark):
    base, extra = frames(spark, [(2, 0, 1, 1)]), frames(spark, [(0, 1, 1, 1), (2, 1, 1, 1)])
    out = tracks.append_tracks(base, extra, 9)
    assert sorted((r.track_id, r.class_id) for r in out.collect()) == [(2, 0), (3, 9), (4, 9)]


def test_credit_ledger(spark):
    rows = [(1, 1, "a", datetime(2026, 7, 14), 60, False), (2, 1, "a", datetime(2026, 7, 14, 1), 60, False), (3, 1, "b", datetime(2026, 7, 15), 100, True), (4, 1, "b", datetime(2026, 7, 16), 120, True), (5, 2, "a", datetime(2026, 7, 14), 50, False), (6, 2, "a", datetime(2026, 7, 15), 40, False)]
    events, rejects = work.credit_ledger(spark.createDataFrame(rows, "event_id int, part_id int, annotator string, submitted_at timestamp, cumulative int, is_final boolean"))
    assert {r.event_id: r.credited for r in events.collect()} == {1: 60, 3: 40, 4: 0, 5: 50}
    assert [r.event_id for r in rejects.collect()] == [6]


def test_working_days_and_weeks(spark):
    d = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(work.working_day(d("2024-02-02"), F.lit(1)).cast("string").alias("a"), work.working_day(d("2024-02-02"), F.lit(2)).cast("string").alias("b"), work.working_day(d("2024-02-03"), F.lit(1)).cast("string").alias("c"), work.week_start(F.lit("2026-07-20 16:00:00").cast("timestamp")).cast("string").alias("w"), work.week_start(F.lit("2026-07-20 15:59:59").cast("timestamp")).cast("string").alias("v")).first()
    assert tuple(r) == ("2024-02-02", "2024-02-05", "2024-02-05", "2026-07-21", "2026-07-14")


def test_unknown_methods(spark):
    d = fixture(spark, SF, "fx_detections")
    with pytest.raises(ValueError, match="bytetrack"):
        tracking.run_tracker(d, "nothing")
    with pytest.raises(ValueError, match="forward_only"):
        fusion.fuse(d, d, "nothing")


def test_spikes(spark):
    rows = [(1, 0, f, f) for f in range(8)]
    t = frames(spark, rows).withColumn("x2", F.when(F.col("frame_id") == 6, F.col("x1") + 80).otherwise(F.col("x2")))
    out = {r.frame_id: (r.x2, r.fixed) for r in tracking.fix_spikes(t).collect()}
    assert out[6] == (16.0, True) and not out[5][1]


def test_components_partition(spark):
    pairs = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 4)], "video_id bigint, f_idx bigint, b_idx bigint")
    got = {(r.direction, r.tracklet_idx): r.component for r in fusion.connected_components(pairs).collect()}
    assert got["forward", 1] == got["forward", 2] == got["backward", 1] != got["forward", 3] == got["backward", 4]


def test_working_days_far_off(spark):
    # a day thousands of weeks ahead was looked up in a list of all days up to it.
    starts = [date(2024, 1, 29) + timedelta(days=k) for k in range(7)]
    rows = spark.createDataFrame([(s, n) for s in starts for n in [*range(1, 23), None]], "s date, n int")
    for r in rows.select("s", "n", work.working_day(F.col("s"), F.col("n")).alias("d")).collect():
        days = (r["s"] + timedelta(days=k) for k in range(100))
        assert r["d"] == (None if r["n"] is None else [d for d in days if d.weekday() < 5][r["n"] - 1])
    far = spark.range(499_001, 519_001, 1, 4).select(F.col("id").alias("n"), work.working_day(F.lit("2024-02-02").cast("date"), F.col("id").cast("int")).alias("d"))
    assert far.where((F.weekday("d") > 4) | (F.datediff("d", F.lit("2024-01-29").cast("date")) != F.floor((F.col("n") + 3) / 5) * 7 + (F.col("n") + 3) % 5)).isEmpty()


def test_lines_are_made_of_sampled_frames_only(spark):
    boxes = spark.createDataFrame([(1, 5, 0, 0, 10.0, 10.0, 30.0, 30.0), (1, 6, 0, 0, 10.0, 10.0, 30.0, 30.0), (2, 5, 0, 0, 1.0, 1.0, 2.0, 2.0)], "video_id long, video_frame_idx long, track_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    videos = spark.createDataFrame([(1, 100, 100), (2, 0, 0)], "video_id long, width int, height int")  # a line of the second would divide by 0
    sampled = spark.createDataFrame([(1, 5), (1, 7)], "video_id long, frame long")
    out = sampling.export_sampled(boxes, sampled, videos).orderBy("frame").collect()
    assert [(r.video_id, r.frame, r.boxes) for r in out] == [(1, 5, 1), (1, 7, 0)]
    assert out[0].content.startswith("0 0.2")


def test_the_tasks_that_admins_see_are_dealt_over_many_partitions(spark):
    tasks = spark.range(600).selectExpr("id as task_id", "'u1' as publisher", "'u2' as manager", "id % 5 = 0 as deleted")
    users = spark.createDataFrame([("a1", "admin", True), ("a2", "admin", True), ("a3", "admin", False), ("u1", "user", True)], "username string, role string, is_active boolean")
    rows = reports.visible(tasks, users).withColumn("at", F.spark_partition_id()).collect()
    live = [t for t in range(600) if t % 5]
    assert sorted((r.username, r.task_id, r.sees, r.may_review) for r in rows) == sorted((n, t, True, True) for n in ("a1", "a2", "u1") for t in live)
    assert len({r["at"] for r in rows if r.username != "u1"}) > 50
