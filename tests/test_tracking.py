"""The trackers against a plain version of them, and fusion's orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.tracker_oracle import track
from trackloom.operators import fusion, tracking
from trackloom.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"
METHODS = ["sort", "bytetrack", "oc_sort", "bot_sort", "hybrid_sort", "deep_oc_sort", "cbiou", "sparse_track"]
DETECTION = "video_id bigint, frame_id bigint, det_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def scenes(spark):
    """Videos of the fixture with fewer scores, gaps of whole frames and crossing paths."""
    rows = [(r.video_id, r.frame_id, r.det_idx, r.class_id, r.score, r.x1, r.y1, r.x2, r.y2) for r in fixture(spark, SF, "fx_detections").where("video_id < 3").collect()]
    rows = [r for r in rows if not (r[0] == 1 and 10 <= r[1] <= 14) and not (r[0] == 2 and 20 <= r[1] <= 40)]
    r = np.random.RandomState(4)
    for f in range(1, 41):
        for k in range(5):
            if r.rand() < 0.85:
                x, y = 100 + k * 30 + f * (k - 2) * 4 + r.randn() * 2, 100 + k * 12 + r.randn() * 2
                rows.append((9, f, k, k % 2, float(np.round(r.rand() * 0.9 + 0.05, 3)), x, y, x + 60 + r.randn(), y + 80 + 4 * k + r.randn()))
    return rows


@pytest.mark.parametrize("method", METHODS)
def test_trackers_equal_the_plain_ones(spark, scenes, method):
    videos = sorted({r[0] for r in scenes})
    every = spark.createDataFrame([(v, f) for v in videos for f in range(1, 51)], "video_id bigint, frame_id bigint")
    got = {}
    for r in tracking.run_tracker(spark.createDataFrame(scenes, DETECTION), method, frames=every).collect():
        got[r.video_id, r.direction, r.frame_id, r.det_idx] = (r.tracklet_idx, r.number, [r.x1, r.y1, r.x2, r.y2])
    want = {}
    for v in videos:
        frames = [(f, [{"at": r[2], "class": r[3], "score": r[4], "box": list(r[5:])} for r in sorted(scenes) if r[:2] == (v, f)]) for f in range(1, 51)]
        for way in ("forward", "backward"):
            want |= {(v, way, *k): t for k, t in track(frames, method, way == "forward").items()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and np.allclose(got[k][2], want[k][2], atol=0.05) for k in want)


def test_tracks_end_over_empty_frames(spark):
    rows = [(1, f, 0, 0, 0.9, 10.0, 10.0, 30.0, 30.0) for f in (1, 2, 3, 60, 61)]
    d = spark.createDataFrame(rows, DETECTION)
    forward = lambda **k: {r.number for r in tracking.run_tracker(d, "sort", **k).where("direction = 'forward'").collect()}
    assert forward() == {1} and forward(frames=spark.range(1, 62).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_id"))) == {1, 2}


def test_without_kalman_and_without_classes(spark):
    rows = [(1, f, 0, f % 2, 0.9, 10.0 + 3 * f, 10.0, 30.0 + 3 * f, 30.0) for f in range(6)]
    d = spark.createDataFrame(rows, DETECTION)
    out = tracking.run_tracker(d, "bytetrack", {"disable_kalman": True, "class_agnostic": True}).where("direction = 'forward'").orderBy("frame_id").collect()
    assert [r.number for r in out] == [1] * 6 and [r.x1 for r in out] == [10.0 + 3 * f for f in range(6)] and [r.class_id for r in out] == [0, 1] * 3
    assert len({r.number for r in tracking.run_tracker(d, "bytetrack").where("direction = 'forward'").collect()}) == 2


def test_spikes_need_consecutive_numbers_to_be_a_run(spark):
    rows = [(1, 1, 0, 4 * k, float(k), 0.0, k + (200.0 if k in (8, 9, 10, 11) else 10.0), 10.0) for k in range(20)]
    t = spark.createDataFrame(rows, "video_id bigint, track_id bigint, class_id int, frame_id bigint, x1 double, y1 double, x2 double, y2 double")
    fixed = tracking.fix_spikes(t, max_run=3)
    assert sorted(r.frame_id for r in fixed.where("fixed").collect()) == [32, 36, 40, 44]
    assert {(r.run_start, r.anchor_before, r.anchor_after, r.frames) for r in tracking.fixed_intervals(fixed).collect()} == {(f, 28, 48, 1) for f in (32, 36, 40, 44)}
    dense = t.withColumn("frame_id", (F.col("frame_id") / 4).cast("bigint"))
    assert tracking.fix_spikes(dense, max_run=3).where("fixed").count() == 0 and tracking.fix_spikes(dense, max_run=4).where("fixed").count() == 4
    assert tracking.fix_spikes(dense, start_frame=10).where("fixed").count() == 2
    assert tracking.fix_spikes(t.where("frame_id < 16")).where("fixed").count() == 0


TRACKLET = "video_id bigint, tracklet_idx bigint, frame_id bigint, x1 double, y1 double, x2 double, y2 double"


def test_suppression_keeps_the_better_of_overlapping_components(spark):
    line = lambda i, n, at, y: [(1, i, f, at + 5.0 * f, y, at + 5.0 * f + 20, y + 20) for f in range(n)]
    fwd = spark.createDataFrame(line(0, 8, 0.0, 0.0) + line(1, 20, 1.0, 0.0) + line(2, 5, 300.0, 90.0), TRACKLET)
    bwd = spark.createDataFrame(line(0, 20, 1.5, 0.0) + line(1, 4, 600.0, 90.0), TRACKLET)
    got = sorted((r.position, r.direction, r.tracklet_idx) for r in fusion.fuse(fwd, bwd, "bidirectional_iou_nms", 0.5).collect())
    assert [(d, i) for _, d, i in got] == [("backward", 0), ("forward", 1), ("forward", 2), ("backward", 1)]


def test_detections_off_any_track_go(spark):
    rows = [(1, f, 0, 0, 0.9, 10.0 + f, 10.0, 40.0 + f, 40.0) for f in range(1, 13)] + [(1, 6, 1, 0, 0.9, 200.0, 200.0, 220.0, 220.0)]
    d = spark.createDataFrame(rows, DETECTION).withColumn("line", F.lit("0 0.5 0.5 0.1 0.1"))
    frames = spark.range(1, 15).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_id"))
    kept = fusion.filter_detections(d, frames, None)
    assert kept.count() == 12 and kept.columns == d.columns
    counts = fusion.filter_counts(d, kept, frames).collect()
    assert len(counts) == 14 and sum(r.removed for r in counts) == 1 and sum(r.n_in for r in counts) == 13


def passing(objects, frames, seed=0):
    """Objects that come and go, some with gaps that end their tracks, each in a row of its own."""
    r = np.random.RandomState(seed)
    rows = []
    for k in range(objects):
        begin = r.randint(0, frames - 60)
        end, hole = min(frames, begin + r.randint(40, 400)), r.randint(begin, begin + 200)
        for f in range(begin, end):
            if r.rand() < 0.9 and not hole <= f < hole + 25:
                rows.append((1, f, k, k % 2, float(np.round(0.6 + 0.4 * r.rand(), 3)), 10.0 + (f - begin), 50.0 * k, 40.0 + (f - begin), 50.0 * k + 40))
    return rows


@pytest.mark.parametrize("method", ["sort", "bytetrack", "oc_sort", "sparse_track"])
def test_segments_joined_at_seams_number_as_the_whole(spark, method):
    d = spark.createDataFrame(passing(12, 900), DETECTION)
    frames = spark.range(900).select(F.lit(1).cast("bigint").alias("video_id"), F.col("id").alias("frame_id"))
    told = lambda df: {(r.direction, r.frame_id, r.det_idx): r.number for r in df.collect()}
    whole = told(tracking.run_tracker(d, method, frames=frames))
    assert told(tracking.track_segments(d, frames, 100, method)) == whole and len(set(whole.values())) > 12
    # Without overlap nothing says which tracks go on.
    assert len(set(told(tracking.track_segments(d, frames, 100, method, overlap=0)).values())) > len(set(whole.values()))


def test_a_long_video_is_read_batch_by_batch(spark):
    """Many more frames than a batch has rows, in batches that cut frames; what is held are a batch and the live tracks."""
    n = 3000
    d = spark.range(n * 4).select(F.lit(1).cast("bigint").alias("video_id"), (F.col("id") / 4).cast("bigint").alias("frame_id"), (F.col("id") % 4).cast("int").alias("det_idx"), F.lit(0).alias("class_id"), F.lit(0.9).alias("score"))
    x = (F.col("frame_id") % 500).cast("double")
    d = d.select("*", x.alias("x1"), (F.col("det_idx") * 100.0).alias("y1"), (x + 40).alias("x2"), (F.col("det_idx") * 100.0 + 40).alias("y2"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1001")
    try:
        out = tracking.run_tracker(d, "sort").groupBy("direction", "number").agg(F.count("*").alias("n"), F.min("frame_id").alias("lo"), F.max("tracklet_idx").alias("t"), F.countDistinct("tracklet_idx").alias("one")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == 48 and all(r.n == 500 and r.one == 1 for r in out)
    assert {r.lo for r in out if r.direction == "forward" and r.number <= 4} == {0} and {r.lo for r in out if r.direction == "backward" and r.number <= 4} == {2500}
    plan = tracking.run_tracker(d, "sort")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_lanes_hold_live_tracks_only():
    own = tracking.Lanes("sort", tracking.DEFAULTS)
    own.open(np.array([True]))
    most = 0
    for f in range(2000):
        box = np.array([[f % 100 * 1.0, 0, f % 100 + 40.0, 40]])
        own.step(f, np.array([0]), tracking.Detections(np.zeros(1, np.int64), np.zeros(1, np.int64), box, np.ones(1), np.zeros(1, np.int64)))
        own.taken()
        most = max(most, len(own.tracks))
    assert own.begun[0] == 20 and most <= 2 and not own.rows


def test_greedy_in_rounds_is_greedy_in_order():
    r = np.random.RandomState(1)
    for _ in range(50):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(5), indexing="ij"))
        scores = r.randint(0, 4, len(i)) / 4
        want, a, b = set(), set(), set()
        for k in sorted(range(len(i)), key=lambda k: (-scores[k], i[k], j[k])):
            if i[k] not in a and j[k] not in b:
                a.add(i[k])
                b.add(j[k])
                want.add(k)
        assert set(tracking.greedy(scores, i, j).tolist()) == want


def test_spikes_of_short_tracks_need_no_frames_of_pandas(spark):
    # F16, F24: a pandas frame for each of many short tracks, and three medians by numpy for each row, took most of the time.
    rows = [(0, t, None if t == 1 else 2, f, 0.0, 0.0, 10.0 * (9 if f == 7 else 1), 10.0 if (t, f) != (2, 3) else None) for t in range(3) for f in range(12)]
    t = spark.createDataFrame(rows[::-1], "video_id bigint, track_id bigint, class_id int, frame_id bigint, x1 double, y1 double, x2 double, y2 double")
    out = tracking.fix_spikes(t)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.track_id, r.frame_id): r for r in out.collect()}
    assert len(got) == 36 and {k for k, r in got.items() if r.fixed} == {(0, 7), (1, 7), (2, 7)} and got[1, 7].class_id is None
    assert (got[0, 7].x2, got[0, 7].run_start, got[0, 7].anchor_before, got[0, 7].anchor_after) == (10.0, 7, 6, 8)
    assert got[2, 3].y2 is None and got[2, 7].x2 == 10.0


def test_numbered_passes_are_the_trackers_and_shuffle_detections_once(spark, scenes):
    detections = spark.createDataFrame(scenes, DETECTION)
    short = lambda df: sorted(tuple(r) for r in df.select("video_id", "direction", "frame_id", "det_idx", "number", "class_id", *tracking.BOX).collect())
    found = tracking.numbered(detections, "sparse_track")
    assert short(found) == short(tracking.run_tracker(detections, "sparse_track"))
    assert found._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange hashpartitioning") == 1
