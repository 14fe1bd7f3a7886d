import pytest

from trackloom.operators import fusion, graphs, tracks


def test_components_become_tracks(spark):
    videos = spark.createDataFrame([(1, 100, 100)], "video_id long, width int, height int")
    rows = [(1, "forward", 4, f, 2, 10.0 + 4 * f, 10.0, 30.0 + 4 * f, 30.0) for f in range(4)]
    rows += [(1, "backward", 9, f, 1, 12.0 + 4 * f, 10.0, 32.0 + 4 * f, 30.0) for f in range(3)]
    rows += [(1, "backward", 2, f, 0, 70.0, 70.0, 90.0, 90.0) for f in range(2)] + [(1, "backward", 1, 0, 0, 0.0, 0.0, 5.0, 5.0)]
    frames = spark.createDataFrame(rows, "video_id long, direction string, tracklet_idx long, frame_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    members = spark.createDataFrame([(1, "forward", 4, "a"), (1, "backward", 9, "a"), (1, "backward", 2, "b"), (1, "backward", 1, "c")], "video_id long, direction string, tracklet_idx long, component string")
    merged = fusion.merge_components(frames, members, videos)
    a = merged.where("component = 'a'").orderBy("frame_id").collect()
    assert [(r.class_id, r.x1) for r in a] == [(2, 11.0), (2, 15.0), (2, 19.0), (2, 22.0)]
    final = fusion.final_tracks(merged, members, videos, 2, 1).orderBy("track_id", "frame_id").collect()
    assert [(r.track_id, r.frame_id) for r in final] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]  # c is too short, forward tracklets come first


def test_class_ties_go_to_the_first_tracklet(spark):
    videos = spark.createDataFrame([(1, 100, 100)], "video_id long, width int, height int")
    rows = [(1, "forward", 7, f, 5, 0.0, 0.0, 10.0, 10.0) for f in range(3)] + [(1, "backward", 1, f, 3, 0.0, 0.0, 10.0, 10.0) for f in range(3)]
    frames = spark.createDataFrame(rows, "video_id long, direction string, tracklet_idx long, frame_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    members = spark.createDataFrame([(1, "forward", 7, "a"), (1, "backward", 1, "a")], "video_id long, direction string, tracklet_idx long, component string")
    assert {r.class_id for r in fusion.merge_components(frames, members, videos).collect()} == {5}


def test_boxes_far_from_the_leading_one_are_left_out(spark):
    videos = spark.createDataFrame([(1, 100, 100)], "video_id long, width int, height int")
    rows = [(1, "forward", 1, f, 0, 0.0, 0.0, 10.0, 10.0) for f in range(3)] + [(1, "backward", 2, 0, 0, 60.0, 60.0, 70.0, 70.0)]
    frames = spark.createDataFrame(rows, "video_id long, direction string, tracklet_idx long, frame_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    members = spark.createDataFrame([(1, "forward", 1, "a"), (1, "backward", 2, "a")], "video_id long, direction string, tracklet_idx long, component string")
    found = fusion.merge_components(frames, members, videos).where("frame_id = 0").first()
    assert (found.x1, found.x2) == (0.0, 10.0)


def counted(spark, df):
    """df, and a counter of the rows of it that jobs have read."""
    read = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            read.add(len(b))
            yield b

    return df.mapInPandas(work, df.schema), read


def test_edges_of_components_are_found_once(spark):
    edges, read = counted(spark, spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8)], "a long, b long"))
    assert {tuple(r) for r in graphs.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)}
    assert read.value == 4


def test_a_filter_passes_its_detections_once(spark):
    rows = [(1, f, 0, 0, 0.9, 10.0 + f, 10.0, 50.0 + f, 60.0) for f in range(12)] + [(1, f, 1, 0, 0.9, 300.0, 10.0, 350.0, 60.0) for f in range(4)]
    given = spark.createDataFrame(rows, "video_id long, frame_id long, det_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    detections, read = counted(spark, given)
    frames, videos = given.select("video_id", "frame_id").distinct(), spark.createDataFrame([(1, 400, 100)], "video_id long, width int, height int")
    kept = fusion.filter_detections(detections, frames, videos, "sort").collect()
    assert sorted(r.frame_id for r in kept) == list(range(12))
    assert read.value <= 2 * len(rows)  # for the pass, and for the rows that stay


def test_pairs_of_a_least_overlap_are_those_of_all_pairs(spark):
    rows = [(1, t, f, 30.0 * t + f, 10.0, 30.0 * t + f + 40.0, 50.0) for t in range(6) for f in range(9) if (t + f) % 4]
    fwd = spark.createDataFrame(rows, "video_id long, tracklet_idx long, frame_id long, x1 double, y1 double, x2 double, y2 double")
    bwd = fwd.withColumn("x1", fwd.x1 + 5).withColumn("x2", fwd.x2 + 5)
    short = lambda df: sorted((r.f_idx, r.b_idx, r.n, round(r.mean_iou, 9), round(r.normalized_gap, 9), round(r.score, 9)) for r in df.collect())
    for least, apart, found in ((0.05, False, True), (0.3, False, True), (0.05, True, True), (0.3, True, False)):
        every = short(tracks.pair_overlap(fwd, bwd, apart=apart).where(f"mean_iou >= {least}"))
        assert short(tracks.pair_overlap(fwd, bwd, apart=apart, iou=least)) == every and bool(every) == found


BOXES = "video_id long, tracklet_idx long, frame_id long, x1 double, y1 double, x2 double, y2 double"


def drifting(spark, tracklets=4, n=9, shift=0.0):
    return spark.createDataFrame([(v, t, f, 60.0 * t + f + shift, 10.0, 60.0 * t + f + shift + 40.0, 50.0) for v in (1, 2) for t in range(tracklets) for f in range(n)], BOXES)


@pytest.mark.parametrize("method", ["bidirectional_iou", "bidirectional_iou_forward_primary", "bidirectional_iou_forward_unique", "bidirectional_iou_all_pairs", "bidirectional_iou_nms"])
def test_a_fusion_reads_its_frames_once(spark, method):
    fwd, read = counted(spark, drifting(spark))
    rows = fusion.fuse(fwd, drifting(spark, 3, 7, 3.0), method, 0.3).collect()
    assert sorted((r.video_id, r.direction, r.tracklet_idx) for r in rows if r.direction == "forward") == [(v, "forward", t) for v in (1, 2) for t in range(4)]
    assert len({(r.video_id, r.component) for r in rows}) == 8  # three pairs and a lone one in each video
    assert read.value == 2 * 4 * 9


def test_odd_frames_are_counted_as_they_are(spark):
    """Rows without a frame meet nothing, but count for their tracklet; a frame given twice counts twice."""
    fwd = spark.createDataFrame([(1, 1, f, 0.0, 0.0, 10.0, 10.0) for f in (0, 1, 2, 2, None)], BOXES)
    bwd = spark.createDataFrame([(1, 1, f, 0.0, 0.0, 10.0, 10.0) for f in (0, 1, 2, 3, 4, 5, 6, 7, None)], BOXES)
    found = tracks.pair_overlap(fwd, bwd).first()
    assert (found.n, found.mean_iou, found.overlap_ratio) == (4, 1.0, 4 / 5)


def test_merging_reads_its_frames_once(spark):
    videos = spark.createDataFrame([(1, 100, 100)], "video_id long, width int, height int")
    rows = [(1, way, i, f, i, 10.0 * i + f, 10.0, 10.0 * i + f + 20.0, 30.0) for way, i, n in (("forward", 1, 6), ("backward", 1, 4), ("backward", 3, 2), ("backward", 5, 9)) for f in range(n)]
    frames, read = counted(spark, spark.createDataFrame(rows, "video_id long, direction string, tracklet_idx long, frame_id long, class_id int, x1 double, y1 double, x2 double, y2 double"))
    members = spark.createDataFrame([(1, "forward", 1, "a"), (1, "backward", 1, "a"), (1, "backward", 3, "b"), (1, "forward", 9, "c")], "video_id long, direction string, tracklet_idx long, component string")
    merged = fusion.merge_components(frames, members, videos).collect()
    assert sorted((r.component, r.frame_id, r.class_id, r.x1) for r in merged) == [("a", f, 1, 10.0 + f) for f in range(6)] + [("b", f, 3, 30.0 + f) for f in range(2)]
    assert read.value == len(rows)


def test_final_tracks_read_what_was_merged_once(spark):
    videos = spark.createDataFrame([(1, 100, 100)], "video_id long, width int, height int")
    rows = [(1, c, f, 0, 10.0 + 2 * f, 10.0, 30.0 + 2 * f, 30.0) for c, n in (("b5", 5), ("c1", 4), ("b2", 2), ("f9", 4)) for f in range(n)]
    merged, read = counted(spark, spark.createDataFrame(rows, "video_id long, component string, frame_id long, class_id int, x1 double, y1 double, x2 double, y2 double"))
    members = spark.createDataFrame([(1, "backward", 5, "b5"), (1, "backward", 2, "c1"), (1, "forward", 4, "c1"), (1, "backward", 1, "b2"), (1, "forward", 9, "f9")], "video_id long, direction string, tracklet_idx long, component string")
    final = fusion.final_tracks(merged, members, videos, 3, 3).collect()
    assert sorted((r.track_id, r.frame_id) for r in final) == [(t, f) for t, n in ((1, 4), (2, 4), (3, 5)) for f in range(n)]
    assert read.value == len(rows)


def test_a_filter_leaves_detections_where_they_are(spark):
    rows = [(1, f, 0, 0, 0.9, 10.0 + f, 10.0, 50.0 + f, 60.0) for f in range(12)] + [(1, f, 1, 0, 0.9, 300.0, 10.0, 350.0, 60.0) for f in range(4)]
    given = spark.createDataFrame(rows, "video_id long, frame_id int, det_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    frames, videos = given.select("video_id", "frame_id").distinct(), spark.createDataFrame([(1, 400, 100)], "video_id long, width int, height int")
    dealt = given.repartition("video_id", "frame_id")
    for method in fusion.FUSERS:
        kept = fusion.filter_detections(dealt, frames, videos, "sort", method)
        assert kept.columns == given.columns and sorted((r.frame_id, r.det_idx) for r in kept.collect()) == [(f, 0) for f in range(12)]
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert kept._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange hashpartitioning") == 2  # the detections' own, and the lists'
