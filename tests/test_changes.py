import pytest

from trackloom.operators import boxes, changes, work


def test_field_changes_and_nulls(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, rank int")
    b = spark.createDataFrame([(1, "a", 3), (2, "b", 5)], "id long, name string, rank int")
    assert [tuple(r) for r in changes.field_changes(a, b, "id", ["name", "rank"]).collect()] == [(1, "rank", None, "3")]


def test_add_parts_by_path(spark):
    old = spark.createDataFrame([(1, 1, "A\\b"), (1, 5, "x/y")], "task_id long, part_index int, path string")
    paths = ["a\\B\\", "c", "C", "./c", "x//y", "D:/q", "d:\\Q", None]
    new = spark.createDataFrame([(1, k, p) for k, p in enumerate(paths)], "task_id long, part_index int, path string")
    got = {r.part_index: (r.accepted, r.new_index) for r in changes.add_parts(old, new).collect()}
    assert got == {0: (False, None), 1: (True, 6), 2: (True, 7), 3: (False, None), 4: (False, None), 5: (True, 8), 6: (False, None), 7: (True, 9)}


def test_reassign_frees_unfinished_parts(spark):
    tasks = spark.createDataFrame([(1, "ann", "ann"), (2, "cy", "ann"), (3, "ann", None)], "task_id long, publisher string, manager string")
    parts = spark.createDataFrame([(1, "ann", "rework", 9.0), (2, "ann", "completed", 8.0), (3, None, "pending", 0.0), (4, "ann", "paused", 7.0)], "part_id long, annotator string, status string, work_seconds double")
    sessions = spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "session_id long, part_id long")
    after = changes.reassign(tasks, parts, sessions, "ann", "bo")
    assert sorted((r.task_id, r.publisher, r.manager) for r in after["tasks"].collect()) == [(1, "bo", "bo"), (2, "cy", "cy"), (3, "bo", None)]
    assert sorted((r.part_id, r.annotator, r.status, r.work_seconds) for r in after["parts"].collect()) == [(1, None, "pending", 0.0), (2, "ann", "completed", 8.0), (3, None, "pending", 0.0), (4, None, "pending", 0.0)]
    assert [r.part_id for r in after["sessions"].collect()] == [2] and after["comments"].count() == 2
    assert sorted((r.task_id, r.field, r.old, r.new) for r in after["audit"].collect()) == [(1, "publisher", "ann", "bo"), (2, "manager", "ann", "cy"), (3, "publisher", "ann", "bo")]


def test_ranks_go_over_all_active_tasks(spark):
    rows = [(1, 5, 1, False, "in_progress"), (2, 5, 2, False, "completed"), (3, 2, 1, False, "ready"), (4, 5, 3, False, "ready"), (5, 1, 1, True, "ready")]
    tasks = spark.createDataFrame(rows, "task_id long, rank int, updated_at long, deleted boolean, status string")
    ranked = work.normalize_ranks(tasks)
    assert {r.task_id: (r.new_rank, r.changed) for r in ranked.collect()} == {3: (1, True), 4: (2, True), 1: (3, True)}
    moved, audit = work.move_rank(ranked, 1, 1)
    assert {r.task_id: r.moved_rank for r in moved.collect()} == {1: 1, 3: 2, 4: 3} and audit.count() == 3
    assert {r.task_id: r.moved_rank for r in work.move_rank(ranked, 3, 99)[0].collect()} == {4: 1, 1: 2, 3: 3}
    with pytest.raises(ValueError):
        work.move_rank(ranked, 2, 1)


def test_schedule_adds_hours_over_the_whole_list(spark):
    rows = [(1, 1, 1, False, "8", None, None), (2, 0, 1, False, "", "1,600", "100"), (3, 2, 1, False, None, "100-200", "10"), (4, 3, 1, False, "4", None, None)]
    tasks = spark.createDataFrame(rows, "task_id long, rank int, updated_at long, deleted boolean, estimated_hours string, data_amount string, hourly_capacity string")
    done = spark.createDataFrame([(4, True)], "task_id long, done boolean")
    got = [(r.task_id, r.hours, r.days, str(r.due)) for r in work.schedule(tasks, done, 1, "2024-02-02").collect()]
    assert got == [(1, 8.0, 1, "2024-02-02"), (2, 16.0, 3, "2024-02-06"), (3, 0.0, None, "None"), (4, 4.0, None, "None")]


def test_keyframes_stop_at_the_first_disabled(spark):
    keys = spark.createDataFrame([(1, 1, f, on, float(f), 0.0, f + 2.0, 2.0) for f, on in [(1, True), (3, True), (5, False), (7, True)]], "video_id long, track_id long, frame long, enabled boolean, x1 double, y1 double, x2 double, y2 double")
    found = boxes.expand_keyframes(keys).orderBy("frame").collect()
    assert [(r.frame, r.x1) for r in found] == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_voc_clips_and_marks(spark):
    images = spark.createDataFrame([("i", 10, 10), ("j", 10, 10)], "image string, width int, height int")
    found = spark.createDataFrame([("i", 0, "a<b", -2.0, 1.0, 4.5, 5.5), ("i", 1, "x", 12.0, 1.0, 14.0, 2.0)], "image string, order int, name string, x1 double, y1 double, x2 double, y2 double")
    xml = {r.image: r.xml for r in boxes.to_voc(found, images).collect()}
    assert "<name>a&lt;b</name><pose>Unspecified</pose><truncated>1</truncated><difficult>0</difficult><bndbox><xmin>0</xmin><ymin>1</ymin><xmax>4</xmax><ymax>6</ymax>" in xml["i"] and xml["i"].count("<object>") == 1
    assert "<object>" not in xml["j"]


def test_box_sets_are_matched_from_the_best_down(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 0, 0.9), (1, 1, 0, 1, 0.8), (1, 1, 1, 0, 0.7)], "video_id long, frame_id long, l int, r int, iou double")
    boxes_of = lambda n, f: spark.createDataFrame([(1, f)] * n, "video_id long, frame_id long")
    found = boxes.compare_box_sets(pairs, boxes_of(2, 1).union(boxes_of(1, 2)), boxes_of(2, 1)).orderBy("frame_id").collect()
    assert [(r.tp, r.extra, r.missed) for r in found] == [(1, 1, 1), (0, 0, 1)]
