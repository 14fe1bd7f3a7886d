"""Readers and writers, by round trips in temporary folders."""

import json

import pytest

from pyspark.sql import functions as F

from trackloom.operators import sampling, tracks
from trackloom.sources import files, labels


def test_yolo_labels(spark, tmp_path):
    d = tmp_path / "v"
    d.mkdir()
    (d / "sample_1.txt").write_text("0 0.5 0.5 0.25 0.5 0.9\n\n1 0.5 0.5 0.1\n2 0.5 0.5 0 0\n")
    (d / "sample_2.txt").write_text("")
    (d / "sample_9.txt").write_text("0 0.5 0.5 0.25 0.5\n")
    (d / "readme.txt").write_text("x")
    videos = spark.createDataFrame([("v", 64, 48, 6)], "video_id string, width int, height int, frame_count int")
    frames, found, warnings = labels.read_yolo_labels(spark, str(tmp_path), videos)
    assert sorted(r.video_frame_idx for r in frames.collect()) == [0, 1]
    r = found.collect()
    assert len(r) == 1 and (r[0].x1, r[0].y1, r[0].x2, r[0].y2, r[0].score) == (24.0, 12.0, 40.0, 36.0, 0.9)
    assert warnings.count() == 3


def test_tracking_document_round_trip(spark, tmp_path):
    rows = [(0, 1, 7, f, f - 1, 1.5, 2.0, 11.0, 12.5) for f in (1, 2, 3)]
    t = spark.createDataFrame(rows, "video_id bigint, track_id bigint, class_id int, frame_id bigint, video_frame_idx bigint, x1 double, y1 double, x2 double, y2 double")
    videos = spark.createDataFrame([(0, 25.0, 64, 48, 6, 1)], "video_id bigint, fps double, width int, height int, frame_count int, frame_offset int")
    doc = labels.to_tracking_results(t, videos).first().document
    assert json.loads(doc)["metadata"]["num_tracks"] == 1
    (tmp_path / "a.json").write_text(doc)
    back = labels.read_tracking_results(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.video_frame_idx, r.x1, r.y2) for r in back] == [(1, 0, 2.0, 12.0), (2, 1, 2.0, 12.0), (3, 2, 2.0, 12.0)]


def test_plans(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"segments": [{"start_frame": 1, "end_frame": 5, "interval": 2, "label": "x"}]}))
    plans, segments = labels.read_sampling_plans(spark, str(tmp_path))
    assert tuple(plans.first())[1:] == (30, True, "frame") and segments.first().end_frame == 5


def test_answers(spark, tmp_path):
    answer = "<box><0><0><1000><1000></box><ref>Traffic\n Light</ref><box><125><250><375><750></box><box><1><2></box><box><640><150><890><450></box><ref> Bus</ref><box><10><20><30><40></box>"
    (tmp_path / "a.jsonl").write_text(json.dumps({"image": "i", "width": 2000, "height": 1000, "answer": answer}) + "\n" + json.dumps({"image": "j", "error": "memory"}) + "\nnot json\n")
    ok, failed = labels.read_raw_answers(spark, str(tmp_path))
    got = [(r.label, r.x1, r.y1, r.x2, r.y2) for r in labels.parse_answers(ok).orderBy("pos").collect()]
    assert got == [("", 0, 0, 2000, 1000), ("traffic light", 250, 250, 750, 750), ("traffic light", 1280, 150, 1780, 450), ("bus", 20, 20, 60, 40)]
    assert sorted(r.error for r in failed.collect()) == ["memory", "not JSON"]


def test_labels_of_answers(spark):
    answers = spark.createDataFrame([("i", 2000, 1000, "<ref>CAR</ref><box><100><200><300><400></box><box><5><5><5><9></box><ref>tree</ref><box><0><0><500><500></box>"), ("j", 10, 10, None), ("k", 10, 10, "nothing")], "image string, width int, height int, answer string")
    got = {r.image: (r.content, r.boxes) for r in labels.answers_to_labels(answers, F.create_map(F.lit("car"), F.lit(3)), default=8).collect()}
    assert got["i"] == ("3 0.200000 0.300000 0.200000 0.200000 1.000000\n8 0.250000 0.250000 0.500000 0.500000 1.000000", 2) and got["j"] == got["k"] == ("", 0)


def names(spark, *paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, length long")


def test_data_set_triplets(spark):
    whole = [f"/d/{k % 2}/{folder}/v_{k}.{suffix}" for k in range(5) for folder, suffix in (("images", "jpg"), ("labels", "txt"), ("annotations", "xml"))]
    odd = ["/d/0/images/x.png", "/d/0/labels/only.txt", "/d/1/images/V_0.JPG", "/d/1/labels/v_0.txt", "/d/1/annotations/v_0.xml", "/d/1/images/v_1.bmp", "/other/images/y.jpg", "/d/0/images/note.md"]
    samples, errors, extra = files.scan_samples(names(spark, *whole, *odd))
    assert sorted(r.stem for r in samples.collect()) == ["v_1", "v_2", "v_3", "v_4"]
    assert sorted((r.root, r.error) for r in errors.collect()) == [("/d/0", "no label and no annotation"), ("/d/0", "stem in two roots"), ("/d/1", "stem in two roots"), ("/d/1", "stem twice in a folder")]
    assert {r.root: (r.labels, r.annotations) for r in extra.collect()} == {"/d/0": (1, 0)}


def test_work_folders(spark):
    f = names(spark, "/r/split_001/images/a.jpg", "/r/split_001/images/deep/b.PNG", "/r/split_001/images/labels/c.txt", "/r/camera_a/split_002/labels/c.txt", "/r/camera_a/split_002/annotations/c.xml", "/r/x/y/z/images/d.jpg", "/r/top.txt")
    got = {r.relative_path: (r.depth, r.markers, r.image_count) for r in files.discover_folders(f, "/r/", ["images", "labels", "annotations"], 2).collect()}
    assert got == {"split_001": (1, ["images"], 2), "camera_a/split_002": (2, ["annotations", "labels"], None)}
    assert {r.relative_path for r in files.discover_folders(f, "/r", ["Images", "labels", "annotations"], 4, 2).collect()} == {"camera_a/split_002"}
    assert [r.relative_path for r in files.discover_folders(names(spark, "/r/images/a.jpg"), "/r", ["images"]).collect()] == ["."]


def test_media(spark):
    f = names(spark, "/r/a.jpg", "/r/A.png", "/r/s/b.jpg", "/r/v.mp4", "/q/a.jpg")
    media, twice = files.list_media(f, "/r")
    assert sorted(r.path for r in media.collect()) == ["/r/A.png", "/r/a.jpg", "/r/s/b.jpg"] and twice.count() == 2
    assert files.list_media(f, "/r", "videos")[0].count() == 1 and files.list_media(f, "/r", recursive=False)[0].count() == 2
    got = {r.folder: (r.images, r.conflict) for r in files.list_image_folders(f, "/out", names(spark, "/out/s")).collect()}
    assert got == {"/r": (2, False), "/r/s": (1, True), "/q": (1, False)}


def test_manifests(spark):
    lines = ["split_001", "camera_a/split_002\t7", "Own name\tcamera_b\\split_003", "a\tb\t5", "", "x\ty\tz", "1\t2\t3\t4", "SPLIT_001/", "/abs/one/\t3", ".", "n\t\t3"]
    parts, errors = files.parse_manifest(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"), "/data/")
    assert {r.line_no: (r.name, r.work_path, r.image_count) for r in parts.collect()} == {
        0: ("split_001", "/data/split_001", None), 1: ("camera_a / split_002", "/data/camera_a/split_002", 7), 2: ("Own name", "/data/camera_b/split_003", None),
        3: ("a", "/data/b", 5), 8: ("one", "/abs/one/", 3), 9: (files.ROOT_NAME, "/data", None),
    }
    assert {r.line_no: r.error for r in errors.collect()} == {5: "count", 6: "columns", 7: "twice", 10: "path"}
    assert {r.error for r in files.parse_manifest(spark.createDataFrame([(0, "rel")], "line_no int, value string"), " ")[1].collect()} == {"root"}


def test_task_tables(spark):
    table = lambda *rows: files.parse_task_table(spark.createDataFrame(list(enumerate("\t".join(r) for r in rows)), "line_no int, value string")).collect()
    got = table(["数据量", "无关", "项目", "申请人", "希望完成时间"], ["1,000", "x", " P ", "ann", "soon"], ["5", "", "", "", ""], ["", "", ""])
    assert [(r.project, r.data_amount, r.applicant, r.desired_completion_date, r.data_path) for r in got] == [("P", "1,000", "ann", "soon", "")]
    assert [(r.application_date, r.project, r.annotation_content) for r in table(["2024-01-01", "ann", "", "boxes"], ["项目", "a"])] == [("2024-01-01", "", "boxes")]


def test_dimensions_from_names(spark):
    v = spark.createDataFrame([("d/a_1920_1080_25_x.mp4",), ("b_12_1920_1080_30.mp4",), ("c_1920_1080.mp4",), ("e_1920_1080_500.mp4",)], "video string")
    got = {r.video[0]: (r.width, r.height, r.fps) for r in files.video_dimensions(v, spark.createDataFrame([("c_1920_1080.mp4", 640, 480, 10)], "video string, width int, height int, fps int")).collect()}
    assert got == {"d": (1920, 1080, 25), "b": (1920, 1080, 30), "c": (640, 480, 10), "e": (None, None, None)}


TRACK = "video_id bigint, track_id bigint, class_id int, frame_id bigint, video_frame_idx bigint, x1 double, y1 double, x2 double, y2 double"


def test_keyframe_documents(spark):
    t = spark.createDataFrame([(0, 1, 7, f, f - 1, 16.0, 12.0, 32.0, 36.0) for f in (1, 2, 4)] + [(0, 2, 1, 6, 5, 0.0, 0.0, 64.0, 48.0)], TRACK)
    videos = spark.createDataFrame([(0, "v/a.mp4", 64, 48, 25.0, 6)], "video_id bigint, video_path string, width int, height int, fps double, frame_count int")
    docs = files.to_label_studio(t, videos, F.create_map(F.lit("7"), F.lit("car"))).select(F.col("video_id").cast("string").alias("document"), F.col("document").alias("value"))
    rows = files.label_studio_keyframes(docs).orderBy("item", "frame").collect()
    assert [(r.video, r.item, r.label, r.frame, r.enabled) for r in rows] == [("v/a.mp4", 0, "car", 1, True), ("v/a.mp4", 0, "car", 2, True), ("v/a.mp4", 0, "car", 4, True), ("v/a.mp4", 0, "car", 5, False), ("v/a.mp4", 1, "class_1", 6, True)]
    assert (rows[0].x, rows[0].y, rows[0].width, rows[0].height) == (25.0, 25.0, 25.0, 50.0)
    assert files.frame_counts(files.label_studio_keyframes(docs)).first().frame_count == 6
    other = spark.createDataFrame([("a", json.dumps({"video": "w", "box": [{"labels": ["x"], "sequence": [{"frame": 3, "x": 1.0}]}]})), ("b", json.dumps([{"data": {"video": files.PREFIX + "u", "box": [{"sequence": [{"frame": 9, "enabled": False}]}]}}]))], "document string, value string")
    assert {(r.document, r.video, r.label, r.frame, r.enabled) for r in files.label_studio_keyframes(other).collect()} == {("a", "w", "x", 3, True), ("b", "u", None, 9, False)}
    assert {r.document: r.frame_count for r in files.frame_counts(files.label_studio_keyframes(other)).collect()} == {"a": 3, "b": 9}


def test_flat_rows_and_projects(spark, tmp_path):
    t = spark.createDataFrame([(0, 1, 7, 2, 1, -3.0, 2.5, 11.0, 12.5), (0, 1, 7, 1, 0, 90.0, 1.0, 95.0, 2.0)], TRACK)
    videos = spark.createDataFrame([(0, 64, 48)], "video_id bigint, width int, height int")
    files.write_tracks_csv(t, videos, str(tmp_path / "csv"))
    got = spark.read.option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "csv")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.x1, r.y1, r.x2, r.y2) for r in got] == [(1, 0, 0, 0, 0), (2, 0, 2, 11, 12)]
    back = files.read_projects(files.project_documents(t)).orderBy("frame_id").collect()
    assert [(r.track_id, r.frame_id, r.x1) for r in back] == [(1, 1, 90.0), (1, 2, -3.0)]


def test_plan_and_anomaly_documents(spark, tmp_path):
    plans = spark.createDataFrame([("p", 10, False, "im"), ("q", 5, True, "frame")], "plan_id string, default_interval int, include_empty_frames boolean, file_prefix string")
    segments = spark.createDataFrame([("p", 7, 9, 1, "b"), ("p", 1, 5, 2, "a")], "plan_id string, start_frame int, end_frame int, interval int, label string")
    for r in files.plan_documents(plans, segments).collect():
        (tmp_path / f"{r.plan_id}.json").write_text(r.document)
    p, s = labels.read_sampling_plans(spark, str(tmp_path))
    assert sorted(tuple(r) for r in p.collect()) == [("p.json", 10, False, "im"), ("q.json", 5, True, "frame")] and [r.label for r in s.orderBy("start_frame").collect()] == ["a", "b"]
    frames = spark.createDataFrame([(0, 1, 0, f, f, 0.0, 0.0, 10.0, 100.0 if f == 4 else 10.0) for f in range(9)], TRACK)
    doc = json.loads(files.anomaly_documents(*tracks.area_anomalies(frames), {"high": 3.0}).first().document)
    assert doc["parameters"] == {"high": 3.0} and [s["start_frame"] for s in doc["tracks"][0]["segments"]] == [4] and doc["tracks"][0]["n_valid"] == 9


def test_prelabels(spark):
    v = names(spark, "/v/A.mp4", "/v/b.mp4", "/v/c.mp4", "/v/d.mp4", "/w/D.mp4")
    f = names(spark, "/p/a/1.txt", "/p/a/1.xml", "/p/b/1.xml", "/p/d/1.txt")
    assert {r.video: (r.status, r.reason) for r in files.prelabel_plan(v, f).collect()} == {
        "/v/A.mp4": ("ready", None), "/v/b.mp4": ("skipped", "no labels"), "/v/c.mp4": ("skipped", "no folder"), "/v/d.mp4": ("error", "stem twice"), "/w/D.mp4": ("error", "stem twice"),
    }


def test_sampled_exports(spark):
    t = spark.createDataFrame([(0, 2, 2, 1, 1, 16.0, 12.0, 32.0, 24.0), (0, 1, 0, 1, 1, 0.0, 0.0, 64.0, 48.0)], TRACK)
    videos = spark.createDataFrame([(0, 64, 48, 300, "v")], "video_id bigint, width int, height int, frame_count int, stem string")
    at = spark.createDataFrame([(0, 1), (0, 2)], "video_id bigint, frame int")
    got = {r.frame: (r.stem, r.content) for r in sampling.export_sampled(t, at, videos).collect()}
    assert got == {1: ("frame_000001", "0 0.500000 0.500000 1.000000 1.000000\n2 0.375000 0.375000 0.250000 0.250000"), 2: ("frame_000002", "")}
    assert sampling.export_sampled(t, at, videos, False).count() == 1
    assert [r.name for r in sampling.select_frames(videos, 140).orderBy("frame").collect()] == ["v_1", "v_141", "v_281"]
    b = sampling.benchmark_frames(videos, 280, 10, 8).orderBy("position").collect()
    assert [(r.frame, r.warm_up) for r in b] == [(280, True), (290, False)] and sampling.benchmark_frames(videos, 299, 10, 8).count() == 0
    moving = spark.createDataFrame([(0, 1, 0, f, f, x, 0.0, x + 9, 9.0) for f in range(300) for x in [0.0 if f < 200 else 5.0 * (f - 200)]], TRACK)
    frames = [r.frame for r in sampling.tiered_sample(moving, videos).collect()]
    assert sum(f >= 200 for f in frames) / 100 > 1.5 * sum(f < 180 for f in frames) / 180 > 0


def test_prelabels_to_be_organized(spark):
    v = spark.createDataFrame([(f"/v/{n}.mp4", 10) for n in ("A", "b", "c", "d", "e", "f", "g", "h")] + [("/w/H.mp4", 10)], "path string, length bigint")
    rows = [("/p/a/labels/1.txt", 1, "x"), ("/p/a/A.mp4", 10, "m"), ("/p/b/B/1.txt", 1, "x"), ("/p/c/labels/1.txt", 1, "x"), ("/p/c/c/1.txt", 1, "x"), ("/p/c/c/2.txt", 1, "y")]
    rows += [("/p/d/labels/1.txt", 1, "x"), ("/p/d/d.mp4", 11, "m")] + [(f"/p/e/{k}/{n}.txt", 1, f"{k}{n}") for k in ("labels", "e") for n in range(7)] + [("/p/f/other/1.txt", 1, "x"), ("/p/f/1.txt", 1, "x"), ("/p/h/labels/1.txt", 1, "x")]
    rows += [("/q/G/labels/1.txt", 1, "x"), ("/p/g/labels/1.txt", 1, "x")]
    got = {r.video: (r.status, r.reason, r.action, r.conflicts) for r in files.organize_prelabels(v, spark.createDataFrame(rows, "path string, length bigint, digest string")).collect()}
    assert got == {
        "/v/A.mp4": ("ready", None, "rename", None), "/v/b.mp4": ("ready", None, "done", None), "/v/c.mp4": ("ready", None, "merge", None), "/v/d.mp4": ("error", "video of another size", None, None),
        "/v/e.mp4": ("error", "conflicts", None, [f"{n}.txt" for n in range(5)]), "/v/f.mp4": ("error", "no labels", None, None), "/v/g.mp4": ("error", "folder twice", None, None),
        "/v/h.mp4": ("error", "stem twice", None, None), "/w/H.mp4": ("error", "stem twice", None, None),
    }


def test_the_first_files(spark):
    f = names(spark, "/r/b.jpg", "/r/A.jpg", "/r/c.jpg")
    assert [r.path for r in files.first_media(f, 2).collect()] == ["/r/A.jpg", "/r/b.jpg"] and files.first_media(f, 0).count() == 3
    with pytest.raises(ValueError):
        files.first_media(f.limit(0), 3)


def test_only_paths_are_shuffled_and_a_root_is_dealt_to_tasks(spark):
    rows = [(f"/d/{r}/{k}/v{n}{s}", 1) for r in "ab" for n in range(3) for k, s in (("images", ".jpg"), ("labels", ".txt"), ("annotations", ".xml"))]
    given = spark.createDataFrame([*rows, ("/e/images/v0.jpg", 1)], "path string, length long")  # e isn't whole, so it's no root
    samples, errors, extra = files.scan_samples(given.where("not (path like '/d/b/%')"))
    assert {tuple(r) for r in samples.select("stem", "root").collect()} == {(f"v{n}", "/d/a") for n in range(3)}
    assert errors.isEmpty() and extra.isEmpty()
    assert files.scan_samples(given)[1].where("error = 'stem in two roots'").count() == 6

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    found = list(nodes(samples._jdf.queryExecution().optimizedPlan()))
    assert [n.output().size() for n in found if n.nodeName() == "RepartitionByExpression"] == [1]
    assert any(n.nodeName() == "Join" and "share" in n.toString().split("\n")[0] for n in found)
