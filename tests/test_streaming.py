"""Streams end with the batch operators' answers."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackloom.operators import tracking, work
from trackloom.plans.catalog import all_frames
from trackloom.plans.fixtures import fixture
from trackloom.streaming import ledger, tracks
from trackloom.streaming.keyed import with_state

SF = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def files(spark, rows, tmp_path, order, per_file):
    rows.repartition(1).sortWithinPartitions(*order).write.option("maxRecordsPerFile", per_file).parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_online_tracker_equals_the_forward_pass(spark, tmp_path):
    d = fixture(spark, SF, "fx_detections").where("video_id < 3")
    every = all_frames(fixture(spark, SF, "fx_videos").where("video_id < 3"))
    rows = d.select("video_id", F.col("frame_id").cast("bigint").alias("frame_id"), "det_idx", "class_id", "score", *tracking.BOX).unionByName(every, allowMissingColumns=True)
    # Three files of whole frames.
    for k in range(3):
        rows.where(f"frame_id between {17 * k + 1} and {17 * k + 17}").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.video_id, r.frame_id, r.det_idx): r.number for r in run(spark, tracks.online_tracker(stream), tmp_path, "tracked").where("not late").collect()}
    want = {(r.video_id, r.frame_id, r.det_idx): r.number for r in tracking.run_tracker(d, frames=every).where("direction = 'forward'").collect()}
    assert got == want and len(got) > 500


def test_weeks_days_and_unique_reminders(spark, tmp_path):
    t = datetime(2026, 7, 20, 15, 59, 59)
    rows = spark.createDataFrame([(1, "a", t, 5, False), (2, "a", t + timedelta(seconds=1), 7, False), (3, "b", t + timedelta(seconds=2), 1, True), (9, "z", t + timedelta(days=30), 0, False)], "event_id long, annotator string, submitted_at timestamp, cumulative long, rejected boolean")
    stream = files(spark, rows, tmp_path, ["event_id"], 3)
    weeks = run(spark, ledger.weekly_totals(stream), tmp_path, "weeks").collect()
    assert {(str(r.week_start), r.events, r.cumulative) for r in weeks} == {("2026-07-13 16:00:00", 1, 5), ("2026-07-20 16:00:00", 2, 8)}
    days = run(spark, ledger.daily_credit(stream.withColumn("credited", F.col("cumulative"))), tmp_path, "days").collect()
    assert {(str(r.day_start), r.annotator, r.credited) for r in days} == {("2026-07-19 16:00:00", "a", 5), ("2026-07-20 16:00:00", "a", 7)}


def test_reminders_once_and_notifications(spark, tmp_path):
    t = datetime(2026, 7, 20)
    rows = spark.createDataFrame([(1, t, "a", "b"), (1, t + timedelta(minutes=5), "a", "b"), (2, t, "c", "c")], "event_id long, created_at timestamp, publisher string, manager string")
    stream = files(spark, rows, tmp_path, ["event_id"], 2)
    assert sorted(r.event_id for r in run(spark, ledger.unique_reminders(stream), tmp_path, "once").collect()) == [1, 2]
    users = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "username string, is_active boolean")
    sent = run(spark, ledger.notifications(stream, users), tmp_path, "sent").collect()
    assert sorted((r.event_id, r.username) for r in sent) == [(1, "a"), (1, "a"), (2, "c")]


def test_sessions_close_by_stop_and_by_timeout(spark, tmp_path):
    t = datetime(2026, 7, 20)
    at = lambda m: t + timedelta(minutes=m)
    rows = spark.createDataFrame([(1, 1, "a", "claim", at(0)), (2, 1, "a", "pause", at(30)), (3, 2, "b", "claim", at(0)), (4, 3, "c", "claim", at(10)), (5, 3, "d", "claim", at(20)), (6, 3, "d", "pause", at(40)), (7, 9, "z", "claim", at(6000)), (8, 9, "z", "pause", at(6001))], "action_id long, part_id long, actor string, action string, ts timestamp")
    stream = files(spark, rows, tmp_path, ["action_id"], 6)
    got = run(spark, ledger.online_sessions(stream, ["claim"], ["pause"]), tmp_path, "sessions").collect()
    assert {(r.part_id, r.actor, r.ended_at, r.timed_out) for r in got if r.part_id < 9} == {(1, "a", at(30), False), (2, "b", None, True), (3, "c", None, False), (3, "d", at(40), False)}


def test_labels_and_answers_as_they_arrive(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "v_1.txt").write_text("0 0.5 0.5 0.1 0.1\n\n1 0.2 0.2 0.1 0.1\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"image": "i", "answer": "<box>"}\n')
    (tmp_path / "l" / "v_2.txt").write_text("")
    got = run(spark, tracks.label_stream(spark, str(tmp_path / "l"), settle=0), tmp_path, "lines").collect()
    assert sorted((r.file[-7:], r.line_no) for r in got) == [("v_1.txt", 0), ("v_1.txt", 2), ("v_2.txt", None)]
    assert [r.image for r in run(spark, tracks.answer_stream(spark, str(tmp_path / "a")), tmp_path, "answers").collect()] == ["i"]


def test_online_credit(spark, tmp_path):
    kinds = "event_id bigint, part_id bigint, annotator string, submitted_at timestamp, cumulative bigint, is_final boolean"
    batch = fixture(spark, "/root/testdata/sf0.001", "fx_submissions").select("event_id", F.col("part_id").cast("bigint").alias("part_id"), "annotator", F.col("submitted_at").cast("timestamp").alias("submitted_at"), F.col("cumulative").cast("bigint").alias("cumulative"), "is_final")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    q = ledger.online_credit(stream).writeStream.format("memory").queryName("credit").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.credited for r in spark.table("credit").where("not rejected").collect()}
    assert got == {r.event_id: r.credited for r in work.credit_ledger(batch)[0].collect()}


def test_tracks_go_on_after_a_restart_and_late_frames_are_told(spark, tmp_path):
    """The state is read by its columns: another class, with other settings, goes on with the tracks that a stopped stream left."""
    kinds = "video_id bigint, frame_id bigint, det_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double"

    def batch(name, frames):
        spark.createDataFrame([(1, f, 0, 0, 0.9, 10.0 + f, 10.0, 40.0 + f, 40.0) for f in frames], kinds).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def go(processor):
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = with_state(stream, "video_id", processor, tracks.ONLINE)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(((r.frame_id, r.number, r.late, r.x1) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)

    class Renamed(tracks.TrackVideo):
        pass

    config = tracking.configured("sort", None)
    batch("a", range(1, 6))
    assert [r[:3] for r in go(tracks.TrackVideo("sort", config, None))] == [(f, 1, False) for f in range(1, 6)]
    live = spark.read.format("statestore").option("stateVarName", "live").load(str(tmp_path / "state")).select("list_element.*").collect()
    assert len(live) == 1 and live[0].number == 1 and live[0].seen == 5 and live[0].last_0 == 15.0
    batch("b", [3, 6, 7])
    got = go(Renamed("sort", config | {"max_missed": 3}, None))
    assert [r[:3] for r in got if not r[2]] == [(f, 1, False) for f in range(1, 8)] and [r for r in got if r[2]] == [(3, None, True, 13.0)]
