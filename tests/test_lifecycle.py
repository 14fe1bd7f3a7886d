"""The life cycle's fold: a script with known answers, invariants over many actions, and the stream against the batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.operators import lifecycle
from trackloom.plans.fixtures import fixture

ACTION = "action_id bigint, task_id bigint, part_id bigint, actor string, action string, value bigint, ts timestamp"
PARTS = "part_id bigint, task_id bigint, part_index bigint, image_count bigint"
T0 = datetime(2026, 7, 14, 8)


@pytest.fixture(scope="module")
def tables(spark):
    tasks = spark.createDataFrame([(1, "pub", "man", None)], "task_id bigint, publisher string, manager string, applicant string")
    parts = spark.createDataFrame([(11, 1, 2, 100), (10, 1, 1, 100), (12, 1, 3, 0)], PARTS)
    return tasks, parts


def log(spark, *steps):
    return spark.createDataFrame([(k, 1, p, who, what, v, T0 + timedelta(minutes=m)) for k, (m, who, what, p, v) in enumerate(steps)], ACTION)


def test_a_part_from_claim_to_completion(spark, tables):
    steps = [
        (0, "ann", "claim", None, None), (1, "ann", "claim", None, None), (10, "bo", "claim", None, None), (20, "ann", "progress", 10, 60), (21, "ann", "progress", 10, 60), (22, "ann", "progress", 10, 50),
        (23, "ann", "progress", 10, 101), (30, "ann", "pause", 10, None), (40, "bo", "resume", 10, None), (50, "ann", "resume", 10, None), (60, "ann", "submit", 10, None), (70, "ann", "approve", 10, None),
        (71, "pub", "reject", 10, None), (80, "ann", "rework", 10, None), (90, "ann", "submit", 10, None), (95, "man", "approve", 10, None), (96, "bo", "return", 11, None), (97, "bo", "fly", 11, None), (98, "bo", "pause", 99, None),
    ]
    out = {k: v.collect() for k, v in lifecycle.replay(log(spark, *steps), *tables).items()}
    assert {r.part_id: (r.status, r.annotator, r.work_seconds, r.progress_count) for r in out["parts"]} == {10: ("completed", "ann", 3000.0, 100), 11: ("pending", None, 0.0, 0), 12: ("pending", None, 0.0, 0)}
    assert [(r.action_id, r.cumulative, r.credited, r.is_final) for r in sorted(out["events"], key=lambda r: r.action_id)] == [(3, 60, 60, False), (10, 100, 40, True), (14, 100, 0, True)]
    assert {r.action_id for r in out["rejects"]} == {1, 5, 6, 8, 11, 17, 18}
    assert sorted((r.part_id, r.annotator, (r.ended_at - r.started_at).seconds) for r in out["sessions"]) == [(10, "ann", 600), (10, "ann", 600), (10, "ann", 1800), (11, "bo", 5160)]
    assert sorted(r.kind for r in out["comments"]) == ["pause", "resume", "return", "review_approve", "review_rework"]


def test_actions_on_unknown_tasks_and_open_sessions(spark, tables):
    actions = log(spark, (0, "ann", "claim", None, None)).union(spark.createDataFrame([(7, 2, None, "x", "claim", None, T0)], ACTION))
    out = lifecycle.replay(actions, *tables)
    assert [(r.task_id, r.reason) for r in out["rejects"].collect()] == [(2, "unknown task")]
    assert [r.ended_at for r in out["sessions"].collect()] == [None]
    assert lifecycle.replay(actions.limit(0), *tables)["parts"].count() == 3


def test_invariants_and_the_stream(spark, tmp_path):
    a, t, p = (fixture(spark, "/root/testdata/sf0.001", f"fx_{n}") for n in ("actions", "action_tasks", "action_parts"))
    out = {k: v.toPandas() for k, v in lifecycle.replay(a, t, p).items()}
    assert len(out["rejects"]) and len(out["events"]) and set(out["parts"]["status"]) > {"pending", "completed"}
    assert (out["events"].groupby("part_id")["credited"].sum() <= 100).all() and not out["sessions"].query("ended_at == ended_at and ended_at < started_at").size
    busy = out["parts"][out["parts"]["status"] == "in_progress"]
    assert not busy.duplicated(["task_id", "annotator"]).any() and out["sessions"]["ended_at"].isna().sum() == len(busy)

    own = p.groupBy("task_id").agg(F.collect_list(F.struct("part_id", "part_index", "image_count")).alias("task_parts")).join(t, "task_id").select("task_id", "task_parts", F.array("publisher", "manager").alias("reviewers"))
    joined = a.withColumn("ts", F.col("ts").cast("timestamp")).join(own, "task_id")
    joined.repartition(1).sortWithinPartitions("ts", "action_id").write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(joined.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle.replay_stream(stream).writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("life").toPandas()
    assert sorted(got[got["kind"] == "event"]["action_id"]) == sorted(out["events"]["action_id"]) and sorted(got[got["kind"] == "reject"]["action_id"]) == sorted(out["rejects"]["action_id"])


def test_edit_rules(spark):
    parts = spark.createDataFrame([(1, 1, "ann", "in_progress", 100), (2, 1, "ann", "completed", 100)], "part_id bigint, task_id bigint, annotator string, status string, image_count bigint")
    tasks = spark.createDataFrame([(1, "pub", "app")], "task_id bigint, publisher string, applicant string")
    users = spark.createDataFrame([("adm", "admin", True), ("old", "admin", False)], "username string, role string, is_active boolean")
    credited = spark.createDataFrame([(1, 60)], "part_id bigint, credited bigint")
    rows = [(1, "pub", "n ", None, 60, None, None, None), (1, "pub", None, None, 59, None, None, None), (1, "ann", "x", None, None, None, None, None), (1, "ann", None, None, None, -5, 7, None), (2, "ann", None, None, None, None, 7, None), (1, "adm", None, None, None, None, None, 10.0), (1, "old", None, None, None, None, None, 10.0), (1, "adm", None, None, None, None, None, -1.0), (1, "app", None, None, None, 5, None, None), (9, "pub", "x", None, None, None, None, None)]
    edits = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edit_id bigint, part_id bigint, actor string, name string, work_path string, image_count bigint, progress_count bigint, bbox_count bigint, work_seconds double")
    found = lifecycle.validate_edits(edits, parts, tasks, users, credited)
    assert [r.reason for r in found.orderBy("edit_id").collect()] == [None, "image_count", "permission", None, "permission", None, "permission", "work_seconds", "permission", "unknown part"]
    after = {r.part_id: (r.image_count, r.progress_count) for r in lifecycle.apply_edits(parts.withColumn("progress_count", F.lit(1).cast("bigint")), found).collect()}
    assert after == {1: (60, 0), 2: (100, 1)}


def test_replay_from_a_state_equals_the_whole_at_any_cut(spark):
    a, t, p = (fixture(spark, "/root/testdata/sf0.001", f"fx_{n}") for n in ("actions", "action_tasks", "action_parts"))
    rows = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    whole = lifecycle.replay(a, t, p)
    moments = [r.ts for r in a.orderBy("ts", "action_id").select("ts").collect()]
    for cut in (moments[0], moments[len(moments) // 3], moments[-1]):
        first = lifecycle.replay(a.where(F.col("ts") < cut), t, p)
        second = lifecycle.replay(a.where(F.col("ts") >= cut), t, first["state"])
        assert rows(second["parts"], "part_id", "status", "annotator", "work_seconds", "progress_count") == rows(whole["parts"], "part_id", "status", "annotator", "work_seconds", "progress_count")
        for kind, cols in (("events", ("action_id", "part_id", "cumulative", "credited", "is_final")), ("rejects", ("action_id", "reason")), ("comments", ("action_id", "kind"))):
            assert rows(first[kind].union(second[kind]), *cols) == rows(whole[kind], *cols)
        both = first["sessions"].where("ended_at is not null").union(second["sessions"])
        assert rows(both, "part_id", "annotator", "started_at", "ended_at") == rows(whole["sessions"], "part_id", "annotator", "started_at", "ended_at")


def test_a_snapshot_is_written_once_a_date_and_not_before_its_hour(spark, tmp_path):
    tasks = spark.createDataFrame([(1, "in_progress", False), (2, "completed", False), (3, "ready", True)], "task_id bigint, status string, deleted boolean")
    more = tasks.union(spark.createDataFrame([(4, "ready", False)], tasks.schema))
    hours = spark.createDataFrame([(1, 2.0)], "task_id bigint, hours double")
    path = str(tmp_path / "daily")
    assert not lifecycle.write_snapshot(tasks, hours, "2026-07-20T17:59:00+08:00", path)
    assert lifecycle.write_snapshot(tasks, hours, "2026-07-20T10:00:00Z", path)
    assert not lifecycle.write_snapshot(more, hours, "2026-07-20T23:00:00+08:00", path)
    assert lifecycle.write_snapshot(more, hours, "2026-07-21T18:00:00+08:00", path)
    got = spark.read.parquet(path).groupBy("report_date").agg(F.sort_array(F.collect_list("task_id")).alias("t")).collect()
    assert {str(r.report_date): r.t for r in got} == {"2026-07-20": [1], "2026-07-21": [1, 4]}


def test_paired_seconds_round_as_in_sql(spark):
    # differences of half a tenth were exact here and differences of two numbers of seconds in SQL.
    import duckdb

    start = "timestamp '2024-01-01 00:00:00' + to_microseconds(cast(i * 7919000003 % 2592000000000 as bigint))"
    pairs = f"select i as part_id, {start} as a, {start} + to_microseconds(cast(50000 + i % 977 * 100000 as bigint)) as b from range(3000) r(i)"
    want = dict(duckdb.sql(f"select part_id, round(epoch(b)-epoch(a),1) from ({pairs})").fetchall())
    rows = [(i, i * 2 + k, "u", ("resume", "pause")[k], t) for i, a, b in duckdb.sql(pairs).fetchall() for k, t in enumerate((a, b))]
    paired = lifecycle.paired_sessions(spark.createDataFrame(rows, "part_id bigint, action_id bigint, actor string, action string, ts timestamp_ntz"), ["resume"], ["pause"])
    assert {r.part_id: r.s for r in paired.select("part_id", F.round("seconds", 1).alias("s")).collect()} == want


def test_replay_reads_a_task_in_batches(spark, monkeypatch):
    # F8: a task's whole log lay in one pandas frame, and so did all that it made.
    plans, store = [], lifecycle.stored
    monkeypatch.setattr(lifecycle, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    tasks = spark.createDataFrame([(1, "p", "m"), (2, "p", "m")], "task_id bigint, publisher string, manager string")
    parts = spark.createDataFrame([(t * 10 + k, t, k, 5) for t in (1, 2) for k in range(4)], "part_id bigint, task_id bigint, part_index int, image_count bigint")
    kinds = ["claim", "pause", "resume", "submit", "approve"]
    rows = [(k, (1, 3, None)[k % 3], 10 + k // 15 % 4, "p" if k // 3 % 5 == 4 else "u", kinds[k // 3 % 5], None, datetime(2026, 7, 1) + timedelta(minutes=k)) for k in range(60)]
    actions = spark.createDataFrame(rows[::-1], "action_id bigint, task_id bigint, part_id bigint, actor string, action string, value bigint, ts timestamp")
    found = []
    for n in (10000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            found.append({k: sorted(v.collect(), key=str) for k, v in lifecycle.replay(actions, tasks, parts).items()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and not [p for p in plans if "CoGroup" in p]
    assert {r.task_id for r in found[0]["rejects"]} == {3, None} and len(found[0]["rejects"]) == 40
    assert sorted((r.part_id, r.status) for r in found[0]["parts"]) == [(10 + k, "completed") for k in range(4)] + [(20 + k, "pending") for k in range(4)]
