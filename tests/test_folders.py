"""Folders and the work database as sources and sinks, and the model hook."""

import json
import os
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.operators import boxes, inference, sampling
from trackloom.sources import folders, labels, workdb


def test_files_of_nested_folders(spark, tmp_path):
    for name, text in {"a/x_1.txt": "1\n2", "a/deep/y_2.TXT": "", "b/z.txt": "ä", "b/z.xml": "no", "top.txt": "t", "_job/q.txt": "no", "b/.half.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path[len(str(tmp_path)) + 1 :]: (r.value, r.length) for r in folders.files(spark, str(tmp_path), ".txt").collect()}
    assert got == {"a/x_1.txt": ("1\n2", 3), "a/deep/y_2.TXT": ("", 0), "b/z.txt": ("ä", 2), "top.txt": ("t", 1)}
    # The driver deals the first folders, and names no file.
    dealt = folders.FolderReader({"path": str(tmp_path), "tasks": "2"}).partitions()
    assert sorted(n for p in dealt for n in p.names) == ["", "a", "b"] and len(dealt) == 2
    assert folders.files(spark, str(tmp_path / "b"), ".jpg").count() == 0


def test_written_labels_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1, 0, 8.0, 6.0, 24.0, 30.0, 0), ("v", 1, 2, 0.0, 0.0, 16.0, 12.0, 1), ("v", 3, 1, 16.0, 12.0, 32.0, 24.0, 0)], "video_id string, frame_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double, `order` int")
    videos = spark.createDataFrame([("v", 64, 48, 4, 1)], "video_id string, width int, height int, frame_count int, frame_offset int")
    out = sampling.to_yolo_frames(rows, videos)
    folders.write_files(out.select(F.concat_ws("/", "video_id", "file_name").alias("name"), "content"), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", "v"] and len(os.listdir(tmp_path / "v")) == 4
    frames, found, warnings = labels.read_yolo_labels(spark, str(tmp_path), videos)
    assert frames.count() == 4 and warnings.count() == 0
    assert sorted((r.frame_id, r.class_id, r.x1, r.y2) for r in found.collect()) == [(1, 0, 8.0, 30.0), (1, 2, 0.0, 12.0), (3, 1, 16.0, 24.0)]
    # Again over what is there: the same files.
    folders.write_files(out.select(F.concat_ws("/", "video_id", "file_name").alias("name"), "content"), str(tmp_path))
    assert len(os.listdir(tmp_path / "v")) == 4


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 200, 1, 4).select(F.concat(F.lit("f/"), "id").alias("name"), F.when(F.col("id") == 190, F.raise_error(F.lit("lost"))).otherwise("text").alias("content"))
    with pytest.raises(Exception, match="lost"):
        folders.write_files(rows, str(tmp_path / "out"))
    left = [f for _, _, names in os.walk(tmp_path / "out") for f in names]
    assert left == []
    with pytest.raises(Exception, match="no name below a folder"):
        folders.write_files(spark.createDataFrame([("../x", "y")], "name string, content string"), str(tmp_path / "out"))
    assert not (tmp_path / "x").exists()


def test_a_lost_task_leaves_no_half_file(tmp_path):
    """A task that dies within a file leaves its temporary one at most, which readers don't see; the next attempt writes the whole."""
    w = folders.FolderWriter({"path": str(tmp_path)}, False)

    class Dies:
        def encode(self):
            raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        w.write(iter([{"name": "a", "content": "whole"}, {"name": "b", "content": Dies()}]))
    assert (tmp_path / "a").read_text() == "whole" and not (tmp_path / "b").exists()
    done = w.write(iter([{"name": "a", "content": "whole"}, {"name": "b", "content": "too"}]))
    w.commit([done])
    assert sorted(os.listdir(tmp_path))[-3:] == ["_SUCCESS", "a", "b"] and (tmp_path / "b").read_text() == "too"


def test_work_database(spark, tmp_path):
    path = str(tmp_path / "work.db")
    with sqlite3.connect(path) as db:
        db.execute("create table users (username text primary key, password_hash text, role text, display_name text, phone text, is_active integer, created_at text, updated_at text, last_login_at text)")
        db.executemany("insert into users values (?, 'secret', ?, ?, '', ?, '2026-07-20T08:00:00+08:00', 'never', null)", [(f"u{k}", "admin" if k == 0 else "user", f"U {k}", k % 2) for k in range(50)])
        db.execute("create table parts (part_id integer primary key autoincrement, task_id text, part_index integer, name text, image_count integer, bbox_count integer, status text, work_seconds real, created_at text)")
        db.executemany("insert into parts (task_id, part_index, name, image_count, bbox_count, status, work_seconds, created_at) values (?, ?, 'p', 100, ?, ?, 1.5, '2026-07-20T08:00:00+08:00')", [(f"t{k % 7}", k, None if k % 3 else k, "pending" if k % 5 else "completed") for k in range(1000)])
        db.execute("create table reminder_config (id integer primary key, config text)")
    got = workdb.load_workdb(spark, path, rows=128)
    assert sorted(got) == ["parts", "reminder_config", "users"] and got["reminder_config"].count() == 0
    assert "password_hash" not in got["users"].columns and got["users"].where("is_active").count() == 25
    first = got["users"].where("username = 'u0'").first()
    assert first.role == "admin" and str(first.created_at) == "2026-07-20 00:00:00" and first.updated_at is None
    parts = got["parts"]
    assert parts.count() == 1000 and parts.rdd.getNumPartitions() == 8 and parts.agg(F.sum("work_seconds")).first()[0] == 1500
    assert parts.where("review_note is not null").count() == 0  # a column that this file hasn't
    assert parts.where("status = 'completed' and part_index >= 500 and bbox_count is not null").count() == sum(k % 5 == 0 and k % 3 == 0 for k in range(500, 1000))
    reader = workdb.WorkReader({"path": path, "table": "parts"})
    left = list(reader.pushFilters([workdb.EqualTo(("status",), "completed"), workdb.In(("task_id",), ("t1", "t2")), workdb.EqualTo(("a", "b"), 1)]))
    assert len(left) == 1 and len(list(reader.read(workdb.Rows(1, 1000)))) == sum(k % 5 == 0 and k % 7 in (1, 2) for k in range(1000))


def test_only_rows_that_fail_alone_have_errors(spark):
    def make():
        def model(f: pd.DataFrame) -> pd.DataFrame:
            if len(f) > 4:
                raise MemoryError("too many")
            if (f["id"] % 10 == 7).any():
                raise ValueError("bad row")
            return pd.DataFrame({"score": f["id"] * 2.0, "note": "n" + f["id"].astype(str)})

        return model

    rows = spark.range(0, 100, 1, 3).withColumn("a.b", F.lit("x")).withColumn("note", F.lit("old"))
    got = inference.run_model(rows, make, "score double, note string", 16).collect()
    assert [r.id for r in got] == list(range(100)) and got[0].asDict().keys() == {"id", "a.b", "score", "note", "error"}
    assert all((r.score, r.note, r.error) == ((None, None, "ValueError: bad row") if r.id % 10 == 7 else (r.id * 2.0, f"n{r.id}", None)) for r in got)
    assert inference.run_model(rows.limit(0), make, "score double, note string").count() == 0


def test_summaries_as_files(spark, tmp_path):
    runs = spark.createDataFrame([("b", 8, 2.0, 1.0, 4.5, 0.5, 0.75, 0.9, None), ("a", 8, 1.0, None, 4.0, 0.25, 0.5, None, None)], "run string, frames bigint, fps double, speed_up double, boxes_per_second double, p50 double, p95 double, precision double, recall double")
    folders.write_files(boxes.summary_files(runs.where("run = 'b'").withColumn("run", F.lit(1)), "1"), str(tmp_path))
    assert json.loads((tmp_path / "summary.json").read_text()) == {"baseline": "1", "cases": [{"run": 1, "frames": 8, "fps": 2.0, "speed_up": 1.0, "boxes_per_second": 4.5, "p50": 0.5, "p95": 0.75, "precision": 0.9, "recall": None}]}
    csv = spark.read.option("header", "true").csv(str(tmp_path / "summary.csv")).collect()
    assert len(csv) == 1 and csv[0].precision == "0.900000" and csv[0].recall is None
    md = {r.name: r.content for r in boxes.summary_files(runs, "a").collect()}["summary.md"].splitlines()
    assert md[-2:] == ["| a | 8 | 1.0000 | - | 4.000 | 0.250 | 0.500 | - | - |", "| b | 8 | 2.0000 | 1.00 | 4.500 | 0.500 | 0.750 | 0.900 | - |"]
