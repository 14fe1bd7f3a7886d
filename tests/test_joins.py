"""Grid and interval joins, and choices and components in rounds, against plain Python."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import boxes, graphs, joins

DET = "video_id bigint, frame_id bigint, det_idx int, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


@pytest.mark.parametrize("least", [0.5, 0.3, 0.05, 0.0])
def test_grid_join_of_all_sizes(spark, least):
    r = np.random.RandomState(3)
    side = lambda n: [(1, int(f), k, float(x), float(y), float(x + w), float(y + h)) for k, (f, x, y, w, h) in enumerate(zip(r.randint(0, 2, n), r.uniform(-60, 60, n), r.uniform(-60, 60, n), 2.0 ** r.uniform(-4, 7, n), 2.0 ** r.uniform(-4, 7, n), strict=True))]
    a, b = side(150) + [(1, 0, 900, 5.0, 5.0, 5.0, 9.0), (1, 0, 901, 8.0, 8.0, 16.0, 16.0)], side(150) + [(1, 0, 901, 8.0, 8.0, 16.0, 16.0), (1, 0, 902, 9.0, 9.0, 1.0, 1.0)]
    want = {(x[1], x[2], y[2]): overlap(x[3:], y[3:]) for x in a for y in b if x[1] == y[1] and (o := overlap(x[3:], y[3:])) > 0 and o >= least}
    for crowd in (0, 10_000):
        got = joins.iou_join(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET), least, crowd).collect()
        assert len(got) == len(want) and {(g.frame_id, g.l, g.r) for g in got} == want.keys()
        assert all(abs(g.iou - want[g.frame_id, g.l, g.r]) < 1e-12 for g in got)


def test_pairs_looked_at_follow_the_near_ones(spark):
    """A frame of 20,000 boxes, a few of which are near each: four hundred million pairs, of which some ten thousands are looked at."""
    r = np.random.RandomState(4)
    rows = [(1, 1, k, float(x), float(y), float(x) + 20, float(y) + 30) for k, (x, y) in enumerate(r.uniform(0, 5000, (20_000, 2)))]
    d = spark.createDataFrame(rows, DET)
    looked = joins.near_boxes(d, d, 0.5).count()
    found = joins.iou_join(d, d, 0.5).count()
    assert 20_000 <= found <= looked < 200_000


def test_windows_and_sessions(spark):
    t = datetime(2024, 1, 1)
    r = np.random.RandomState(5)
    sessions = [(k, t + timedelta(minutes=int(m)), None if k % 9 == 0 else t + timedelta(minutes=int(m + n))) for k, (m, n) in enumerate(zip(r.randint(0, 14_000, 120), r.randint(-5, 3000, 120), strict=True))] + [(500, None, None)]
    windows = [("day", t + timedelta(days=k), t + timedelta(days=k + 1)) for k in range(9)] + [("week", t, t + timedelta(days=7)), ("hour", t + timedelta(hours=5), t + timedelta(hours=6)), ("none", t, t)]
    now = t + timedelta(days=8)
    want = {}
    for i, a, b in sessions:
        for n, c, d in windows:
            if a is not None and (s := (min(b or now, d) - max(a, c)).total_seconds()) > 0:
                want[i, n, c] = s
    s, w = spark.createDataFrame(sessions, "session_id int, started_at timestamp, ended_at timestamp"), spark.createDataFrame(windows, "name string, begins timestamp, ends timestamp")
    for seconds in (3600, 86400, 10**7):
        got = joins.window_overlaps(s, w, F.lit(now), seconds).collect()
        assert len(got) == len(want) and {(g.session_id, g.name, g.begins): g.clipped_seconds for g in got} == want


def test_components_of_many_edges(spark):
    chain = [(k, k + 1) for k in range(0, 300)] + [(k, 1000) for k in range(900, 1000)] + [(7, 7), (2000, 2000), (3001, 3000)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 900 for k in range(900, 1001)} | {2000: 2000, 3001: 3000, 3000: 3000}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_component_over_many_partitions(spark):
    """A hub with 300,000 neighbours and a path through them: no task gets a large share of the edges of either."""
    n = 300_000
    hub = spark.range(1, n).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    edges = hub.union(spark.range(1, n - 1).select("id", F.col("id") + 1))
    out = graphs.components(edges)
    assert out.count() == n and out.where("root <> 0").count() == 0


def test_choice_of_pairs_is_that_of_one_after_another(spark):
    r = np.random.RandomState(6)
    rows = list({(int(v), 0, int(a), int(b)): (int(v), 0, int(a), int(b), float(s)) for v, a, b, s in zip(r.randint(0, 20, 900), r.randint(0, 8, 900), r.randint(0, 8, 900), r.randint(0, 4, 900) / 4, strict=True)}.values())
    want, used = set(), set()
    for v, f, a, b, _ in sorted(rows, key=lambda x: (x[4], x[2], x[3]), reverse=True):
        if ("l", v, a) not in used and ("r", v, b) not in used:
            used |= {("l", v, a), ("r", v, b)}
            want.add((v, a, b))
    df = spark.createDataFrame(rows, "video_id bigint, frame_id bigint, l int, r int, iou double")
    got = graphs.chosen_pairs(df, ["video_id", "l"], ["video_id", "r"], F.struct("iou", "l", "r"))
    assert {(g.video_id, g.l, g.r) for g in got.collect()} == want and got.columns == df.columns
    sides = [spark.createDataFrame([(v, 0, k) for v in range(21) for k in range(8)], "video_id bigint, frame_id bigint, det_idx int") for _ in range(2)]
    counts = {g.video_id: (g.tp, g.extra, g.missed) for g in boxes.compare_box_sets(df, *sides).collect()}
    assert counts == {v: ((n := sum(w[0] == v for w in want)), 8 - n, 8 - n) for v in range(21)}
    assert graphs.chosen_pairs(df.limit(0), ["l"], ["r"], F.col("iou")).count() == 0


def test_choice_of_nodes_is_that_of_one_after_another(spark):
    r = np.random.RandomState(7)
    nodes = [(g, k, float(r.randint(0, 5))) for g in range(6) for k in range(20)]
    edges = {(g, int(a), int(b)) for g in range(6) for a, b in r.randint(0, 20, (30, 2)) if a != b}
    edges |= {(g, b, a) for g, a, b in edges}
    want = set()
    for g, k, s in sorted(nodes, key=lambda x: (x[2], x[1]), reverse=True):
        if not any((g, k, o) in edges and (g, o) in want for o in range(20)):
            want.add((g, k))
    n = spark.createDataFrame(nodes, "g int, k int, score double")
    e = spark.createDataFrame([(g, a, g, b) for g, a, b in edges], "g int, k int, other_g int, other_k int")
    assert {(x.g, x.k) for x in graphs.chosen_nodes(n, e, ["g", "k"], F.struct("score", "k")).collect()} == want


def test_class_ids_as_one_after_another(spark):
    r = np.random.RandomState(8)
    labels = [f"class_{k}" if k % 3 == 0 else f"thing {k}" for k in r.randint(0, 60, 400)] + [None, "class_x", "class_7 "]
    known = {"thing 1": 0, "class_3": 5, "other": 9}
    want = dict(known)
    for label in labels:
        if label is not None and label not in want:
            n = label.removeprefix("class_")
            want[label] = int(n) if label.startswith("class_") and n.isdigit() else len(want)
    df = spark.createDataFrame(list(enumerate(labels)), "position bigint, label string")
    got = boxes.class_ids(df, spark.createDataFrame(list(known.items()), "label string, class_id bigint"))
    assert {x.label: x.class_id for x in got.collect()} == want


def test_choice_of_pairs_sends_no_table_to_all_tasks(spark, monkeypatch):
    # tables that are small as files were broadcast as rows, round by round.
    plans, store = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, *scratch: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, *scratch))
    rows = [(v, a, b, ((a * 7 + b * 3 + v) % 5) / 4) for v in range(12) for a in range(v + 1) for b in range(3)]
    df = spark.createDataFrame(rows, "video_id bigint, l int, r int, iou double")
    choose = lambda **most: sorted(tuple(g) for g in graphs.chosen_pairs(df, ["video_id", "l"], ["video_id", "r"], F.struct("iou", "l", "r"), **most).collect())
    whole = choose()
    assert len(plans) == 1 and len(whole) == 1 + 2 + 3 * 10
    assert choose(most=9) == whole and choose(most=0) == whole and len(plans) > 4
    assert not [p for p in plans if "Broadcast" in p]
