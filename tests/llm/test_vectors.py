"""Clustering, hard negatives and near duplicates of vectors, held against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import centroids, hard_negatives, queries, vector_dups

VEC = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], VEC).repartition(parts)


def floats(v):
    return [float(np.float32(x)) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, most=2**27):
    return [int(max(-most, min(most, math.floor(256 * x)))) for x in floats(v)]


# clustering


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if v is not None and len(v) == dims and finite(v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=name)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centers)]
    told = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in told if m == n) for _, _, n in told}
    digest = lambda n: hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest(n)) for i, d, n in told), key=repr)


def test_clusters_with_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), r.normal(size=6), 1) for i in range(150)] + [(3, r.normal(size=6), None), (None, r.normal(size=6), 2), (None, None, 2)]
    same = r.normal(size=6)
    rows += [(200 + i, same, 1) for i in range(40)]  # copies, so that clusters tie and some stay empty
    rows += [(300, [1, 2, 3, 4, 5, None], 1), (301, [1, 2, 3, 4, 5, math.nan], 1), (302, [math.inf] * 6, 1), (303, [1.0], 1), (304, [], 1), (305, [-3e38] * 6, 1)]
    s = centroids.Settings(dims=6, clusters=12, rounds=4)
    df = frame(spark, rows).withColumn("Cluster", F.lit(1)).withColumn("v", F.lit(2)).withColumn("a.b", F.lit(3))
    got = centroids.cluster(df, s).drop("centroid").collect()
    assert sorted(map(tuple, got), key=repr) == plain_clusters(rows, 6, 12, 4)


def test_clusters_of_few_and_of_none(spark):
    rows = [(1, [1, 2], 1), (2, [3, 4], 1)]
    s = centroids.Settings(dims=2)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in centroids.cluster(frame(spark, rows), s).collect()) == [(1, 0, 0), (2, 0, 0)]
    none = centroids.cluster(frame(spark, [(1, None, 1)]), s)
    assert none.columns == centroids.cluster(frame(spark, rows), s).columns and none.count() == 0
    assert centroids.cluster(frame(spark, rows).limit(0), s).count() == 0


def test_centroids_are_one_literal(spark):
    v = spark.createDataFrame([([1, 2],)], "v array<bigint>")
    plan = v.select(centroids._nearest(F.col("v"), [[0, 0], [1, 1]]))._jdf.queryExecution().optimizedPlan().toString()
    assert "[[[0,0],0],[[1,1],1]]" in plan and "from_json" not in plan.split("AS")[0]


# hard negatives


def plain_negatives(rows, label=lambda i, y: y, share=80, n=5):
    kept = [(i, whole(v), label(i, y)) for i, v, y in rows if y is not None and finite(v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (i, v, y) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), j, z) for b, (j, w, z) in enumerate(kept) if b != a and len(w) == len(v) and len(v)]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for ps, p, _ in [x for x in scored if x[2] == y][:n]:
            fit = [x for x in scored if x[2] != y and share * ps <= 100 * x[0] <= 100 * ps][:n]
            out += [(i, p, k + 1, j, ps, ns) for k, (ns, j, _) in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, s):
    df = frame(spark, rows).withColumn("Score", F.lit(1)).withColumn("uid", F.lit("x")).withColumn("a.b", F.lit(3))
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0, s).collect()), key=repr)


@pytest.mark.parametrize("dims", [8, 64, 70])
def test_negatives_over_blocks(spark, dims):
    r = np.random.default_rng(dims)
    centers = r.normal(size=(9, dims))
    rows = [(int(i), centers[r.integers(9)] + r.normal(size=dims) * r.choice([0.01, 0.3, 1]), int(r.integers(4))) for i in range(700)]
    s = hard_negatives.Settings(rows=150, anchors=3)
    want = plain_negatives(rows)
    assert len(want) > 50 and mined(spark, rows, s) == want


def test_negatives_with_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, np.round(r.normal(size=3), 1), int(r.integers(3))) for i in range(0, 2000, 20)]  # many ties
    rows += [(100, [1, 1, 1], 0), (100, [1, 1, 1], 0), (200, None, 1), (300, [1, None, 2], 1), (400, [1, math.nan, 2], 1), (500, [1, 2], 1), (5, [2, 1], 1), (6, [2, 2], 0), (7, [1, 2], 0), (600, [], 1), (601, [], 0)]
    rows += [(None, [1, 1, 1], 1), (None, [1, 1, 1], 1), (700, [1, 2, 3], None), (800, [0, 0, 0], 1), (801, [0, 0, 0], 2), (900, [3e38] * 3, 1), (901, [3e38] * 3, 1), (902, [3e38, 3e38, 1], 0)]
    assert mined(spark, rows, hard_negatives.Settings(rows=40, anchors=4)) == plain_negatives(rows)
    assert mined(spark, rows[:1], hard_negatives.Settings()) == [] and hard_negatives.mine(frame(spark, rows).limit(0), F.lit(True)).count() == 0


def test_intervals_hold_every_product_and_narrow():
    r = np.random.default_rng(3)
    v, q = r.integers(-300, 300, (500, 64)), r.integers(-300, 300, (20, 64))
    v[0], q[0] = 0, 0
    widths = []
    for levels in (1, 3, 6):
        codes, aligned, tail = hard_negatives.encoded(v, levels)
        low, high = hard_negatives.intervals(q, codes, aligned, tail, np.linalg.norm(v, axis=1), 8)
        exact = q @ v.T
        assert ((low <= exact) & (exact <= high)).all()
        widths.append((high - low).mean())
    assert widths[0] > 2 * widths[1] > 4 * widths[2] > 0
    # What the codes are for: of rows that don't come near a query's fifth, few are scored.
    assert (high >= np.sort(low, axis=1)[:, -5:-4]).mean() < 0.2


def test_negatives_of_the_query(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == plain_negatives(rows, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)


# near duplicates


def plain_links(rows, t=0.93):
    ok = [y is not None and finite(v) and any(floats(v)) for _, v, y in rows]
    unit = lambda v: np.array(floats(v)) / np.abs(floats(v)).max()
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = unit(rows[a][1]), unit(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    ids = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    comp = [ids.get(root(k)) for k in range(len(rows))]
    return sorted(((i, n, c, i is not None and i == c) for (i, _, _), n, c in zip(rows, links, comp, strict=True)), key=repr)


def deduped(spark, rows, s):
    df = frame(spark, rows).withColumn("Node", F.lit(1)).withColumn("V", F.lit(2)).withColumn("a.b", F.lit(3))
    return sorted(map(tuple, vector_dups.near_vectors(df, s).drop("class_size").collect()), key=repr)


def test_near_vectors_over_tiles(spark):
    r = np.random.default_rng(4)
    centers = r.normal(size=(30, 16))
    rows = [(int(i), centers[r.integers(30)] * r.uniform(0.1, 9) + r.normal(size=16) * r.choice([0, 0.2, 0.5, 2]), int(r.integers(3)) if i % 3 else 0) for i in range(600)]
    rows += [(1000 + i, centers[0], 0) for i in range(60)]
    want = plain_links(rows)
    assert sum(n for _, n, _, _ in want) > 4000 and sum(n == 0 for _, n, _, _ in want) > 50
    for tile in (40, 5000):
        assert deduped(spark, rows, vector_dups.Settings(tile=tile)) == want


def test_near_vectors_with_odd_rows(spark):
    rows = [(1, [1, 0], 1), (2, [5, 0], 1), (2, [5, 0], 1), (3, [1, 0], None), (4, None, 1), (5, [0, 0], 1), (6, [-0.0, 0], 1), (7, [1, None], 1), (8, [1, math.nan], 1), (9, [math.inf, 1], 1), (10, [], 1), (11, [], 1)]
    rows += [(None, [1, 0], 1), (None, [0, 1], 2), (None, None, 2), (12, [3e38, 0], 1), (13, [1e-38, 0], 1), (14, [1, 0, 0], 1), (15, [1, 0.3], 1), (16, [-1, 0], 1), (17, [1, -0.0], 1), (18, [1, 0], 2)]
    assert deduped(spark, rows, vector_dups.Settings(tile=2)) == plain_links(rows)
    assert vector_dups.near_vectors(frame(spark, rows).limit(0)).count() == 0


def test_quantised_bounds_and_recomputed_pairs():
    """The bounds hold, and leave few pairs to be recomputed beside the links."""
    r = np.random.default_rng(6)
    v = r.normal(size=(400, 64)) * np.exp(r.normal(size=(400, 1)))
    q, step, length, error = vector_dups.quantised(v)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    apart = np.abs(u @ u.T - vector_dups.products(q, q) * step[:, None] * step)
    bound = length[:, None] * error + error[:, None] * (length + error)
    assert (apart <= bound + 1e-12).all() and bound.max() < 0.05
    wide = r.integers(-127, 128, (3, 3000)).astype(np.int8)
    assert (vector_dups.products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()
