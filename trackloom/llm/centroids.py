"""Centroid clustering of vectors in integers: literal centroid arrays, JVM-side distances, column sums for the next centroids."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, stored


@dataclass(frozen=True)
class Settings:
    dims: int = 64
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    #: The start centroids are the vectors whose ids have the smallest hashes with this salt.
    salt: str = "2"
    #: Integer components lie within this of 0, so that no distance of up to 64 components leaves 64 bits: components of
    #: 2^19 and more in size, at the scale of 256, count as 2^19.
    most: int = 2**27


def finite(vector: Column) -> Column:
    """Whether vector is an array whose components are all there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: odd(x.cast("double"))), F.lit(False))


def scaled(vector: Column, scale: int, most: int) -> Column:
    """The components times ``scale``, rounded down to integers within ``most`` of 0."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(most))), F.lit(float(-most)))).cast("bigint"))


def _nearest(v: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; of equally near ones that with the smallest number."""
    # One text, which the optimizer turns into a literal array: thousands of literals of their own would take it seconds.
    literal = F.from_json(F.lit(json.dumps([{"c": c, "k": k} for k, c in enumerate(centroids)])), "array<struct<c: array<bigint>, k: int>>")
    square = lambda a, b: (a - b) * (a - b)
    distance = lambda c: F.aggregate(F.zip_with(v, c, square), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.array_min(F.transform(literal, lambda c: F.struct(distance(c["c"]).alias("distance"), c["k"].alias("cluster"))))


def _means(at: DataFrame, dims: int) -> dict[int, list[int]]:
    """The floor of each component's mean for the clusters that have vectors: one row a cluster comes to the driver."""
    sums = at.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
    return {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(dims)] for r in sums.collect()}


def cluster(vectors: DataFrame, settings: Settings | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and the centroid.

    Vectors are kept that have exactly ``dims`` components, none null or not finite; null vectors go. Rows that repeat an id or a
    vector each count. A null id can only start a cluster where ids run out; of equal hashes the smaller vector goes first. With
    fewer vectors than ``clusters`` each starts one. Empty tables give no rows. An inertia beyond 64 bits is null. Other columns
    of the input don't matter, whatever their names.

    What comes to the driver is one row of ``dims`` sums for each cluster and round; nothing of it grows with the table.
    """
    s = settings or Settings()
    spark, scratch = vectors.sparkSession, []
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    rows = rows.where((F.size("v") == s.dims) & finite(F.col("v"))).select("vec_id", scaled(F.col("v"), s.scale, s.most).alias("v"))
    kept = stored(rows, scratch)
    place = F.sha2(F.concat(F.lit(f"{s.salt}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r["v"] for r in kept.orderBy(place.asc_nulls_last(), "v").limit(s.clusters).collect()]
    if not centroids:
        forget(spark, scratch)
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.col("v").alias("centroid")).where("false")
    for _ in range(s.rounds):
        means = _means(kept.select("v", _nearest(F.col("v"), centroids)["cluster"].alias("cluster")), s.dims)
        centroids = [means.get(k, c) for k, c in enumerate(centroids)]

    best = _nearest(F.col("v"), centroids)
    sums = kept.select(best.alias("best")).groupBy("best.cluster").agg(F.sum(F.col("best.distance").cast("decimal(38,0)")).alias("d")).collect()
    forget(spark, scratch)
    fit = lambda x: int(x) if x < 2**63 else None
    total = fit(sum(int(r["d"]) for r in sums))
    told = [(r["cluster"], fit(r["d"]), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest(), centroids[r["cluster"]]) for r in sums]
    names = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    # As a generator, so that no filter or projection takes the distances again.
    placed = rows.select("vec_id", F.inline(F.array(best)))
    return placed.join(F.broadcast(spark.createDataFrame(told, names)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
