"""Choices and components over tables of edges, in rounds of joins: no group of them has to lie in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ordering import forget, stored


def _count(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node in an edge (a, b) the smallest node that edges reach. Nodes are of any type that has an order.

    Large and small stars in turn (Kiveris et al., 2014): a node's neighbours above it are hung to the smallest one around it, then
    those below. A hub's smallest neighbour is found by partial minima, and the join brings it to its edges, so a hub's edges
    are nowhere together.
    """
    scratch: list[str] = []
    edge = lambda a, b: (F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
    given = stored(edges.select(*edge("a", "b")).distinct(), scratch)  # once, as edges are often dear to find
    at = given.where("v <> u")
    mark = None
    while (new := _count(at)) != mark:
        mark = new
        both = at.select("u", "v").union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"))
        at = stored(small.distinct(), scratch)
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct())
    own = given.where("v = u").select("v")
    alone = own.join(roots, F.col("v") == F.col("node"), "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root"))
    out = stored(roots.union(alone))
    forget(edges.sparkSession, scratch)
    return out


def chosen_pairs(pairs: DataFrame, left: list[str], right: list[str], order: Column, most: int = 256) -> DataFrame:
    """The rows of ``pairs`` that a greedy choice takes: by ``order``, the largest first, each that shares neither its ``left`` nor its ``right`` with one taken before.

    ``order`` must be the same for no two rows. What ``left`` and ``right`` have in common parts the table: a part of up to
    ``most`` pairs is gone through where it lies. The other parts go in rounds: a pair that is the largest left at both its ends is
    taken whatever the others do; so each round takes those, and drops what shares an end with them.
    """
    shared = [c for c in left if c in right]
    if not shared:
        return _chosen_in_rounds(pairs, left, right, order)
    scratch: list[str] = []
    ends = [F.struct(*[F.col(c) for c in side if c not in shared]).alias(k) for side, k in ((left, "l"), (right, "r"))]
    row = F.struct(order.alias("o"), *ends, F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("row"))
    one = F.struct(*[F.col(c) for c in {*left, *right} - {*shared}])
    large = F.count("*").over(Window.partitionBy(*shared)) > most
    parts = pairs.withColumn("__row", row).withColumn("__large", F.when(large, one))  # a large part's pairs stay apart
    parts = parts.groupBy(*shared, "__large").agg(F.sort_array(F.collect_list("__row"), asc=False).alias("__rows"))
    none = lambda c: F.transform(F.slice("__rows", 1, 0), lambda x: x[c])
    free = lambda s, x: ~F.exists(s["l"], lambda k: k == x["l"]) & ~F.exists(s["r"], lambda k: k == x["r"])
    longer = lambda s, x: F.struct(*[F.concat(s[c], F.array(x[c])).alias(c) for c in ("l", "r", "row")])
    taken = F.aggregate("__rows", F.struct(*[none(c).alias(c) for c in ("l", "r", "row")]), lambda s, x: F.when(free(s, x), longer(s, x)).otherwise(s), lambda s: s["row"])
    found = stored(parts.select(F.col("__large").isNotNull().alias("large"), taken.alias("rows")), scratch)
    rows = lambda large: found.where(F.col("large") == large).select(F.explode("rows").alias("r")).select("r.*")
    if found.where("large").isEmpty():
        return rows(False)
    out = stored(rows(False).unionByName(_chosen_in_rounds(rows(True), left, right, order)))
    forget(pairs.sparkSession, scratch)
    return out


def _chosen_in_rounds(pairs: DataFrame, left: list[str], right: list[str], order: Column) -> DataFrame:
    """``chosen_pairs`` in rounds. The stored tables are small as files and large as rows, so they are shuffled, never sent whole to all tasks."""
    scratch: list[str] = []
    rest, taken = stored(pairs.withColumn("__o", order), scratch), None
    while True:
        best = lambda key: rest.groupBy(*key).agg(F.max("__o").alias("__o")).hint("merge")  # noqa: E731, B023
        first = rest.join(best(left), [*left, "__o"], "left_semi").join(best(right), [*right, "__o"], "left_semi")
        first = stored(first, scratch)
        taken = first if taken is None else taken.unionByName(first)
        rest = stored(rest.join(first.hint("merge"), left, "left_anti").join(first.hint("merge"), right, "left_anti"), scratch)
        if rest.isEmpty():
            break
    out = stored(taken.select(*[F.col(f"`{c}`") for c in pairs.columns]))
    forget(pairs.sparkSession, scratch)
    return out


def chosen_nodes(nodes: DataFrame, edges: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The rows of ``nodes`` that a greedy choice keeps: by ``order``, the largest first, each that no edge joins to one kept before.

    ``edges`` has the columns of ``key`` and, with ``other_`` before their names, those of the other end, each edge in both
    directions. A node that is the largest left among its neighbours is kept whatever the others do, and its neighbours go.
    """
    scratch: list[str] = []
    nodes = stored(nodes, scratch)
    other = [f"other_{k}" for k in key]
    rest, kept = nodes.select(*key, order.alias("__o")), None
    links = stored(edges.select(*key, *other).distinct(), scratch)
    while True:
        ends = rest.select(*[F.col(k).alias(f"other_{k}") for k in key], F.col("__o").alias("other_o"))
        live = links.join(rest, key).join(ends, other)
        beaten = live.where("other_o > __o").select(*key).distinct()
        first = stored(rest.join(beaten, key, "left_anti"), scratch)
        kept = first if kept is None else kept.unionByName(first)
        gone = live.join(first.select(*[F.col(k).alias(f"other_{k}") for k in key]), other, "left_semi").select(*key).distinct()
        rest = stored(rest.join(first, key, "left_anti").join(gone, key, "left_anti"), scratch)
        if rest.isEmpty():
            break
    out = stored(nodes.join(kept.select(*key), key, "left_semi"))
    forget(nodes.sparkSession, scratch)
    return out
