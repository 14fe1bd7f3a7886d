"""Near-duplicate vectors: products of int8 tiles with proven error bounds, full precision for the pairs that the bounds leave open."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.centroids import finite
from trackloom.llm.common import forget, stored
from trackloom.llm.near_dups import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    #: Different vectors of a tile, about: what one task holds is two tiles.
    tile: int = 2048
    #: What rounding can add to a bound of numbers near 1.
    slack: float = 1e-9


#: Rows of a tile that are multiplied at once, and pairs that are recomputed at once.
ROWS, PAIRS = 256, 1 << 15


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, step, length, error) of each row's direction u: q in int8, |q * step| and |u - q * step|, so that u is within error of q * step."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    step = np.abs(u).max(axis=1) / 127
    q = np.rint(u / step[:, None]).astype(np.int8)
    near = q * step[:, None]
    return q, step, np.linalg.norm(near, axis=1), np.linalg.norm(u - near, axis=1)


def products(q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows, by float32 matrix products of at most 1,024 components: those stay below 2^24."""
    out = np.zeros((len(q), len(other)))
    for k in range(0, q.shape[1], 1024):
        out += q[:, k : k + 1024].astype(np.float32) @ other[:, k : k + 1024].astype(np.float32).T
    return out


def linked(x: dict, y: dict | None, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (i, j) of the pairs of tiles x and y whose cosine reaches the threshold; without y, of x's own pairs with i < j."""
    o = y or x
    for lo in range(0, len(x["v"]), ROWS):
        own = slice(lo, lo + ROWS)
        cosine = products(x["q"][own], o["q"]) * (x["step"][own, None] * o["step"])
        open_by = x["length"][own, None] * o["error"] + x["error"][own, None] * (o["length"] + o["error"])
        i, j = np.nonzero(cosine + open_by >= s.threshold - s.slack)
        i += lo
        if y is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            exact = np.einsum("ij,ij->i", x["v"][a], o["v"][b]) / (x["norm"][a] * o["norm"][b])
            yield a[exact >= s.threshold], b[exact >= s.threshold]


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A tile as one row. Components are scaled by a power of two, which changes no cosine, so that no norm overflows."""
    v = np.stack(frame["v"].to_numpy()).astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    q, step, length, error = quantised(v)
    row = frame.iloc[:1][["label", "dims", "tiles", "tile"]].reset_index(drop=True)
    parts = {"node": b"".join(map(bytes, frame["node"])), "n": frame["n"].to_numpy(np.int64), "v": v, "q": q, "step": step, "length": length, "error": error, "norm": np.linalg.norm(v, axis=1)}
    return row.assign(**{k: [p if isinstance(p, bytes) else p.tobytes()] for k, p in parts.items()})


def _unpacked(row: pd.Series) -> dict:
    of = lambda k, kind=np.float64: np.frombuffer(row[k], kind)
    d = row["dims"]
    return {"node": [row["node"][k : k + 16] for k in range(0, len(row["node"]), 16)], "n": of("n", np.int64), "v": of("v").reshape(-1, d), "q": of("q", np.int8).reshape(-1, d), **{k: of(k) for k in ("step", "length", "error", "norm")}}


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that links reach from each of n places."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in pairs:
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            root = root[root]
        if (root == before).all():
            return root


def near_vectors(vectors: DataFrame, settings: Settings | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", kept: list[str] | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, class_size.

    Vectors link whose labels are equal, not null, and whose cosine in double precision is at least the threshold; those with
    different numbers of components never do. Null, empty and zero vectors, those with null or non-finite components and those
    without a label link with nothing: n_links is 0 and component_id their own vec_id. Rows that repeat a vector, with or without
    the same vec_id, are vectors of their own, linked with each other; class_size counts them. Null ids are never the smallest
    where there is another, and not kept. Empty tables give no rows. Other columns don't matter, whatever their names.

    Equal vectors of a label become one first. The different ones of a label are dealt to tiles, and each pair of tiles of a
    label, which any task can do again, gives counts of links and a star for each of its components: no pairs. The work of a
    label grows with the square of its different vectors, as the method's does. ``kept`` gets the path of the table that the
    result reads.
    """
    s = settings or Settings()
    scratch: list[str] = []
    own = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + 0.0)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), own.alias("v"))
    usable = F.col("label").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    text = F.concat_ws(":", F.col("label").cast("string"), F.col("v").cast("string"))
    rows = rows.withColumn("node", F.when(usable, F.unhex(F.md5(text))))
    classes = stored(rows.where("node is not null").groupBy("node", "label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("dims", F.size("v")), scratch)

    counts = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / s.tile).cast("int").alias("tiles"))
    dealt = classes.join(counts, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    kind = classes.schema["label"].dataType.simpleString()
    parts = ", ".join(f"{c} binary" for c in ("node", "n", "v", "q", "step", "length", "error", "norm"))
    tiles = stored(dealt.groupBy("label", "dims", "tiles", "tile").applyInPandas(_pack, f"label {kind}, dims int, tiles int, tile int, {parts}"), scratch)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) == 1 and frame["lo"][0] != frame["hi"][0]:  # the other tile got no vector
            return pd.DataFrame({"a": [], "b": [], "links": []})
        x = _unpacked(frame.iloc[0])
        y = _unpacked(frame.iloc[1]) if len(frame) > 1 else None
        o, at = y or x, len(x["n"]) if y else 0
        nodes = x["node"] + (y["node"] if y else [])
        links, pairs = np.zeros(len(nodes), np.int64), []
        for a, b in linked(x, y, s):
            np.add.at(links, a, o["n"][b])
            np.add.at(links, b + at, x["n"][a])
            pairs.append((a, b + at))
        root, some = _roots(len(nodes), pairs), np.flatnonzero(links)
        return pd.DataFrame({"a": [nodes[k] for k in some], "b": [nodes[k] for k in root[some]], "links": links[some]})

    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    both = tiles.select("*", other).withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    met = stored(both.groupBy("label", "dims", "lo", "hi").applyInPandas(compare, "a binary, b binary, links long"), scratch)

    links = met.groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(met.where("a <> b").select("a", "b"), scratch)
    named = classes.select("node", "n", "least").join(links, F.col("node") == F.col("a"), "left").drop("a").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stored(named, scratch)
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    told = stored(named.join(ids, "comp").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.col("n").alias("class_size")), kept)
    forget(vectors.sparkSession, scratch)
    out = rows.select("vec_id", "node").join(told, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
