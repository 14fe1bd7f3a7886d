"""Hard negatives by rotated one-bit codes: popcounts estimate products, Cauchy-Schwarz bounds what they miss, survivors are scored in integers.

A vector is rotated and each component's sign kept; with the code's alignment, the vector's product with the unit vector of those
signs, a query's product with the vector is alignment * (query's product with the code) + (query's product with the residual). The
first is estimated by popcounts of the code against the bit planes of the rotated query, the second is at most the residual's
length times that of the query's part across the code, as the residual lies across it. The residual is coded in turn, under a
rotation of its own: each level shrinks it by some 0.6, so that a few levels leave a narrow interval that always holds the product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.centroids import finite, scaled
from trackloom.llm.common import forget, stored


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this share of the positive's, in percent, and at most all of it.
    percent: int = 80
    scale: int = 256
    #: Integer components lie within this of 0: products of up to 64 components then fit in 64 bits, five times over.
    most: int = 2**27
    #: Codes of a vector, and bits of a query's rotated components.
    levels: int = 6
    bits: int = 8
    #: Rows and anchors of a block, about: a task holds one block of each.
    rows: int = 8192
    anchors: int = 1024


#: Anchors that meet a block of rows at once, and pairs that are scored at once.
CHUNK, PAIRS = 32, 1 << 15
#: Beyond what the bounds say, for rounding, as a share of both vectors' lengths.
SLACK = 1e-9


@lru_cache(maxsize=64)
def rotation(dims: int, level: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([7, dims, level]).standard_normal((dims, dims)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encoded(v: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, length of what is left) of each row: [n, levels, words], [n, levels], [n]."""
    left, dims = v.astype(np.float64), v.shape[1]
    codes, aligned = [], []
    for k in range(levels):
        turn = rotation(dims, k)
        turned = left @ turn.T
        bits = turned >= 0
        code = np.where(bits, 1.0, -1.0) / np.sqrt(dims)
        own = (turned * code).sum(axis=1)
        left = left - own[:, None] * (code @ turn)
        codes.append(_words(bits))
        aligned.append(own)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(left, axis=1)


def intervals(q: np.ndarray, codes: np.ndarray, aligned: np.ndarray, tail: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) product of each query and coded vector, of ``lengths``, that the codes allow."""
    q, dims = q.astype(np.float64), q.shape[1]
    size = np.linalg.norm(q, axis=1)
    estimate, width = np.zeros((len(q), len(tail))), np.zeros((len(q), len(tail)))
    for k in range(codes.shape[1]):
        turned = q @ rotation(dims, k).T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**bits - 1), np.finfo(float).tiny)
        steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        near = low[:, None] + step[:, None] * steps
        missed = np.abs(turned - near).sum(axis=1) / np.sqrt(dims)
        code = codes[:, k]
        counts = np.zeros(estimate.shape, np.int64)
        for p in range(bits):
            plane = _words((steps >> p) & 1 == 1)
            for w in range(code.shape[1]):
                counts += np.bitwise_count(plane[:, None, w] & code[None, :, w]).astype(np.int64) << p
        ones = np.bitwise_count(code).sum(axis=1)
        product = (2 * (low[:, None] * ones + step[:, None] * counts) - near.sum(axis=1)[:, None]) / np.sqrt(dims)
        estimate += aligned[:, k] * product
        width += aligned[:, k] * missed[:, None]
    along = np.maximum(np.abs(product) - missed[:, None], 0)
    width += tail * np.sqrt(np.maximum(size[:, None] ** 2 - along**2, 0)) + SLACK * size[:, None] * lengths
    return estimate - width, estimate + width


def _least_of(low: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """For each row the n-th largest of ``low`` among some; what lies below it is in no first n. -inf where there are fewer."""
    held = np.where(among, low, -np.inf)
    return np.partition(held, -n, axis=1)[:, -n] if held.shape[1] >= n else np.full(len(held), -np.inf)


def scores(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", q[i[k : k + PAIRS]], v[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, rows: dict, n: int) -> np.ndarray:
    """The places of the first n pairs of each i: higher scores first, then smaller ids, null ids last, then rows as they are numbered."""
    order = np.lexsort((rows["uid"][j], rows["id"][j], ~rows["known"][j], -score, i))
    begins = np.r_[True, i[order][1:] != i[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return order[rank < n]


def positives(anchors: dict, rows: dict, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score, 0) of each anchor's first rows of its own label in a block, itself left out; labels are taken one by one."""
    for label in np.intersect1d(anchors["label"], rows["label"]):
        mine, at = np.flatnonzero(anchors["label"] == label), np.flatnonzero(rows["label"] == label)
        part = {k: rows[k][at] for k in ("uid", "id", "known", "v", "codes", "aligned", "tail", "length")}
        for k in range(0, len(mine), CHUNK):
            own = mine[k : k + CHUNK]
            low, high = intervals(anchors["v"][own], part["codes"], part["aligned"], part["tail"], part["length"], s.bits)
            other = anchors["uid"][own, None] != part["uid"]
            i, j = np.nonzero(other & (high >= _least_of(low, other, s.positives)[:, None]))
            score = scores(anchors["v"][own], part["v"], i, j)
            first = _first(i, j, score, part, s.positives)
            yield own[i[first]], at[j[first]], score[first], np.zeros(len(first), np.int64)


def negatives(anchors: dict, rows: dict, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score, positive) of the first rows in a block of other labels whose score fits each of the anchor's positives."""
    share, whole = s.percent // math.gcd(s.percent, 100), 100 // math.gcd(s.percent, 100)  # small, so that products stay in 64 bits
    for k in range(0, len(anchors["uid"]), CHUNK):
        own = slice(k, k + CHUNK)
        caps = anchors["caps"][own]
        low, high = intervals(anchors["v"][own], rows["codes"], rows["aligned"], rows["tail"], rows["length"], s.bits)
        other, wanted = anchors["label"][own, None] != rows["label"], np.zeros(low.shape, bool)
        for p in range(caps.shape[1]):
            cap = caps[:, p, None].astype(np.float64)  # -1 where there is no positive, or one that no row can fit
            sure = other & (100 * low >= s.percent * cap) & (high <= cap) & (cap >= 0)
            least = _least_of(low, sure, s.negatives)[:, None]
            wanted |= other & (100 * high >= s.percent * cap) & (low <= cap) & (high >= least) & (cap >= 0)
        i, j = np.nonzero(wanted)
        score = scores(anchors["v"][own], rows["v"], i, j)
        for p in range(caps.shape[1]):
            cap = caps[i, p]
            fits = np.flatnonzero((cap >= 0) & (score <= cap) & (whole * score >= share * cap))
            first = fits[_first(i[fits], j[fits], score[fits], rows, s.negatives)]
            yield i[first] + k, j[first], score[first], np.full(len(first), p)


_COMMON = (("uid", np.int64), ("id", np.int64), ("known", bool), ("label", np.int64))
_KEYS = ["dims", "rows", "anchors"]


def _block(frame: pd.DataFrame, key: str, **more: np.ndarray) -> pd.DataFrame:
    v = np.stack(frame["v"].to_numpy()).astype(np.int64)
    parts = {"uid": frame["uid"], "id": frame["id"].fillna(0), "known": frame["id"].notna(), "label": frame["label"]}
    parts = {k: np.ascontiguousarray(parts[k].to_numpy(), kind) for k, kind in _COMMON} | {"v": v.astype(np.int32)} | more
    return frame.iloc[:1][[*_KEYS, key]].reset_index(drop=True).assign(**{k: [p.tobytes()] for k, p in parts.items()})


def _read(row: pd.Series, s: Settings) -> dict:
    out = {k: np.frombuffer(row[k], kind) for k, kind in _COMMON}
    n, d = len(out["uid"]), int(row["dims"])
    out["v"] = np.frombuffer(row["v"], np.int32).reshape(n, d).astype(np.int64)
    if row["side"]:
        return out | {"caps": np.frombuffer(row["caps"], np.int64).reshape(n, s.positives)}
    floats = lambda k, *shape: np.frombuffer(row[k], np.float64).reshape(n, *shape)
    codes = np.frombuffer(row["codes"], np.uint64).reshape(n, s.levels, -1)
    return out | {"codes": codes, "aligned": floats("aligned", s.levels), "tail": floats("tail"), "length": np.linalg.norm(out["v"].astype(np.float64), axis=1)}


def _row_blocks(dealt: DataFrame, s: Settings) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        codes, aligned, tail = encoded(np.stack(frame["v"].to_numpy()), s.levels)
        return _block(frame, "r", codes=codes, aligned=aligned, tail=tail)

    parts = ", ".join(f"{k} binary" for k in ("uid", "id", "known", "label", "v", "codes", "aligned", "tail"))
    keyed = dealt.withColumn("r", F.pmod(F.xxhash64("uid"), "rows").cast("int"))
    return keyed.groupBy(*_KEYS, "r").applyInPandas(pack, f"dims int, rows int, anchors int, r int, {parts}")


def _anchor_blocks(dealt: DataFrame, s: Settings) -> DataFrame:
    """dealt has ``caps``, the scores of each anchor's positives: an array, or null."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        caps = np.full((len(frame), s.positives), -1, np.int64)
        for k, own in enumerate(frame["caps"]):
            if own is not None:
                caps[k, : len(own)] = own
        return _block(frame, "a", caps=caps)

    parts = ", ".join(f"{k} binary" for k in ("uid", "id", "known", "label", "v", "caps"))
    keyed = dealt.withColumn("a", F.pmod(F.xxhash64("uid"), "anchors").cast("int"))
    return keyed.groupBy(*_KEYS, "a").applyInPandas(pack, f"dims int, rows int, anchors int, a int, {parts}")


def _met(rows: DataFrame, anchors: DataFrame, find: object, n: int, s: Settings) -> DataFrame:
    """(anchor, uid, id, score, part): the first n of each anchor and part over all blocks; every block of rows meets every block of anchors in a group of its own."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        sides = {int(r["side"]): _read(r, s) for _, r in frame.iterrows()}
        if len(sides) < 2:
            return pd.DataFrame({"anchor": [], "uid": [], "id": [], "score": [], "part": []})
        found = list(find(sides[1], sides[0], s))
        i, j, score, part = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(4))
        ids = pd.array(sides[0]["id"][j], "Int64")
        ids[~sides[0]["known"][j]] = pd.NA
        return pd.DataFrame({"anchor": sides[1]["uid"][i], "uid": sides[0]["uid"][j], "id": ids, "score": score, "part": part})

    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("anchors > 0").withColumn("side", F.lit(0)).withColumn("a", upto("anchors"))
    right = anchors.withColumn("side", F.lit(1)).withColumn("r", upto("rows"))
    pairs = left.unionByName(right, allowMissingColumns=True).groupBy("dims", "r", "a")
    found = pairs.applyInPandas(meet, "anchor long, uid long, id long, score long, part long")
    w = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, anchor: Column, settings: Settings | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", kept: list[str] | None = None) -> DataFrame:
    """One row per hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of a row of ``vectors`` whether it is an anchor. Scores are inner products of the components times ``scale``,
    rounded down; higher ones come first, ties by the smaller id, null ids last. An anchor's positives are its first other rows of
    the same label, a positive's negatives the first rows of other labels whose score lies within ``percent`` of the positive's
    and the positive's own. Rows with a null label, a null vector or a null or non-finite component take no part, and only
    vectors with as many components as the anchor meet it. Each row counts, also where rows repeat an id or a vector: a repeated
    anchor appears as often and is a positive of its repetition. Labels are whole numbers. Anchors without positives, and
    positives without negatives, give no rows. Other columns don't matter, whatever their names. ``kept`` gets the path of the
    table that the result reads.

    Rows and anchors are dealt to blocks by row numbers, so that no key gathers; a block pair returns its first rows only.
    """
    s = settings or Settings()
    spark, scratch = vectors.sparkSession, []
    v = F.col(f"`{vector}`")
    rows = vectors.where(F.col(f"`{label}`").isNotNull() & finite(v))
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), scaled(v, s.scale, s.most).cast("array<int>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = stored(rows.withColumn("dims", F.size("v")).withColumn("uid", F.monotonically_increasing_id()), scratch)
    blocks = lambda c, n: F.ceil(c / n).cast("int")
    counts = base.groupBy("dims").agg(blocks(F.count("*"), s.rows).alias("rows"), blocks(F.count_if("anchor"), s.anchors).alias("anchors"))
    dealt = base.where("dims > 0").join(counts, "dims")
    coded = stored(_row_blocks(dealt, s), scratch)
    anchors = dealt.where("anchor")

    plain = _anchor_blocks(anchors.withColumn("caps", F.lit(None).cast("array<bigint>")), s)
    best = stored(_met(coded, plain, positives, s.positives, s).select("anchor", (F.col("rank") - 1).cast("long").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), scratch)
    caps = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("part", "positive_score"))).alias("c"))
    capped = anchors.join(caps.select(F.col("anchor").alias("uid"), F.transform("c", lambda x: x["positive_score"]).alias("caps")), "uid")
    found = _met(coded, _anchor_blocks(capped, s), negatives, s.negatives, s)
    found = found.select("anchor", "part", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = base.where("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = stored(found.join(best, ["anchor", "part"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), kept)
    forget(spark, scratch)
    return out
