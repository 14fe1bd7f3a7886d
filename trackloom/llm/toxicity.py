"""Toxicity by maximum-scoring segments of token log-odds.

Each token has a log-odds ratio, toxic against other documents, under an informative Dirichlet prior (Monroe, Colaresi and
Quinn, 2008), and its z-score. Tokens with a clear z-score carry their log-odds; all others carry a small negative score, so
that the expected score of ordinary text is negative. One linear scan finds all maximal scoring segments of a text (Ruzzo and
Tompa, 1999). A segment's chance in ordinary text follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s))
(Karlin and Altschul, 1990); lambda and K are fitted to the ordinary documents of the sample. A document's evidence is the sum
over its significant segments of the logarithm of their rarity, and a logistic curve fitted to the sample makes it a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from trackloom.llm.common import stored

TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to learn from, at most (the first by a hash of their id). prior: weight of the prior, in words by
    their shares in all rows; floor: what it adds to each word. z: least z-score of a token that counts; the tokens of
    the sample bound how many there are. drift: score of any other token. significant: largest chance of a segment
    that counts. threshold: least score of a toxic document.
    """

    sample: int = 20_000
    prior: float = 500.0
    floor: float = 0.5
    z: float = 3.0
    drift: float = -0.08
    significant: float = 0.5
    threshold: float = 0.7


@dataclass
class Model:
    """weights: token -> score; default: the score of any other token; lam, k: of the extreme-value law; a, b: of the logistic curve."""

    weights: dict[str, float]
    default: float
    lam: float
    k: float
    significant: float
    a: float = 1.0
    b: float = 0.0

    def segments(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """All maximal scoring segments as (score, start, end), in tokens, and the number of tokens."""
        found = TOKEN.findall((text or "").lower())
        get = self.weights.get
        scored = [(k, w) for k, w in ((k, get(t)) for k, t in enumerate(found)) if w is not None]
        return maximal(scored, self.default), len(found)

    def chance(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.lam * score))

    def evidence(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        found, n = self.segments(text)
        kept = [(s, a, b) for s, a, b in found if self.chance(s, n) <= self.significant]
        return sum(-math.log(max(self.chance(s, n), 1e-300)) for s, _, _ in kept), kept

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * math.log1p(evidence) + self.b))))


def maximal(scored: list[tuple[int, float]], default: float) -> list[tuple[float, int, int]]:
    """The maximal scoring segments of a sequence whose other places all score ``default`` < 0: Ruzzo and Tompa's scan over the scored places.

    >>> maximal([(0, 2.0), (2, 3.0), (9, 1.0)], -1.0)
    [(4.0, 0, 3), (1.0, 9, 10)]
    """
    stack: list[tuple[float, float, int, int, int]] = []  # (sum before, sum after, start, end, the nearest below with a smaller sum before)
    total, last = 0.0, 0
    for at, w in scored:
        total += default * (at - last)
        last = at + 1
        if w <= 0:
            total += w
            continue
        left, right, start = total, total + w, at
        total = right
        j = len(stack) - 1
        while True:
            # Whatever is stepped over here, the new segment's own link steps over from now on: the scan is linear.
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, _, start, _, below = stack[j]
            del stack[j:]
            j = below
        stack.append((left, right, start, at + 1, j))
    return [(r - le, a, b) for le, r, a, b, _ in stack]


def sampled(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str, text: str, label: str) -> DataFrame:
    """(label, text), distinct, of at most ``sample`` labelled ids outside the held-out third, and as many rows at most. The ids, which are bounded so, go to where the texts are."""
    own = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~held_out(F.col(doc_id))).select(doc_id, F.col(label).cast("int").alias("label"))
    chosen = own.groupBy(doc_id).agg(F.max("label").alias("label")).orderBy(F.xxhash64(doc_id), doc_id).limit(s.sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen.toDF("i", "label")), "i").select("label", "text").distinct()
    return rows.orderBy(F.xxhash64("text"), "text", "label").limit(s.sample)


def held_out(doc_id: Column) -> Column:
    """The third of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def token_counts(rows: DataFrame) -> tuple[DataFrame, Row]:
    """(w, t, o): the sample's tokens with the numbers of toxic and other rows that hold them, and the sums of t and o. Rows count, as a token's repeats within one say little."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {0: Counter(), 1: Counter()}
        for f in frames:
            for y, t in zip(f["label"], f["text"], strict=True):
                counts[int(y > 0)].update(set(TOKEN.findall(t.lower())))
            if sum(map(len, counts.values())) > 200_000:
                yield pd.DataFrame([(w, y, n) for y, c in counts.items() for w, n in c.items()], columns=["w", "y", "n"])
                counts = {0: Counter(), 1: Counter()}
        yield pd.DataFrame([(w, y, n) for y, c in counts.items() for w, n in c.items()], columns=["w", "y", "n"])

    sums = rows.mapInPandas(work, "w string, y int, n long").groupBy("w").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("o"))
    totals = sums.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    return sums, totals


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of a bounded sample of labelled rows. With one label only, or none, every score is the sample's share of toxic rows, 0 if there are no rows."""
    s = settings or Settings()
    rows = stored(sampled(docs, labels, s, doc_id, text, label))
    sums, totals = token_counts(rows)
    n1, n2 = totals["t"] or 0, totals["o"] or 0
    weights: dict[str, float] = {}
    if n1 and n2:
        a = s.floor + F.lit(s.prior) * (F.col("t") + F.col("o")) / (n1 + n2)
        y1, y2 = F.col("t") + a, F.col("o") + a
        d = F.log(y1 / (n1 + s.prior - y1)) - F.log(y2 / (n2 + s.prior - y2))
        z = F.abs(d) / F.sqrt(1 / y1 + 1 / y2)
        kept = sums.select("w", d.alias("d"), z.alias("z")).where(F.col("z") >= s.z)
        weights = {r["w"]: r["d"] for r in kept.collect()}
    model = Model(weights, s.drift, 1.0, 1.0, s.significant)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Each ordinary row's best segment and length: as many rows as the sample has.
    best = rows.select("label", _best(shared)(F.col("text")).alias("b")).select("label", "b.*").toPandas()
    plain = best[(best["label"] == 0) & (best["n"] > 0)]
    over = plain[plain["score"] > 0]
    if len(over):
        # The tail of the scores is exponential, at one over the mean excess. A quarter is added to it, which keeps the rate below 4
        # where a few scores lie close together; K is from the expected number of exceedances.
        model.lam = 1.0 / max(1e-6, float(over["score"].mean()) - float(over["score"].min()) + 0.25)
        model.k = len(over) / float(plain["n"].sum()) * math.exp(model.lam * float(over["score"].min()))
    shared.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.select("label", _evidence(shared)(F.col("text")).alias("e")).toPandas()
    model.a, model.b = logistic(np.log1p(seen["e"].to_numpy(float)), seen["label"].to_numpy(float))
    shared.unpersist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope, at least 0, and intercept: Newton's method with a weak ridge, each step halved until it helps, so that labels that one value parts are no trouble."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return 0.0, 20.0 * (share - 0.5)
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * (w @ w) / 2)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + ridge * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-10:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def _best(shared: Broadcast):
    @F.pandas_udf("score double, n long")
    def best(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [shared.value.segments(t) for t in f]
            yield pd.DataFrame([(max((x[0] for x in found), default=0.0), n) for found, n in rows], columns=["score", "n"])

    return best


def _evidence(shared: Broadcast):
    @F.pandas_udf("double")
    def evidence(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for f in frames:
            yield pd.Series([shared.value.evidence(t)[0] for t in f], dtype="float64")

    return evidence


def _judge(shared: Broadcast):
    @F.pandas_udf("score double, passages array<struct<score:double,start:long,end:long>>")
    def judge(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [shared.value.evidence(t) for t in f]
            yield pd.DataFrame({"score": [shared.value.score(e) for e, _ in rows], "passages": [[{"score": x, "start": a, "end": b} for x, a, b in kept] for _, kept in rows]})

    return judge


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The input's columns and ``out``: (score, passages), passages in tokens, end exclusive.

    One row per input row, repeated rows too; empty tables give none. Null and empty texts have no passage and the score of no
    evidence. A column of the name ``out`` is replaced. Texts are scanned whole, where they are; nothing is shuffled. The model's tokens are bounded
    by Settings.vocabulary, which bounds what is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.drop(out).withColumn(out, _judge(shared)(F.col(f"`{text}`")))
