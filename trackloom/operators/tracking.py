"""Order-dependent operators: passes along videos in both directions, and repairs along a track."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.ordering import forget, stored

BOX = ["x1", "y1", "x2", "y2"]
#: The pipeline's configured thresholds. A key that the caller sets to None is absent: each method then falls back to its own value.
DEFAULTS = {
    "iou_match": 0.3, "max_missed": 15, "disable_kalman": False, "class_agnostic": False, "score_high": 0.5, "score_low": 0.1, "new_track_score": 0.6,
    "match_iou": 0.3, "low_iou_match": 0.15, "recover_iou_match": 0.05, "velocity_weight": 0.2, "velocity_min_score": 0.6, "height_weight": 0.08, "score_weight": 0.06,
    "fuse_score": True, "cbiou_small_buffer": 0.08, "cbiou_large_buffer": 0.28, "cbiou_second_iou": 0.15, "sparse_depth_bins": 4, "sparse_neighbor_bins": 1,
    "sparse_depth_weight": 0.15, "sparse_height_weight": 0.5, "sparse_cross_depth_iou": 0.75,
}
PROCESS_NOISE, MEASUREMENT_NOISE = np.float32(1e-2), np.float32(1e-1)


def _sizes(b: np.ndarray) -> np.ndarray:
    """Boxes as (cx, cy, w, h)."""
    return np.stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, np.maximum(b[:, 2] - b[:, 0], 0), np.maximum(b[:, 3] - b[:, 1], 0)], axis=1)


def _corners(m: np.ndarray, floor: float = 0.0) -> np.ndarray:
    half = np.maximum(m[:, 2:4], floor) / 2
    return np.concatenate([m[:, :2] - half, m[:, :2] + half], axis=1).astype(float)


@dataclass
class Detections:
    """Detections of one frame in each of some lanes, sorted by lane; ``at`` are their places in their frame."""

    lane: np.ndarray
    at: np.ndarray
    boxes: np.ndarray
    scores: np.ndarray
    classes: np.ndarray

    def where(self, rows: np.ndarray) -> Detections:
        return Detections(self.lane[rows], self.at[rows], self.boxes[rows], self.scores[rows], self.classes[rows])


#: A live track's columns and what they hold: (name, numbers in each row, kind).
STATE = (
    ("lane", 1, np.int64), ("number", 1, np.int64), ("classes", 1, np.int64), ("misses", 1, np.int64), ("frame", 1, np.int64), ("seen", 1, np.int64), ("state", 8, np.float32),
    ("cov", 3, np.float32), ("predicted", 4, np.float64), ("last", 4, np.float64), ("before", 4, np.float64), ("measured", 4, np.float64),
)


class Tracks:
    """The live tracks of all lanes, one row of each array for a track, those of a lane in the order of their creation.

    The motion model is a Kalman filter of constant velocity over (cx, cy, w, h). Its noises and start covariance are the same for
    the four axes, so their covariances stay equal: three numbers a track.
    """

    def __init__(self, kalman: bool):
        self.kalman = kalman
        for name, width, kind in STATE:
            setattr(self, name, np.empty((0, width) if width > 1 else 0, kind))

    def __len__(self) -> int:
        return len(self.number)

    def keep(self, mask: np.ndarray) -> None:
        for name, _, _ in STATE:
            setattr(self, name, getattr(self, name)[mask])

    def add(self, numbers: np.ndarray, d: Detections, frame: int) -> None:
        n, m = len(d.at), _sizes(d.boxes)
        new = {
            "lane": d.lane, "number": numbers, "classes": d.classes, "misses": np.zeros(n), "frame": np.full(n, frame), "seen": np.ones(n), "state": np.concatenate([m, np.zeros((n, 4))], axis=1),
            "cov": np.tile([1.0, 0.0, 1.0], (n, 1)), "predicted": d.boxes, "last": d.boxes, "before": d.boxes, "measured": m,
        }
        for name, _, kind in STATE:
            setattr(self, name, np.concatenate([getattr(self, name), new[name].astype(kind)]))

    def predict(self, at: np.ndarray) -> None:
        state = self.state[at]
        state[:, :4] += state[:, 4:]
        if self.kalman:
            a, b, c = self.cov[at].T
            self.cov[at] = np.stack([a + 2 * b + c + PROCESS_NOISE, b + c, c + PROCESS_NOISE], axis=1)
        else:
            state[:, 2:4] = np.maximum(state[:, 2:4], 1)
        self.state[at], self.predicted[at] = state, _corners(state, 1.0)

    def update(self, i: np.ndarray, d: Detections, frame: int, from_observations: bool) -> np.ndarray:
        """The smoothed boxes of the tracks i, which the detections were given to."""
        m = _sizes(d.boxes)
        if self.kalman:
            a, b, c = self.cov[i].T
            gain = np.stack([a, b], axis=1) / (a + MEASUREMENT_NOISE)[:, None]
            off = m.astype(np.float32) - self.state[i, :4]
            self.state[i] += np.concatenate([gain[:, :1] * off, gain[:, 1:] * off], axis=1)
            self.cov[i] = np.stack([a - gain[:, 0] * a, b - gain[:, 0] * b, c - gain[:, 1] * b], axis=1)
            smooth = _corners(self.state[i], 1.0)
        else:
            self.state[i] = np.concatenate([m, m - self.measured[i]], axis=1)
            smooth = _corners(m)
        if from_observations:
            self.state[i, 4:] = (m - _sizes(self.last[i])) / np.maximum(np.abs(frame - self.frame[i]), 1)[:, None]
        self.before[i], self.last[i], self.measured[i], self.predicted[i] = self.last[i], d.boxes, m, smooth
        self.classes[i], self.misses[i], self.frame[i] = d.classes, 0, frame
        self.seen[i] += 1
        return smooth


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The boxes' intersection over union, row by row."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
    union = size(a) + size(b) - both
    return np.where((both > 0) & (union > 0), both / np.maximum(union, 1e-12), 0.0)


def greedy(scores: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The places of one-to-one pairs (i, j) chosen by score; equal scores go by i, then j.

    In rounds: a pair that is the first left of both its ends is taken, and its ends' other pairs go. As the order is total,
    the outcome is that of one pair after another.
    """
    order = np.lexsort((j, i, -scores))
    left, taken = order, []
    while len(left):
        first = lambda x: np.unique(x, return_index=True)[1]
        best = left[np.intersect1d(first(i[left]), first(j[left]), assume_unique=True)]
        taken.append(best)
        left = left[~(np.isin(i[left], i[best]) | np.isin(j[left], j[best]))]
    return np.concatenate(taken) if taken else order


class Step:
    """One frame of some lanes, as the methods see it: tracks, detections, and all pairs of both within a lane.

    ``i`` and ``j`` are the pairs' places among the tracks (``t(column)``) and the detections. A score or a mask of pairs is an
    array over them; ``free_tracks`` and ``free_detections`` say which ends no pair has taken yet.
    """

    def __init__(self, tracks: Tracks, at: np.ndarray, d: Detections, config: dict, forward: np.ndarray):
        self.d, self.config, self._tracks, self._at, self._forward = d, config, tracks, at, forward
        lanes = tracks.lane[at]
        begin, end = np.searchsorted(lanes, d.lane, "left"), np.searchsorted(lanes, d.lane, "right")
        n = end - begin
        self.j = np.repeat(np.arange(len(d.at)), n)
        self.i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        self.free_tracks, self.free_detections = np.ones(len(at), bool), np.ones(len(d.at), bool)
        self.taken: list[np.ndarray] = []

    def value(self, key: str, fallback: float) -> float:
        return self.config.get(key, fallback)

    def t(self, column: str) -> np.ndarray:
        return getattr(self._tracks, column)[self._at]

    def pairs(self, column: str) -> np.ndarray:
        return self.t(column)[self.i]

    @property
    def boxes(self) -> np.ndarray:
        return self.d.boxes[self.j]

    @property
    def scores(self) -> np.ndarray:
        return self.d.scores[self.j]

    @property
    def iou(self) -> float:
        return self.value("iou_match", 0.3)

    def take(self, scores: np.ndarray, allowed: np.ndarray, detections: np.ndarray | None = None) -> None:
        """Pairs the free tracks with the free detections, or those of the mask ``detections``."""
        some = self.free_detections if detections is None else self.free_detections & detections
        at = np.flatnonzero(allowed & self.free_tracks[self.i] & some[self.j])
        at = at[greedy(scores[at], self.i[at], self.j[at])]
        self.free_tracks[self.i[at]], self.free_detections[self.j[at]] = False, False
        self.taken.append(at)

    def same_class(self) -> np.ndarray:
        return (self.pairs("classes") == self.d.classes[self.j]) | bool(self.value("class_agnostic", False))

    def overlap(self, least: float, fuse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        m = overlaps(self.pairs("predicted"), self.boxes)
        return m * (0.5 + 0.5 * self.scores) if fuse else m, self.same_class() & (m >= least)

    def buffered(self, least: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        def wider(b: np.ndarray) -> np.ndarray:
            m = _sizes(b)
            return _corners(np.concatenate([m[:, :2], m[:, 2:] * (1 + max(0.0, ratio))], axis=1))

        m = overlaps(wider(self.t("predicted"))[self.i], wider(self.d.boxes)[self.j])
        return m * (0.5 + 0.5 * self.scores), self.same_class() & (m >= least)

    def direction(self) -> np.ndarray:
        """(cosine + 1) / 2 of a track's last move and the way to a detection; 0.5 where either is unknown. A backward pass knows no earlier observation."""
        here = _sizes(self.t("last"))[:, :2]
        move = here - _sizes(self.t("before"))[:, :2]
        fast = np.hypot(move[:, 0], move[:, 1])
        way = _sizes(self.boxes)[:, :2] - here[self.i]
        far = np.hypot(way[:, 0], way[:, 1])
        known = (far > 1e-6) & ((fast > 1e-6) & (self.t("seen") > 1) & self._forward[self.t("lane")])[self.i]
        cosine = (way * move[self.i]).sum(axis=1) / np.maximum(far * fast[self.i], 1e-12)
        return np.where(known, (np.clip(cosine, -1, 1) + 1) / 2, 0.5)

    def observed(self, least: float, velocity: float, minimum: float) -> tuple[np.ndarray, np.ndarray]:
        """The better overlap of prediction and last observation, with the direction and less for misses. A small overlap will do where the direction fits."""
        m, way = np.maximum(overlaps(self.pairs("predicted"), self.boxes), overlaps(self.pairs("last"), self.boxes)), self.direction()
        recovered = (m >= self.value("recover_iou_match", max(0.01, least * 0.25))) & (way >= self.value("velocity_min_score", minimum))
        return m + self.value("velocity_weight", velocity) * way - 0.01 * self.pairs("misses"), self.same_class() & ((m >= least) | recovered)

    def hybrid(self, least: float, velocity: float = 0.18, height: float = 0.08, weight: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
        scores, allowed = self.observed(least, velocity, 0.58)
        a, b = _sizes(self.t("last"))[:, 3][self.i], _sizes(self.d.boxes)[:, 3][self.j]
        alike = np.maximum(np.minimum(a, b), 1) / np.maximum(np.maximum(a, b), 1)
        return scores + self.value("height_weight", height) * alike + self.value("score_weight", weight) * self.scores, allowed

    def depths(self, b: np.ndarray) -> np.ndarray:
        return b[:, 3] + max(0.0, self.value("sparse_height_weight", 0.5)) * _sizes(b)[:, 3]


def _sort(p: Step) -> np.ndarray:
    """Overlap alone decides, whatever the class or score; every detection left starts a track."""
    m = overlaps(p.pairs("predicted"), p.boxes)
    p.take(m, m >= p.iou)
    return np.ones(len(p.d.at), bool)


def _two_stages(p: Step, first: Callable, second: Callable) -> np.ndarray:
    """High scores first, low ones on the tracks left; only high scores of enough weight start tracks."""
    high = p.d.scores >= p.value("score_high", p.value("track_thresh", 0.5))
    p.take(*first(p.value("match_iou", p.iou)), high)
    p.take(*second(p.value("low_iou_match", max(0.1, p.iou * 0.5))), ~high & (p.d.scores >= p.value("score_low", 0.1)))
    return high & (p.d.scores >= p.value("new_track_score", p.value("new_track_thresh", p.value("score_high", 0.5))))


def _bytetrack(p: Step) -> np.ndarray:
    return _two_stages(p, p.overlap, p.overlap)


def _bot_sort(p: Step) -> np.ndarray:
    return _two_stages(p, lambda least: p.overlap(least, bool(p.value("fuse_score", True))), p.hybrid)


def _hybrid_sort(p: Step) -> np.ndarray:
    return _two_stages(p, p.hybrid, p.hybrid)


def _usable(p: Step) -> tuple[np.ndarray, np.ndarray]:
    """Detections that may be matched, and those that may start tracks, of the methods without a second stage for low scores."""
    low = p.d.scores >= p.value("score_low", 0.0)
    return low, low & (p.d.scores >= p.value("new_track_score", p.value("score_high", 0.5)))


def _oc_sort(p: Step) -> np.ndarray:
    low, fresh = _usable(p)
    p.take(*p.observed(p.iou, 0.2, 0.6), low)
    return fresh


def _deep_oc_sort(p: Step) -> np.ndarray:
    low, fresh = _usable(p)
    p.take(*p.hybrid(p.iou, 0.24, 0.06, 0.04), low)
    return fresh


def _cbiou(p: Step) -> np.ndarray:
    """Slightly widened boxes first, then much wider ones for what is left."""
    low, fresh = _usable(p)
    p.take(*p.buffered(p.iou, p.value("cbiou_small_buffer", 0.08)), low)
    p.take(*p.buffered(p.value("cbiou_second_iou", max(0.05, p.iou * 0.5)), p.value("cbiou_large_buffer", 0.28)), low)
    return fresh


def _sparse_track(p: Step) -> np.ndarray:
    """Level by level from the nearest depth on, tracks of neighbouring levels included; then what overlaps well at any depth. Levels are a lane's own."""
    low, fresh = _usable(p)
    bins, beside = max(1, int(p.value("sparse_depth_bins", 4))), max(0, int(p.value("sparse_neighbor_bins", 1)))
    of_tracks, of_detections, lanes = p.depths(p.t("predicted")), p.depths(p.d.boxes), p.t("lane")
    every, where = np.concatenate([of_tracks, of_detections[low]]), np.concatenate([lanes, p.d.lane[low]])
    names, place = np.unique(where, return_inverse=True)
    top, bottom = np.full(len(names) + 1, -np.inf), np.full(len(names) + 1, np.inf)
    np.maximum.at(top, place, every)
    np.minimum.at(bottom, place, every)
    own = lambda lane: np.where(np.isin(lane, names), np.searchsorted(names, lane), len(names))  # noqa: E731  the last one: nothing there that could match

    def level(depth: np.ndarray, lane: np.ndarray) -> np.ndarray:
        hi, span = top[own(lane)], np.maximum(top[own(lane)] - bottom[own(lane)], 0)
        within = np.floor((hi - depth) / np.where(span > 0, span, 1) * bins)
        return np.where((span > 0) & (bins > 1), np.clip(within, 0, bins - 1), 0).astype(int)

    t_level, d_level = level(of_tracks, lanes), level(of_detections, p.d.lane)
    span = np.maximum(top - bottom, 1.0)[own(p.d.lane)][p.j]
    overlap, allowed = p.overlap(p.iou)
    alike = 1 - np.minimum(1, np.abs(of_tracks[p.i] - of_detections[p.j]) / span)
    scores = overlap + p.value("sparse_depth_weight", 0.15) * alike + p.value("score_weight", 0.06) * p.scores
    for k in range(bins):
        p.take(scores, allowed & (np.abs(t_level - k) <= beside)[p.i], low & (d_level == k))
    if (cross := p.value("sparse_cross_depth_iou", 0.75)) > 0:
        p.take(*p.overlap(cross), low)
    return fresh


#: Name -> (step, whether velocities are taken from the observations). A step takes pairs and says which detections may start tracks.
TRACKERS: dict[str, tuple[Callable[[Step], np.ndarray], bool]] = {
    "sort": (_sort, False), "iou_kalman": (_sort, False), "bytetrack": (_bytetrack, False), "oc_sort": (_oc_sort, True), "bot_sort": (_bot_sort, True),
    "hybrid_sort": (_hybrid_sort, True), "deep_oc_sort": (_deep_oc_sort, True), "cbiou": (_cbiou, True), "sparse_track": (_sparse_track, True),
}


def register_tracker(name: str, step: Callable[[Step], np.ndarray], velocity_from_observations: bool = True) -> None:
    TRACKERS[name] = (step, velocity_from_observations)


class Lanes:
    """Passes over many videos side by side. A lane is one video in one direction; ``step`` takes a frame of some lanes, ``taken`` gives the rows since it was asked last.

    What is held are the live tracks, and of each lane how many tracks have begun and ended.
    """

    def __init__(self, method: str, config: dict):
        self.method, self.config = method, config
        self.tracks = Tracks(not config.get("disable_kalman", False))
        self.begun, self.ended, self.forward = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.rows: list[dict] = []

    def open(self, forward: np.ndarray) -> None:
        """New lanes, numbered on from the last."""
        self.begun, self.ended, self.forward = np.append(self.begun, np.zeros(len(forward), np.int64)), np.append(self.ended, np.zeros(len(forward), np.int64)), np.append(self.forward, forward)

    def _rank(self, lane: np.ndarray) -> np.ndarray:
        """Each row's place among those of its lane, in the order given."""
        order = np.argsort(lane, kind="stable")
        own, out = lane[order], np.empty(len(lane), np.int64)
        out[order] = np.arange(len(lane)) - np.searchsorted(own, own)
        return out

    def _assign(self, frame: int, d: Detections, number: np.ndarray, boxes: np.ndarray) -> None:
        if len(d.at):
            self.rows.append({"lane": d.lane, "frame_id": np.full(len(d.at), frame), "det_idx": d.at, "number": number, "class_id": d.classes} | dict(zip(BOX, boxes.T, strict=True)))

    def _end(self, gone: np.ndarray) -> None:
        """Tracks are listed as they end, those that end together in the order of their creation."""
        t, lane = self.tracks, self.tracks.lane[gone]
        if len(lane):
            self.rows.append({"lane": lane, "number": t.number[gone], "misses": t.misses[gone], "tracklet_idx": self.ended[lane] + self._rank(lane)})
            np.add.at(self.ended, lane, 1)
            t.keep(~gone)

    def step(self, frame: int, lanes: np.ndarray, d: Detections) -> None:
        """``lanes`` are those that have the frame, with or without detections."""
        t = self.tracks
        here = np.zeros(len(self.forward), bool)
        here[lanes] = True
        at = np.flatnonzero(here[t.lane])
        at = at[np.argsort(t.lane[at], kind="stable")]
        if not len(at) and not len(d.at):
            return
        find, from_observations = TRACKERS[self.method]
        t.predict(at)
        p = Step(t, at, d, self.config, self.forward)
        fresh = find(p) & p.free_detections
        pairs = np.concatenate(p.taken) if p.taken else np.empty(0, int)
        i, own = at[p.i[pairs]], d.where(p.j[pairs])
        self._assign(frame, own, t.number[i], t.update(i, own, frame, from_observations))
        t.misses[at[p.free_tracks]] += 1
        self._end(t.misses > self.config.get("max_missed", 15))
        if fresh.any():
            new = d.where(fresh)
            numbers = self.begun[new.lane] + self._rank(new.lane) + 1
            np.add.at(self.begun, new.lane, 1)
            self._assign(frame, new, numbers, new.boxes)
            t.add(numbers, new, frame)

    def close(self) -> None:
        self._end(np.ones(len(self.tracks), bool))

    def taken(self) -> pd.DataFrame:
        """A row for each assigned detection, and one without det_idx for each track that ended."""
        rows, self.rows = self.rows, []
        columns = ["lane", "frame_id", "det_idx", "number", "class_id", "misses", "tracklet_idx", *BOX]
        count = [len(r["lane"]) for r in rows]
        missing = lambda n: np.full(n, np.nan)
        return pd.DataFrame({c: np.concatenate([r.get(c, missing(n)) for r, n in zip(rows, count, strict=True)] or [missing(0)]) for c in columns})

    def run(self, lane: np.ndarray, rows: pd.DataFrame) -> None:
        """Rows of whole frames in the order of ``ordinal``, lane and det_idx; a row without det_idx only says that there is its frame."""
        ordinal, frame, real = (rows[c].to_numpy() for c in ("ordinal", "frame_id", "det_idx"))
        boxes, scores = rows[BOX].to_numpy(float), rows["score"].to_numpy(float)
        real = ~pd.isna(real)
        at, classes = (np.where(real, rows[c].to_numpy(float), 0).astype(np.int64) for c in ("det_idx", "class_id"))
        cuts = [0, *(np.flatnonzero(np.diff(ordinal)) + 1), len(rows)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = slice(lo, hi)
            some = np.flatnonzero(real[own]) + lo
            some = some[np.argsort(lane[some], kind="stable")]
            self.step(int(frame[lo]), np.unique(lane[own]), Detections(lane[some], at[some], boxes[some], scores[some], classes[some]))


def configured(method: str, params: dict | None) -> dict:
    if method not in TRACKERS:
        raise ValueError(f"unknown tracker {method!r}; known: {', '.join(sorted(TRACKERS))}")
    return {k: v for k, v in (DEFAULTS | (params or {})).items() if v is not None}


def _passes(rows: DataFrame, method: str, config: dict, keys: list[str]) -> DataFrame:
    """(keys, direction, frame_id, det_idx, number, class_id, box, tracklet_idx, misses): every lane of ``keys`` and direction is passed in order.

    Tasks get whole lanes, sorted by frame, and read them batch by batch: a frame of all of a task's videos is one step, and what a
    task holds are a batch and the live tracks, however long a video is. Rows without a direction are passed in both, by one
    task, so that they are shuffled once and not twice.
    """
    columns = [*keys, "frame_id", "det_idx", "class_id", "score", *BOX]
    if "direction" in rows.columns:  # one bit on the way: texts take most of the time of moving rows in and out of Python
        dealt = rows.select(*columns, (F.col("direction") == "forward").alias("forward")).repartition(*keys, "forward")
    else:
        dealt = rows.select(*columns).repartition(*keys).withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = dealt.withColumn("ordinal", F.when(F.col("forward"), F.col("frame_id")).otherwise(-F.col("frame_id")))
    ordered = dealt.sortWithinPartitions("ordinal", *keys, "forward", "det_idx")
    names = [*keys, "forward"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, codes, known, held = Lanes(method, config), {}, None, None

        def passed(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal known
            group = f.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
            first = f[names].iloc[np.unique(group, return_index=True)[1]]
            found = list(first.itertuples(index=False, name=None))
            new = np.array([k not in codes for k in found], bool)
            if new.any():
                codes.update({k: len(codes) + n for n, k in enumerate(k for k, is_new in zip(found, new, strict=True) if is_new)})
                known = first[new] if known is None else pd.concat([known, first[new]], ignore_index=True)
                own.open(first["forward"].to_numpy(bool)[new])
            own.run(np.array([codes[k] for k in found], np.int64)[group], f)
            return out()

        def out() -> Iterator[pd.DataFrame]:
            rows = own.taken()
            at = rows.pop("lane").to_numpy(np.int64)
            if len(at):
                yield known.take(at).reset_index(drop=True).join(rows)

        for f in batches:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            key = f[["ordinal", *names]]
            last = np.flatnonzero((key != key.iloc[-1]).any(axis=1).to_numpy())
            cut = last[-1] + 1 if len(last) else 0
            held = f.iloc[cut:].reset_index(drop=True)
            if cut:
                yield from passed(f.iloc[:cut].reset_index(drop=True))
        if held is not None:
            yield from passed(held)
            own.close()
            yield from out()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", forward boolean, frame_id bigint, det_idx int, number int, class_id int, misses int, tracklet_idx int, " + ", ".join(f"{c} double" for c in BOX)
    way = F.when(F.col("forward"), "forward").otherwise("backward").alias("direction")
    return ordered.mapInPandas(work, schema).select(*keys, way, "frame_id", "det_idx", "number", "class_id", "misses", "tracklet_idx", *BOX)


def _all_frames(detections: DataFrame, frames: DataFrame | None, *more: str) -> DataFrame:
    rows = detections.select("video_id", *more, F.col("frame_id").cast("bigint").alias("frame_id"), "det_idx", "class_id", "score", *BOX)
    return rows if frames is None else rows.unionByName(frames.select("video_id", *more, "frame_id").distinct(), allowMissingColumns=True)


def _both_ways(detections: DataFrame, frames: DataFrame | None, *more: str) -> DataFrame:
    return _all_frames(detections, frames, *more).withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("backward"))))


def run_tracker(detections: DataFrame, method: str = "sparse_track", params: dict | None = None, frames: DataFrame | None = None) -> DataFrame:
    """(video_id, direction, frame_id, det_idx, tracklet_idx, number, class_id, misses, smoothed box): both directions in one shuffle.

    ``frames``: (video_id, frame_id) of all frames, as tracks grow older in those without a detection, too; by default only frames
    with detections are passed. Each detection is assigned once at most. ``number`` counts a pass's tracks from 1 as they begin,
    ``tracklet_idx`` from 0 as they end, and ``misses`` are those of a tracklet's end, which is known after its rows: a window over
    the tracklet brings it to them. A pass goes along a video, so one task does it, in bounded memory; ``track_segments`` cuts
    videos that take one task too long.
    """
    rows = _passes(_both_ways(detections, frames), method, configured(method, params), ["video_id"])
    w = Window.partitionBy("video_id", "direction", "number")
    ends = rows.withColumn("tracklet_idx", F.max("tracklet_idx").over(w)).withColumn("misses", F.max("misses").over(w))
    return ends.where("det_idx is not null").select("video_id", "direction", "frame_id", "det_idx", "tracklet_idx", "number", "class_id", "misses", *BOX)


def numbered(detections: DataFrame, method: str = "sparse_track", params: dict | None = None, frames: DataFrame | None = None) -> DataFrame:
    """``run_tracker`` with each tracklet's number as its tracklet_idx and without its misses, which are known only as it ends: so its rows needn't meet again. One task passes a video both ways."""
    rows = _passes(_all_frames(detections, frames), method, configured(method, params), ["video_id"])
    return rows.where("det_idx is not null").select("video_id", "direction", "frame_id", "det_idx", F.col("number").alias("tracklet_idx"), "number", "class_id", *BOX)


def track_segments(detections: DataFrame, frames: DataFrame, length: int, method: str = "sparse_track", params: dict | None = None, overlap: int | None = None) -> DataFrame:
    """(video_id, direction, frame_id, det_idx, number, class_id, smoothed box) of videos cut into segments of ``length`` frames, passed side by side and joined at their seams.

    Each pass begins ``overlap`` frames before its segment, by default three times as many as a track may miss, and is of no account
    there: it only finds the tracks that live at the seam. A track of a segment goes on in the track of the next one that it shares
    most detections with in these frames, if that is so from both sides (of equal counts the smaller number). Chains of tracks
    get the number that the whole pass would give, by their first detection. Where all tracks at a seam are found anew within the
    overlap, the numbers are those of ``run_tracker``; boxes may differ by what a filter remembers beyond it.
    """
    config = configured(method, params)
    more = 3 * (int(config.get("max_missed", 15)) + 1) if overlap is None else overlap
    own = F.floor(F.col("frame_id") / length).cast("bigint")
    rows = _both_ways(detections, frames)
    # A segment's frames, and the next one's warm-up: in a forward pass the segments after a frame begin with it, in a backward one those before.
    ahead = F.when(F.col("direction") == "forward", F.sequence(own, F.floor((F.col("frame_id") + more) / length).cast("bigint")))
    behind = F.sequence(F.floor((F.col("frame_id") - more) / length).cast("bigint"), own)
    dealt = rows.withColumn("segment", F.explode(F.coalesce(ahead, behind)))
    passed = _passes(dealt, method, config, ["video_id", "segment"]).where("det_idx is not null")
    scratch: list[str] = []
    passed = stored(passed.withColumn("proper", F.col("segment") == own), scratch)

    way = F.when(F.col("direction") == "forward", 1).otherwise(-1)
    key = ["video_id", "direction"]
    track = [*key, "segment", "number"]
    # Of a track and the ones before it in the pass: those that the same detection was given to.
    before = passed.select(*key, "frame_id", "det_idx", (F.col("segment") + way).alias("segment"), F.col("number").alias("from"))
    shared = passed.join(before, [*key, "frame_id", "det_idx", "segment"]).groupBy(*track, "from").agg(F.count("*").alias("n"))
    mine = Window.partitionBy(*track).orderBy(F.desc("n"), "from")
    theirs = Window.partitionBy(*key, "segment", "from").orderBy(F.desc("n"), "number")
    links = shared.withColumn("a", F.row_number().over(mine)).withColumn("b", F.row_number().over(theirs)).where("a = 1 and b = 1")
    # Each track's head: pointers are doubled until all point at tracks without a predecessor.
    head = passed.select(*track).distinct().join(links.select(*track, "from"), track, "left")
    head = stored(head.select(*track, F.when(F.col("from").isNotNull(), F.col("segment") - way).otherwise(F.col("segment")).alias("h_segment"), F.coalesce("from", "number").alias("h_number")), scratch)
    while True:
        on = head.select(*key, F.col("segment").alias("h_segment"), F.col("number").alias("h_number"), F.col("h_segment").alias("to_segment"), F.col("h_number").alias("to_number"))
        moved = stored(head.join(on, [*key, "h_segment", "h_number"]).select(*track, "to_segment", "to_number", ((F.col("h_segment") != F.col("to_segment")) | (F.col("h_number") != F.col("to_number"))).alias("moved")), scratch)
        head = moved.select(*track, F.col("to_segment").alias("h_segment"), F.col("to_number").alias("h_number"))
        if moved.where("moved").isEmpty():
            break
    joined = passed.where("proper").join(head, track)
    place = F.struct(F.col("frame_id") * way, "det_idx")
    chain = [*key, "h_segment", "h_number"]
    begins = joined.groupBy(*chain).agg(F.min(place).alias("begins"))
    begins = begins.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("begins")))
    out = stored(joined.join(begins, chain).select(*key, "frame_id", "det_idx", F.col("n").alias("number"), "class_id", *BOX))
    forget(detections.sparkSession, scratch)
    return out


def fix_spikes(frames: DataFrame, history: int = 10, min_history: int = 3, area_ratio: float = 4.0, size_ratio: float = 3.0, max_run: int = 10, start_frame: int | None = None, end_frame: int | None = None) -> DataFrame:
    """Frames with abnormal sizes, repaired: the columns video_id, track_id, class_id, frame_id, box, and fixed, run_start, run_end, anchor_before, anchor_after, which are null where nothing was fixed.

    A size is abnormal if area, width or height exceed the medians of the last ``history`` normal ones by their ratio, once there
    are ``min_history``; an area of 0 always is. Abnormal frames outside start_frame..end_frame are left alone and are no
    history either. Runs of at most ``max_run`` abnormal frames with consecutive numbers are interpolated between the nearest
    frames that aren't abnormal, on both sides. Tracks with fewer than min_history + 2 frames stay as they are. What is normal
    depends on what was before it, so a track is read in order, as one group.
    """
    anchors = ("run_start", "run_end", "anchor_before", "anchor_after")

    def middle(past: list[float]) -> float:
        """The median of a handful of numbers, for which np.median takes fifty times as long."""
        if any(v != v for v in past):
            return np.nan
        x, half = sorted(past), len(past) // 2
        return x[half] if len(x) % 2 else (x[half - 1] + x[half]) / 2

    def abnormal(f: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        area, normal = (w * h).tolist(), ([], [], [])  # of the last normal ones: area, width, height
        w, h, f = w.tolist(), h.tolist(), f.tolist()
        odd = np.zeros(len(f), bool)
        for k, size in enumerate(zip(area, w, h, strict=True)):
            if size[0] <= 0:
                odd[k] = True
            elif len(normal[0]) >= min_history and any(x > middle(past) * r for x, past, r in zip(size, normal, (area_ratio, size_ratio, size_ratio), strict=True)):
                odd[k] = (start_frame is None or f[k] >= start_frame) and (end_frame is None or f[k] <= end_frame)
            else:
                for past, x in zip(normal, size, strict=True):
                    past.append(x)
                    del past[: max(len(past) - history, 0) if history else 0]
        return odd

    def work(track: pa.Table) -> pa.Table:  # Arrow, as tracks are many and short, and a pandas frame of each takes longer than its repair
        track = track.take(pa.array(np.argsort(track["frame_id"].to_numpy())))
        b, f = np.stack([track[c].to_numpy().astype(float) for c in BOX], axis=1), track["frame_id"].to_numpy()
        odd = abnormal(f, np.maximum(b[:, 2] - b[:, 0], 0), np.maximum(b[:, 3] - b[:, 1], 0)) if len(f) >= min_history + 2 else np.zeros(len(f), bool)
        found = {c: [None] * len(f) for c in anchors}
        fixed = np.zeros(len(f), bool)
        at, fine = np.flatnonzero(odd), np.flatnonzero(~odd)
        for run in np.split(at, np.flatnonzero(np.diff(f[at]) != 1) + 1) if len(at) else ():
            place = np.searchsorted(fine, run[0])
            if len(run) > max_run or place == 0 or place == len(fine):
                continue
            lo, hi = fine[place - 1], fine[place]
            b[run] = b[lo] + (b[hi] - b[lo]) * ((f[run] - f[lo]) / (f[hi] - f[lo]))[:, None]
            fixed[run] = True
            for c, v in zip(anchors, (f[run[0]], f[run[-1]], f[lo], f[hi]), strict=True):
                for k in run:
                    found[c][k] = int(v)
        own = {c: track[c] for c in ("video_id", "track_id", "class_id", "frame_id")}
        boxes = {c: pa.array(v, from_pandas=True).cast(track.schema.field(c).type) for c, v in zip(BOX, b.T, strict=True)}
        return pa.table(own | boxes | {"fixed": pa.array(fixed)} | {c: pa.array(v, pa.int64()) for c, v in found.items()})

    cols = ["video_id", "track_id", "class_id", "frame_id", *BOX]
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", fixed boolean, " + ", ".join(f"{c} bigint" for c in anchors)
    return frames.select(*cols).groupBy("video_id", "track_id").applyInArrow(work, schema)


def fixed_intervals(fixed: DataFrame) -> DataFrame:
    """(video_id, track_id, run_start, run_end, anchor_before, anchor_after, frames) of each run that fix_spikes repaired."""
    return fixed.where("fixed").groupBy("video_id", "track_id", "run_start", "run_end", "anchor_before", "anchor_after").agg(F.count("*").alias("frames"))
