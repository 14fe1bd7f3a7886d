"""The trackers once more, plainly: a dictionary for each track, whole matrices, one pair at a time. Only for small videos."""

import math

import numpy as np

CONFIG = {
    "iou": 0.3, "patience": 15, "high": 0.5, "low": 0.1, "new": 0.6, "low_iou": 0.15, "recover": 0.05, "velocity": 0.2, "fits": 0.6, "height": 0.08, "score": 0.06,
    "small": 0.08, "large": 0.28, "second_iou": 0.15, "bins": 4, "beside": 1, "depth": 0.15, "depth_height": 0.5, "cross": 0.75,
}
STEP = np.eye(8) + np.eye(8, k=4)
SEE = np.eye(4, 8)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def shape(b):
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])


def box(x):
    w, h = max(x[2], 1), max(x[3], 1)
    return [x[0] - w / 2, x[1] - h / 2, x[0] + w / 2, x[1] + h / 2]


def wider(b, ratio):
    x, y, w, h = shape(b)
    return [x - w * (1 + ratio) / 2, y - h * (1 + ratio) / 2, x + w * (1 + ratio) / 2, y + h * (1 + ratio) / 2]


def direction(t, d):
    seen = sorted(t["seen"])
    here = seen.index(t["frame"])
    if here == 0:
        return 0.5
    a, b, c = (shape(x)[:2] for x in (t["seen"][seen[here - 1]], t["seen"][t["frame"]], d["box"]))
    u, v = b - a, c - b
    if math.hypot(*u) <= 1e-6 or math.hypot(*v) <= 1e-6:
        return 0.5
    return (max(-1, min(1, float(u @ v) / (math.hypot(*u) * math.hypot(*v)))) + 1) / 2


def scores(c):
    """Name -> (track, detection) -> score, or None."""
    same = lambda t, d: t["class"] == d["class"]

    def plain(least, fuse=False, classes=True):
        def f(t, d):
            m = overlap(t["box"], d["box"])
            return None if m < least or classes and not same(t, d) else m * (0.5 + 0.5 * d["score"]) if fuse else m

        return f

    def buffered(least, ratio):
        def f(t, d):
            m = overlap(wider(t["box"], ratio), wider(d["box"], ratio))
            return None if m < least or not same(t, d) else m * (0.5 + 0.5 * d["score"])

        return f

    def observed(least, more=False):
        def f(t, d):
            m, way = max(overlap(t["box"], d["box"]), overlap(t["seen"][t["frame"]], d["box"])), direction(t, d)
            if not same(t, d) or m < least and not (m >= c["recover"] and way >= c["fits"]):
                return None
            out = m + c["velocity"] * way - 0.01 * t["missed"]
            if more:
                a, b = shape(t["seen"][t["frame"]])[3], shape(d["box"])[3]
                out += c["height"] * max(1, min(a, b)) / max(a, b, 1) + c["score"] * d["score"]
            return out

        return f

    return plain, buffered, observed


def match(tracks, found, score):
    every = [(-s, i, j) for i, t in enumerate(tracks) for j, d in enumerate(found) if (s := score(t, d)) is not None]
    used, out = set(), []
    for _, i, j in sorted(every, key=lambda x: x[0]):
        if ("t", i) not in used and ("d", j) not in used:
            used |= {("t", i), ("d", j)}
            out.append((tracks[i], found[j]))
    return out


def without(rows, pairs, side):
    gone = [p[side] for p in pairs]
    return [x for x in rows if not any(x is g for g in gone)]


def matches(method, tracks, found, c):
    """(pairs, detections that may start tracks)."""
    plain, buffered, observed = scores(c)
    low = [d for d in found if d["score"] >= c["low"]]
    fresh = [d for d in low if d["score"] >= c["new"]]
    if method == "sort":
        return match(tracks, found, plain(c["iou"], classes=False)), found
    if method in ("bytetrack", "bot_sort", "hybrid_sort"):
        first = observed(c["iou"], True) if method == "hybrid_sort" else plain(c["iou"], method == "bot_sort")
        second = plain(c["low_iou"]) if method == "bytetrack" else observed(c["low_iou"], True)
        high = [d for d in found if d["score"] >= c["high"]]
        pairs = match(tracks, high, first)
        pairs += match(without(tracks, pairs, 0), [d for d in low if d["score"] < c["high"]], second)
        return pairs, [d for d in high if d["score"] >= c["new"]]
    if method in ("oc_sort", "deep_oc_sort"):
        return match(tracks, low, observed(c["iou"], method == "deep_oc_sort")), fresh
    if method == "cbiou":
        pairs = match(tracks, low, buffered(c["iou"], c["small"]))
        return pairs + match(without(tracks, pairs, 0), without(low, pairs, 1), buffered(c["second_iou"], c["large"])), fresh
    depth = lambda b: b[3] + c["depth_height"] * (b[3] - b[1])
    all_depths = [depth(x["box"]) for x in (*tracks, *low)] or [0.0]
    near, deep = max(all_depths), min(all_depths)
    level = lambda x: 0 if near <= deep else max(0, min(c["bins"] - 1, math.floor((near - depth(x["box"])) / (near - deep) * c["bins"])))
    levels = {id(x): level(x) for x in (*tracks, *low)}

    def sparse(t, d):
        m = plain(c["iou"])(t, d)
        return None if m is None else m + c["depth"] * (1 - min(1, abs(depth(t["box"]) - depth(d["box"])) / max(1, near - deep))) + c["score"] * d["score"]

    pairs = []
    for k in range(c["bins"]):
        some = [t for t in without(tracks, pairs, 0) if abs(levels[id(t)] - k) <= c["beside"]]
        pairs += match(some, [d for d in without(low, pairs, 1) if levels[id(d)] == k], sparse)
    return pairs + match(without(tracks, pairs, 0), without(low, pairs, 1), plain(c["cross"])), fresh


def track(frames, method, forward, config=None):
    """frames: [(frame, [{at, box, score, class}])] in order. {(frame, at): (tracklet_idx, number, box)}"""
    c = CONFIG | (config or {})
    alive, ended, out, n = [], [], {}, 0
    for frame, found in frames if forward else frames[::-1]:
        for t in alive:
            t["x"], t["p"] = STEP @ t["x"], STEP @ t["p"] @ STEP.T + 0.01 * np.eye(8)
            t["box"] = box(t["x"])
        pairs, fresh = matches(method, alive, found, c)
        for t, d in pairs:
            gain = t["p"] @ SEE.T @ np.linalg.inv(SEE @ t["p"] @ SEE.T + 0.1 * np.eye(4))
            t["x"] = t["x"] + gain @ (shape(d["box"]) - t["x"][:4])
            t["p"] = t["p"] - gain @ SEE @ t["p"]
            smooth = box(t["x"])
            if method not in ("sort", "bytetrack"):
                t["x"][4:] = (shape(d["box"]) - shape(t["seen"][t["frame"]])) / max(1, abs(frame - t["frame"]))
            t.update(box=smooth, missed=-1, frame=frame)
            t["class"] = d["class"]
            t["seen"][frame] = d["box"]
            out[frame, d["at"]] = (t, smooth)
        for t in alive:
            t["missed"] += 1
        ended += [t for t in alive if t["missed"] > c["patience"]]
        alive = [t for t in alive if t["missed"] <= c["patience"]]
        for d in without(fresh, pairs, 1):
            n += 1
            t = {"number": n, "class": d["class"], "box": d["box"], "seen": {frame: d["box"]}, "frame": frame, "missed": 0, "x": np.concatenate([shape(d["box"]), np.zeros(4)]), "p": np.eye(8)}
            alive.append(t)
            out[frame, d["at"]] = (t, d["box"])
    place = {id(t): k for k, t in enumerate([*ended, *alive])}
    return {k: (place[id(t)], t["number"], b) for k, (t, b) in out.items()}
