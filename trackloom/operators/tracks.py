"""Operators over track frames: rows (video_id, track_id, class_id, frame_id, x1, y1, x2, y2), unique by track and frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

TRACK = ["video_id", "track_id"]
BOX = ["x1", "y1", "x2", "y2"]


def by_track(keys: list[str] | None = None, order: str = "frame_id") -> Window:
    return Window.partitionBy(*(keys or TRACK)).orderBy(order)


def area_profile(frames: DataFrame, min_area: float = 1.0, min_track_frames: int = 5) -> DataFrame:
    """One row per track: n_valid, and median, p10, p90 and MAD of the areas of at least min_area; zeros for a track with fewer than min_track_frames of them."""
    sized = frames.select(*TRACK, G.area(G.Box.of()).alias("area"))
    valid = F.when(F.col("area") >= min_area, F.col("area"))
    at = lambda q: F.percentile(valid, F.lit(q))
    stats = sized.groupBy(*TRACK).agg(F.count(valid).alias("n_valid"), at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"))
    gap = F.when(F.col("area") >= min_area, F.abs(F.col("area") - F.col("median")))
    mad = sized.join(stats.select(*TRACK, "median"), TRACK).groupBy(*TRACK).agg(F.percentile(gap, F.lit(0.5)).alias("mad"))
    enough = F.col("n_valid") >= min_track_frames
    return stats.join(mad, TRACK).select(*TRACK, "n_valid", *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in ("median", "p10", "p90", "mad")])


def flag_areas(frames: DataFrame, min_area: float = 1.0, min_track_frames: int = 5, high: float = 3.0, low: float = 0.3, jump: float = 2.0, jump_abs: float = 500.0, z: float = 6.0) -> DataFrame:
    """Each row of a profiled track with area, ratio, robust_z, change and reasons; change is against the last valid area before the row."""
    profile = area_profile(frames, min_area, min_track_frames).where(F.col("n_valid") >= min_track_frames)
    rows = frames.select(*TRACK, "frame_id", G.area(G.Box.of()).alias("area")).join(profile, TRACK)
    before = by_track().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous", F.last(F.when(F.col("area") >= min_area, F.col("area")), ignorenulls=True).over(before))
    area, med = F.col("area"), F.col("median")
    rows = rows.withColumns({
        "ratio": F.when(med > 0, area / med).otherwise(0.0),
        "robust_z": F.when(F.col("mad") > 0, 0.6745 * (area - med) / F.col("mad")).otherwise(0.0),
        "change": F.when(F.col("previous") > 0, F.greatest(area, F.col("previous")) / F.greatest(F.least(area, F.col("previous")), F.lit(1e-9))),
    })
    degenerate = area < min_area
    reasons = F.array_compact(F.array(
        F.when(degenerate, F.lit("degenerate_area")).when(F.col("ratio") >= high, F.lit("high_area_ratio")).when(F.col("ratio") <= low, F.lit("low_area_ratio")),
        F.when(~degenerate & (F.col("change") >= jump) & (F.abs(area - F.col("previous")) >= jump_abs), F.lit("frame_area_jump")),
        F.when(~degenerate & (F.abs("robust_z") >= z), F.lit("robust_z")),
    ))
    return rows.withColumn("reasons", reasons)


def group_segments(flagged: DataFrame, max_gap: int = 2) -> DataFrame:
    """Suspicious rows grouped where at most max_gap frames lie between them."""
    w = by_track()
    rows = flagged.where(F.size("reasons") > 0)
    fresh = F.coalesce((F.col("frame_id") - F.lag("frame_id").over(w) > max_gap + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("segment", F.sum(fresh).over(w))
    return rows.groupBy(*TRACK, "segment").agg(
        F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("n_frames"),
        F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"),
        F.max("change").alias("max_change"), F.max(F.abs("robust_z")).alias("max_abs_z"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
    )


def area_anomalies(frames: DataFrame, max_gap: int = 2, **params: float) -> tuple[DataFrame, DataFrame]:
    """(profiles, segments)."""
    few = {k: v for k, v in params.items() if k in ("min_area", "min_track_frames")}
    return area_profile(frames, **few), group_segments(flag_areas(frames, **params), max_gap)


def smooth_tracks(frames: DataFrame, videos: DataFrame, window: int) -> DataFrame:
    """Centred moving average by row position, then clipped; a box that clipping would lose stays as it was before. Nothing happens for windows of one or less and tracks of one frame."""
    if window <= 1:
        return frames
    r = window // 2
    near = by_track().rowsBetween(-r, r)
    rows = frames.withColumns({f"s_{c}": F.avg(c).over(near) for c in BOX} | {"__n": F.count("*").over(Window.partitionBy(*TRACK))})
    rows = rows.join(videos.select("video_id", "width", "height"), "video_id")
    clipped = G.clip_bbox(G.Box.of("s_"), F.col("width"), F.col("height"))
    return rows.withColumn("__c", clipped).select(*[c for c in frames.columns if c not in BOX], *[F.when(F.col("__n") > 1, F.coalesce(F.col("__c")[c], F.col(c))).otherwise(F.col(c)).alias(c) for c in BOX])


def _between(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Linear boxes for the frames first..last between each row and the next one (columns n_*)."""
    filled = rows.where(first <= last).withColumn("__f", F.explode(F.sequence(first, last)))
    t = (F.col("__f") - F.col("frame_id")) / (F.col("n_frame_id") - F.col("frame_id"))
    box = G.interpolate_bbox(G.Box.of(), G.Box.of("n_"), t)
    return filled.select(*TRACK, "class_id", F.col("__f").alias("frame_id"), *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


def _with_next(frames: DataFrame) -> DataFrame:
    w = by_track()
    return frames.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame_id", *BOX)})


def interpolate_short_gaps(frames: DataFrame, max_gap: int) -> tuple[DataFrame, DataFrame]:
    """(frames with gaps of fewer than max_gap missing frames filled, one row per filled gap)."""
    rows = _with_next(frames.select(*TRACK, "class_id", "frame_id", *BOX))
    missing = F.col("n_frame_id") - F.col("frame_id") - 1
    gaps = rows.where((missing > 0) & (missing < max_gap))
    filled = _between(gaps, F.col("frame_id") + 1, F.col("n_frame_id") - 1)
    out = frames.select(*TRACK, "class_id", "frame_id", *BOX, F.lit(False).alias("filled")).unionByName(filled.withColumn("filled", F.lit(True)))
    return out, gaps.select(*TRACK, F.col("frame_id").alias("from_frame"), F.col("n_frame_id").alias("to_frame"), missing.alias("missing"))


def interpolate_range(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (video_id, track_id, frame_a, frame_b): linear boxes between two frames that the track has, in place of what lies between."""
    ends = edits.select(*TRACK, F.least("frame_a", "frame_b").alias("a"), F.greatest("frame_a", "frame_b").alias("b"))
    start = frames.join(ends, TRACK).where("frame_id = a")
    stop = frames.select(*TRACK, F.col("frame_id").alias("b"), *[F.col(c).alias(f"n_{c}") for c in BOX])
    both = start.join(stop, [*TRACK, "b"]).withColumn("n_frame_id", F.col("b"))
    new = _between(both, F.col("a") + 1, F.col("b") - 1)
    return frames.select(*TRACK, "class_id", "frame_id", *BOX).join(new.select(*TRACK, "frame_id"), [*TRACK, "frame_id"], "left_anti").unionByName(new)


def densify(frames: DataFrame, videos: DataFrame, pad: int) -> DataFrame:
    """Every frame from the first less pad to the last plus pad, within the video: linear inside, held at the ends."""
    w = by_track()
    rows = _with_next(frames.select(*TRACK, "class_id", "frame_id", *BOX)).withColumn("__first", F.lag("frame_id").over(w).isNull())
    rows = rows.join(videos.select("video_id", (F.col("frame_count") - 1).alias("top")), "video_id")
    is_last = F.col("n_frame_id").isNull()
    lo = F.when(F.col("__first"), F.greatest(F.col("frame_id") - pad, F.lit(0))).otherwise(F.col("frame_id"))
    hi = F.when(is_last, F.least(F.col("frame_id") + pad, F.greatest("top", "frame_id"))).otherwise(F.col("n_frame_id") - 1)
    rows = rows.where(lo <= hi).withColumn("__f", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    t = F.when(is_last | (F.col("__f") < F.col("frame_id")), F.lit(0.0)).otherwise((F.col("__f") - F.col("frame_id")) / (F.col("n_frame_id") - F.col("frame_id")))
    box = [F.col(c) + F.coalesce((F.col(f"n_{c}") - F.col(c)) * t, F.lit(0.0)) for c in BOX]
    return rows.select(*TRACK, "class_id", F.col("__f").alias("frame_id"), *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


def tracklet_quality(frames: DataFrame, seen: Column | None = None) -> DataFrame:
    """n, jitter (mean jump of the centre), quality = n / (1 + jitter), and the class seen most, the first of equals; ``seen`` says in which order frames were, by default that of their numbers."""
    w = by_track()
    cx, cy = G.center(G.Box.of())
    rows = frames.withColumns({"cx": cx, "cy": cy}).withColumn("jump", F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)))
    stats = rows.groupBy(*TRACK).agg(F.count("*").alias("n"), F.coalesce(F.avg("jump"), F.lit(0.0)).alias("jitter"))
    votes = frames.groupBy(*TRACK, "class_id").agg(F.count("*").alias("c"), F.min(F.col("frame_id") if seen is None else seen).alias("f"))
    best = votes.groupBy(*TRACK).agg(F.max_by("class_id", F.struct("c", -F.col("f"))).alias("class_id"))
    return stats.withColumn("quality", F.col("n") / (1 + F.col("jitter"))).join(best, TRACK)


def clip_plan(frames: DataFrame, videos: DataFrame, pad: int, margin: float, least: int) -> DataFrame:
    """Per track: the even clip size that holds its widest box with a margin, and the padded first and last frame."""
    size = lambda a, b: G.make_even(F.greatest(F.ceil(F.max(F.col(b) - F.col(a)) * margin), F.lit(least)))
    ends = frames.groupBy(*TRACK).agg(size("x1", "x2").alias("clip_w"), size("y1", "y2").alias("clip_h"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))
    ends = ends.join(videos.select("video_id", "frame_count"), "video_id")
    top = F.greatest(F.col("frame_count") - 1, F.col("last"))
    return ends.select(*TRACK, "clip_w", "clip_h", F.greatest(F.col("first") - pad, F.lit(0)).alias("start_frame"), F.least(F.col("last") + pad, top).alias("end_frame"))


def track_listing(frames: DataFrame) -> DataFrame:
    """Per track: first and last frame, how many, their list, the median area, and how many segments have abnormal areas."""
    listed = frames.groupBy(*TRACK).agg(
        F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("*").alias("num_frames"),
        F.percentile(G.area(G.Box.of()), F.lit(0.5)).alias("median_area"), F.sort_array(F.collect_list("frame_id")).alias("frame_ids"),
    )
    found = area_anomalies(frames)[1].groupBy(*TRACK).agg(F.count("*").alias("area_anomaly_count"))
    return listed.join(found, TRACK, "left").fillna(0, ["area_anomaly_count"])


def edit_tracks(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (video_id, track_id, op, frame_a, frame_b) of the ops delete_frame (a), delete_after (> a), delete_before (< a), delete_between (a..b, either order) and delete_track. Edits join by track; a frame that any of them deletes goes."""
    gone = frames.join(edits, TRACK).where(
        (F.col("op") == "delete_track") | ((F.col("op") == "delete_frame") & (F.col("frame_id") == F.col("frame_a")))
        | ((F.col("op") == "delete_after") & (F.col("frame_id") > F.col("frame_a"))) | ((F.col("op") == "delete_before") & (F.col("frame_id") < F.col("frame_a")))
        | ((F.col("op") == "delete_between") & F.col("frame_id").between(F.least("frame_a", "frame_b"), F.greatest("frame_a", "frame_b")))
    ).select(*TRACK, "frame_id")
    return frames.join(gone, [*TRACK, "frame_id"], "left_anti")


def merge_tracks(frames: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (video_id, into_id, from_id): from_id's frames go to into_id, which wins on frames that both have."""
    m = merges.select("video_id", F.col("from_id").alias("track_id"), "into_id")
    moved = frames.join(m, TRACK, "left")
    rows = moved.withColumn("__own", F.col("into_id").isNull()).withColumn("track_id", F.coalesce("into_id", "track_id")).drop("into_id")
    best = Window.partitionBy(*TRACK, "frame_id").orderBy(F.desc("__own"))
    return rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "__own")


def split_tracks(frames: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits (video_id, track_id, frame): later frames get a new id, past the video's largest, in the order of the ids split."""
    top = frames.groupBy("video_id").agg(F.max("track_id").alias("top"))
    fresh = splits.withColumn("__k", F.row_number().over(Window.partitionBy("video_id").orderBy("track_id"))).join(top, "video_id")
    rows = frames.join(fresh, TRACK, "left")
    return rows.withColumn("track_id", F.when(F.col("frame_id") > F.col("frame"), F.col("top") + F.col("__k")).otherwise(F.col("track_id"))).select(*frames.columns)


def append_tracks(base: DataFrame, extra: DataFrame, class_override: int | None = None) -> DataFrame:
    """The extra tracks after the base's, renumbered by id from the video's largest id on."""
    top = base.groupBy("video_id").agg(F.max("track_id").alias("top"))
    ids = extra.select(*TRACK).distinct().withColumn("__k", F.row_number().over(Window.partitionBy("video_id").orderBy("track_id")))
    new = extra.join(ids, TRACK).join(top, "video_id", "left").withColumn("track_id", (F.coalesce("top", F.lit(0)) + F.col("__k")).cast("bigint"))
    if class_override is not None:
        new = new.withColumn("class_id", F.lit(class_override))
    return base.unionByName(new.select(*base.columns))


def frames_between(frames: DataFrame, start: int, count: int) -> DataFrame:
    """Per frame of the range, the boxes in track order."""
    rows = frames.where(F.col("frame_id").between(start, start + count - 1))
    return rows.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "class_id", *BOX))).alias("boxes"))


def meetings(rows: DataFrame, meets: Callable[[Column, Column], Column], least: int = 3, iou: float = 0.0, quality: bool = False) -> DataFrame:
    """(video_id, a, b, n, mean_iou, end_gap, mean_diag) of the tracklets of rows (video_id, t, frame_id, box), t naming a tracklet: pairs for which ``meets`` holds, with ``least`` common frames or more and a mean_iou of ``iou`` or more.

    Each tracklet is paired with itself, too: a = b, and n are its frames. ``quality`` adds start, a's first frame, and jitter, the mean
    jump of its centre. The rows are shuffled once, by video, as frames, pairs and tracklets all lie within one: a frame's boxes
    come together as a list, which its pairs are read from, and a pair's frames are summed up where they are. A video is one
    task's; its sorts and sums spill, and what is held are a frame's boxes.
    """
    dealt = rows.select("video_id", "t", "frame_id", *BOX).repartition("video_id")
    more = ["jitter"] if quality else []
    if quality:
        cx, cy = G.center(G.Box.of())
        w = by_track(["video_id", "t"])
        jumps = dealt.withColumns({"cx": cx, "cy": cy}).withColumn("jump", F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)))
        dealt = jumps.withColumn("jitter", F.coalesce(F.avg("jump").over(Window.partitionBy("video_id", "t")), F.lit(0.0)))
    frames = dealt.groupBy("video_id", "frame_id").agg(F.collect_list(F.struct("t", *BOX, *more)).alias("boxes"))
    pairs = frames.select("video_id", "frame_id", "boxes", F.posexplode("boxes").alias("i", "a")).select("video_id", "frame_id", "i", "a", F.posexplode("boxes").alias("j", "b"))
    known = F.col("video_id").isNotNull() & F.col("frame_id").isNotNull()
    met = pairs.where((F.col("i") == F.col("j")) | (known & meets(F.col("a.t"), F.col("b.t"))))
    a, b = G.unpack(F.col("a")), G.unpack(F.col("b"))
    (ax, ay), (bx, by) = G.center(a), G.center(b)
    diag = (F.hypot(a.x2 - a.x1, a.y2 - a.y1) + F.hypot(b.x2 - b.x1, b.y2 - b.y1)) / 2
    own = {"start": F.min("frame_id"), "jitter": F.max("a.jitter")} if quality else {}
    met = met.withColumns({"iou": G.iou(a, b), "gap": F.hypot(ax - bx, ay - by), "diag": diag})
    out = met.groupBy("video_id", F.col("a.t").alias("a"), F.col("b.t").alias("b")).agg(
        F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), ((F.min_by("gap", "frame_id") + F.max_by("gap", "frame_id")) / 2).alias("end_gap"), F.avg("diag").alias("mean_diag"),
        *[v.alias(c) for c, v in own.items()],
    )
    return out.where((F.col("a") == F.col("b")) | ((F.col("n") >= least) & (F.col("mean_iou") >= iou)))


def rated(met: DataFrame) -> DataFrame:
    """``meetings`` with overlap_ratio, the share of the shorter tracklet, normalized_gap and score. All are of one video, so nothing is shuffled."""
    length = lambda c: F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).over(Window.partitionBy("video_id", c))
    out = met.withColumn("__a", length("a")).withColumn("__b", length("b"))
    out = out.withColumns({"overlap_ratio": F.col("n") / F.least("__a", "__b"), "normalized_gap": F.col("end_gap") / F.greatest("mean_diag", F.lit(1.0))}).drop("__a", "__b")
    return out.withColumn("score", F.col("mean_iou") * F.col("overlap_ratio"))


def two_sides(fwd: DataFrame, bwd: DataFrame) -> DataFrame:
    """The rows of both passes for ``meetings``: t = (back, i), forward tracklets coming first."""
    side = lambda df, back: df.select("video_id", F.struct(F.lit(back).alias("back"), F.col("tracklet_idx").alias("i")).alias("t"), "frame_id", *BOX)
    return side(fwd, False).unionByName(side(bwd, True))


def pair_overlap(fwd: DataFrame, bwd: DataFrame, least: int = 3, apart: bool = False, iou: float = 0.0) -> DataFrame:
    """Forward and backward tracklets (video_id, tracklet_idx, frame_id, box) with ``least`` common frames or more, and of a mean_iou of ``iou`` or more. ``apart``: only pairs whose first tracklet_idx is the smaller."""
    meets = lambda a, b: ~a["back"] & b["back"] & ((a["i"] < b["i"]) if apart else F.lit(True))
    out = rated(meetings(two_sides(fwd, bwd), meets, least, iou)).where("a <> b")
    return out.select("video_id", F.col("a.i").alias("f_idx"), F.col("b.i").alias("b_idx"), "n", "mean_iou", "overlap_ratio", "end_gap", "mean_diag", "normalized_gap", "score")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best score; the smaller index wins ties."""
    f = Window.partitionBy("video_id", "f_idx").orderBy(F.desc("score"), "b_idx")
    b = Window.partitionBy("video_id", "b_idx").orderBy(F.desc("score"), "f_idx")
    return pairs.withColumns({"__f": F.row_number().over(f), "__b": F.row_number().over(b)}).where("__f = 1 and __b = 1").drop("__f", "__b")
