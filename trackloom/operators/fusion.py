"""Fusion of forward and backward tracklets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import graphs, tracking, tracks
from trackloom.operators.joins import iou_join  # noqa: F401  a part of this module's interface
from trackloom.operators.ordering import forget, stored

PAIR = ["video_id", "f_idx", "b_idx"]


def candidate_pairs(fwd: DataFrame, bwd: DataFrame, iou: float, most_gap: float = 1.5) -> DataFrame:
    return tracks.pair_overlap(fwd, bwd, iou=iou).where((F.col("mean_iou") >= iou) & (F.col("normalized_gap") <= most_gap))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(video_id, direction, tracklet_idx, component) of the tracklets in any pair; a video's components are numbered from 1 by their first tracklets, backward ones coming first."""
    node = lambda way, c: F.struct("video_id", F.lit(way).alias("direction"), F.col(c).cast("bigint").alias("tracklet_idx"))
    named = graphs.components(pairs.select(node("forward", "f_idx").alias("a"), node("backward", "b_idx").alias("b")))
    first = Window.partitionBy("root.video_id").orderBy("root")
    numbers = named.select("root").distinct().withColumn("component", F.row_number().over(first).cast("bigint"))
    return named.join(numbers, "root").select("node.*", "component")


def _members(fwd: DataFrame, bwd: DataFrame) -> DataFrame:
    one = lambda df, d: df.select("video_id", F.lit(d).alias("direction"), "tracklet_idx").distinct()
    return one(fwd, "forward").unionByName(one(bwd, "backward"))


def _way(t: str) -> list[Column]:
    return [F.when(F.col(f"{t}.back"), "backward").otherwise("forward").alias("direction"), F.col(f"{t}.i").alias("tracklet_idx")]


def _read(rated: DataFrame, iou: float, most_gap: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, members) of rated meetings of both sides."""
    near = rated.where(~F.col("a.back") & F.col("b.back") & (F.col("mean_iou") >= iou) & (F.col("normalized_gap") <= most_gap))
    return near.select("video_id", F.col("a.i").alias("f_idx"), F.col("b.i").alias("b_idx"), "score"), rated.where("a = b").select("video_id", *_way("a"))


def _matched(fwd: DataFrame, bwd: DataFrame, iou: float, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, members), both of one pass over the frames."""
    met = tracks.meetings(tracks.two_sides(fwd, bwd), lambda a, b: ~a["back"] & b["back"], iou=iou)
    return _read(stored(tracks.rated(met).where((F.col("a") == F.col("b")) | (F.col("normalized_gap") <= 1.5)), scratch), iou)


def _groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Each pair is a component named by its forward tracklet; members outside any pair are alone."""
    f = pairs.select("video_id", F.lit("forward").alias("direction"), F.col("f_idx").alias("tracklet_idx"), F.concat(F.lit("f"), "f_idx").alias("component"))
    b = pairs.select("video_id", F.lit("backward").alias("direction"), F.col("b_idx").alias("tracklet_idx"), F.concat(F.lit("f"), "f_idx").alias("component"))
    key = ["video_id", "direction", "tracklet_idx"]
    return members.join(f.unionByName(b), key, "left").withColumn("component", F.coalesce("component", F.concat(F.substring("direction", 1, 1), "tracklet_idx")))


def _kept(spark: SparkSession, out: DataFrame, scratch: list[str]) -> DataFrame:
    out = stored(out)
    forget(spark, scratch)
    return out


def bidirectional_iou(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    scratch: list[str] = []
    pairs, members = _matched(fwd, bwd, iou, scratch)
    return _kept(fwd.sparkSession, _groups(stored(tracks.mutual_best(pairs).select(*PAIR), scratch), members), scratch)  # each pair names both of its ends


def forward_only(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    return _groups(candidate_pairs(fwd, bwd, iou).limit(0), _members(fwd, bwd).where("direction = 'forward'"))


def backward_only(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    return _groups(candidate_pairs(fwd, bwd, iou).limit(0), _members(fwd, bwd).where("direction = 'backward'"))


def _primary(best: DataFrame, members: DataFrame) -> DataFrame:
    paired = best.select("video_id", F.lit("backward").alias("direction"), F.col("b_idx").alias("tracklet_idx"))
    forward = members.where("direction = 'forward'")
    bare = members.join(forward.select("video_id").distinct(), "video_id", "left_anti")
    return _groups(best, forward.unionByName(paired).unionByName(bare))


def forward_primary(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    """Forward tracklets, with the backward one that is a mutual best; videos without forward tracklets keep all backward ones."""
    scratch: list[str] = []
    pairs, members = _matched(fwd, bwd, iou, scratch)
    return _kept(fwd.sparkSession, _primary(tracks.mutual_best(pairs), members), scratch)


def forward_unique(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    """forward_primary and the backward tracklets that are in no candidate pair."""
    scratch: list[str] = []
    pairs, members = _matched(fwd, bwd, iou, scratch)
    lone = members.where("direction = 'backward'").join(pairs.select("video_id", F.col("b_idx").alias("tracklet_idx")), ["video_id", "tracklet_idx"], "left_anti")
    primary = _primary(tracks.mutual_best(pairs), members)
    lone = lone.select("video_id", "direction", "tracklet_idx", F.concat(F.lit("b"), "tracklet_idx").alias("component"))
    return _kept(fwd.sparkSession, primary.unionByName(lone.join(primary.select("video_id", "direction", "tracklet_idx"), ["video_id", "direction", "tracklet_idx"], "left_anti")), scratch)


def all_pairs(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    scratch: list[str] = []
    pairs, members = _matched(fwd, bwd, iou, scratch)
    key = ["video_id", "direction", "tracklet_idx"]
    named = connected_components(pairs).withColumn("component", F.concat(F.lit("c"), F.col("component").cast("string")))
    return _kept(fwd.sparkSession, members.join(named, key, "left").withColumn("component", F.coalesce("component", F.concat(F.substring("direction", 1, 1), "tracklet_idx"))), scratch)


def nms(fwd: DataFrame, bwd: DataFrame, iou: float) -> DataFrame:
    """bidirectional_iou, of whose components one that overlaps a better one goes; ``position`` is the start frame's order, equals in that of their scores.

    A component's score is its longest tracklet's length, its best quality and a quarter for each tracklet. Two overlap if any
    tracklets of theirs do: mean overlap ``iou``, six tenths of the shorter, a gap of 1.5 diagonals at most. One pass over the frames
    finds these pairs, the candidates and what tracklets are like; what stays is chosen in rounds.
    """
    who = ["video_id", "direction", "tracklet_idx"]
    scratch: list[str] = []
    met = tracks.rated(tracks.meetings(tracks.two_sides(fwd, bwd), lambda a, b: a < b, iou=iou, quality=True))
    met = stored(met.where((F.col("a") == F.col("b")) | (F.col("normalized_gap") <= 1.5)), scratch)
    pairs, every = _read(met, iou)
    members = stored(_groups(stored(tracks.mutual_best(pairs).select(*PAIR), scratch), every))
    quality = met.where("a = b").select("video_id", *_way("a"), "n", (F.col("n") / (1 + F.col("jitter"))).alias("quality"), "start")
    ahead = F.struct((F.col("direction") == "backward").alias("b"), "tracklet_idx")
    scored = members.join(quality, who).groupBy("video_id", "component").agg(
        (F.max("n") + F.max("quality") + 0.25 * F.count("*")).alias("score"), F.min("start").alias("start"), F.min(ahead).alias("ahead")
    )
    close = met.where("a <> b and overlap_ratio >= 0.6").select("video_id", *[F.struct(*_way(c)).alias(f"{c}_idx") for c in "ab"])
    of = lambda c: members.select("video_id", F.struct("direction", "tracklet_idx").alias(f"{c}_idx"), F.col("component").alias(f"{c}_component"))
    meets = close.join(of("a"), ["video_id", "a_idx"]).join(of("b"), ["video_id", "b_idx"]).where("a_component <> b_component")
    beside = meets.select("video_id", F.col("a_component").alias("component"), F.col("b_component").alias("other")).union(meets.select("video_id", "b_component", "a_component")).distinct()
    rank = F.struct("score", (~F.col("ahead.b")).alias("first"), (-F.col("ahead.tracklet_idx")).alias("i"))
    edges = beside.select("video_id", "component", F.col("video_id").alias("other_video_id"), F.col("other").alias("other_component"))
    kept = graphs.chosen_nodes(scored, edges, ["video_id", "component"], rank)
    forget(fwd.sparkSession, scratch)
    place = Window.partitionBy("video_id").orderBy("start", rank.desc())
    stays = kept.select("video_id", "component", (F.row_number().over(place) - 1).cast("bigint").alias("position"))
    return members.join(stays, ["video_id", "component"]).select(*who, "component", "position")


FUSERS: dict[str, Callable[[DataFrame, DataFrame, float], DataFrame]] = {
    "bidirectional_iou": bidirectional_iou,
    "forward_only": forward_only,
    "backward_only": backward_only,
    "bidirectional_iou_forward_primary": forward_primary,
    "bidirectional_iou_forward_unique": forward_unique,
    "bidirectional_iou_all_pairs": all_pairs,
    "bidirectional_iou_nms": nms,
}


def fuse(fwd: DataFrame, bwd: DataFrame, method: str = "bidirectional_iou_all_pairs", iou: float = 0.5) -> DataFrame:
    """(video_id, direction, tracklet_idx, component), and position where the method orders its components itself."""
    if method not in FUSERS:
        raise ValueError(f"unknown fusion method {method!r}; known: {', '.join(sorted(FUSERS))}")
    return FUSERS[method](fwd, bwd, iou)


def merge_components(frames: DataFrame, members: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, component, frame_id, class_id, box): each component's tracklets as one track.

    frames: (video_id, direction, tracklet_idx, frame_id, class_id, box). The class is that of the most frames, of equals that of
    the first tracklet, forward ones coming before backward ones. In each frame the box of the best tracklet leads; boxes that
    overlap it by half, or whose centre is near its own, are averaged with it, and what clipping would lose keeps the leading
    box. A frame of one tracklet only stays as it is.

    A tracklet is a member of one component. Frames and members are shuffled once, together and by video: what a tracklet, a
    component and a frame are told about themselves are windows within it, which spill.
    """
    who = ["video_id", "direction", "tracklet_idx"]
    backward = F.col("direction") == "backward"
    seen = F.when(backward, -F.col("frame_id")).otherwise(F.col("frame_id"))
    every = frames.select(*who, "frame_id", "class_id", *tracks.BOX).unionByName(members.select(*who, "component"), allowMissingColumns=True)
    (x, y), track = G.center(G.Box.of()), Window.partitionBy(*who)
    # A member's own row has no frame and no box, and lies before its tracklet's.
    rows = every.repartition("video_id").withColumn("jump", F.hypot(x - F.lag(x).over(track.orderBy("frame_id")), y - F.lag(y).over(track.orderBy("frame_id"))))
    rows = rows.withColumns({"component": F.max("component").over(track), "quality": F.count("frame_id").over(track) / (1 + F.coalesce(F.avg("jump").over(track), F.lit(0.0)))})
    rows = rows.drop("jump").where("frame_id is not null and component is not null")
    alike = Window.partitionBy(*who, "class_id")
    rows = rows.withColumns({"c": F.count("*").over(alike), "f": F.min(seen).over(alike)}).withColumn("voted", F.max_by("class_id", F.struct("c", -F.col("f"))).over(track)).drop("class_id")
    rows = rows.withColumn("ahead", F.struct(backward.alias("b"), F.col("tracklet_idx").alias("i"))).drop("direction", "tracklet_idx")
    votes = Window.partitionBy("video_id", "component", "voted")
    rows = rows.withColumns({"c": F.count("*").over(votes), "f": F.min("ahead").over(votes)})
    rows = rows.withColumn("class_id", F.min_by("voted", F.struct(-F.col("c"), "f")).over(Window.partitionBy("video_id", "component"))).drop("c", "f", "voted")

    spot = ["video_id", "component", "frame_id"]
    best = Window.partitionBy(*spot).orderBy(F.desc("quality"), "ahead").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({f"p_{c}": F.first(c).over(best) for c in tracks.BOX})
    box, lead = G.Box.of(), G.Box.of("p_")
    px, py = G.center(lead)
    reach = F.greatest(F.lit(5.0), F.hypot(lead.x2 - lead.x1, lead.y2 - lead.y1) / 2)
    near = (G.iou(box, lead) >= 0.5) | (F.hypot(x - px, y - py) <= reach)
    mean = rows.groupBy(*spot, "class_id").agg(F.count("*").alias("n"), *[F.avg(F.when(near, F.col(c))).alias(c) for c in tracks.BOX], *[F.first(f"p_{c}").alias(f"p_{c}") for c in tracks.BOX])
    clipped = mean.join(videos.select("video_id", "width", "height"), "video_id").withColumn("clip", F.when(F.col("n") > 1, G.clip_bbox(box, F.col("width"), F.col("height"))))
    return clipped.select(*spot, "class_id", *[F.coalesce(F.col("clip")[c], F.col(f"p_{c}")).alias(c) for c in tracks.BOX])


def final_tracks(merged: DataFrame, members: DataFrame, videos: DataFrame, least: int = 10, window: int = 5) -> DataFrame:
    """Merged tracks of ``least`` frames or more, smoothed; track_id counts a video's components from 1 by their position, or by their first tracklet: forward ones come before all backward ones."""
    part = ["video_id", "component"]
    place = F.col("position") if "position" in members.columns else F.lit(0)
    order = members.groupBy(*part).agg(F.min(F.struct(place.alias("p"), (F.col("direction") == "backward").alias("b"), "tracklet_idx")).alias("first"))
    # As in merge_components: one shuffle by video, and a component's own row has no frame.
    rows, whole = merged.unionByName(order, allowMissingColumns=True).repartition("video_id"), Window.partitionBy(*part)
    rows = rows.withColumns({"n": F.count("frame_id").over(whole), "first": F.max("first").over(whole)}).where((F.col("n") >= least) & F.col("first").isNotNull() & F.col("frame_id").isNotNull())
    rows = rows.withColumn("track_id", F.dense_rank().over(Window.partitionBy("video_id").orderBy("first")).cast("bigint"))
    return tracks.smooth_tracks(rows.select("video_id", "frame_id", "class_id", *tracks.BOX, "track_id"), videos, window)


#: Methods in which no order of tracklets decides anything, so that a pass's own numbers will do.
UNORDERED = ("forward_only", "backward_only", "bidirectional_iou_all_pairs")


def filter_detections(detections: DataFrame, frames: DataFrame, videos: DataFrame, method: str = "sparse_track", fusion: str = "bidirectional_iou_all_pairs", iou: float = 0.5, least: int = 10, params: dict | None = None) -> DataFrame:
    """The detections that were given to a tracklet of some fused track of ``least`` frames or more; their columns stay as they are."""
    scratch: list[str] = []
    passed = (tracking.numbered if fusion in UNORDERED else tracking.run_tracker)(detections, method, params, frames)
    found = stored(passed.select("video_id", "direction", "tracklet_idx", "frame_id", "det_idx", *tracks.BOX), scratch)  # the pass is dear
    side = lambda way: found.where(F.col("direction") == way).select("video_id", "tracklet_idx", "frame_id", *tracks.BOX)
    members = fuse(side("forward"), side("backward"), fusion, iou)
    # As in merge_components: one shuffle by video, and a member's own row has no detection.
    who, whole = ["video_id", "direction", "tracklet_idx"], Window.partitionBy("video_id", "component")
    rows = found.select(*who, "frame_id", "det_idx").unionByName(members.select(*who, "component"), allowMissingColumns=True).repartition("video_id")
    rows = rows.withColumn("component", F.max("component").over(Window.partitionBy(*who))).where("det_idx is not null and component is not null")
    first = F.row_number().over(Window.partitionBy("video_id", "component", "frame_id").orderBy("det_idx")) == 1
    long = rows.withColumn("first", first).withColumn("n", F.count(F.when(F.col("first"), 1)).over(whole)).where(F.col("n") >= least)
    # A frame's list meets its detections, which are often dealt by frame already; as a file the lists are small, as rows they are not.
    kept = stored(long.groupBy("video_id", F.col("frame_id").cast(dict(detections.dtypes)["frame_id"]).alias("frame_id")).agg(F.collect_set("det_idx").alias("__kept")))
    forget(detections.sparkSession, scratch)
    return detections.join(kept.hint("merge"), ["video_id", "frame_id"]).where(F.array_contains("__kept", F.col("det_idx"))).select(*detections.columns)


def filter_counts(detections: DataFrame, kept: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, frame_id, n_in, n_out, removed) of every frame, as each input file has an output file."""
    spot = ["video_id", "frame_id"]
    count = lambda df, c: df.groupBy(*spot).agg(F.count("*").alias(c))
    both = frames.select(*spot).distinct().join(count(detections, "n_in"), spot, "left").join(count(kept, "n_out"), spot, "left").fillna(0, ["n_in", "n_out"])
    return both.withColumn("removed", F.col("n_in") - F.col("n_out"))
