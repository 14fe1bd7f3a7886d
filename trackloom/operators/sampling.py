"""Frame sampling, splitting and label export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import text as T
from trackloom.operators.ordering import numbered


def validate_plans(plans: DataFrame, segments: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, errors) of the plans with an error: intervals below 1, bounds outside the video or reversed, overlapping segments."""
    w = Window.partitionBy("video_id").orderBy("start_frame", "end_frame")
    rows = segments.join(videos.select("video_id", "frame_count"), "video_id").withColumn("before", F.lag("end_frame").over(w))
    bad = F.array_compact(F.array(
        F.when(F.col("interval") < 1, "interval"),
        F.when((F.col("start_frame") < 0) | (F.col("end_frame") >= F.col("frame_count")) | (F.col("start_frame") > F.col("end_frame")), "bounds"),
        F.when(F.col("start_frame") <= F.col("before"), "overlap"),
    ))
    found = rows.select("video_id", F.explode(bad).alias("e")).unionByName(plans.where("default_interval < 0").select("video_id", F.lit("default_interval").alias("e")))
    return found.groupBy("video_id").agg(F.array_sort(F.collect_set("e")).alias("errors"))


def segment_frames(segments: DataFrame) -> DataFrame:
    """Every interval-th frame of each segment, and its end."""
    steps = F.array_union(F.sequence("start_frame", "end_frame", "interval"), F.array("end_frame"))
    return segments.select("video_id", F.explode(steps).alias("frame"))


def sampled_frames(plans: DataFrame, segments: DataFrame, videos: DataFrame) -> DataFrame:
    """The default frames that no segment covers, and the segments' frames. A default interval of 0 gives no default frames."""
    grid = plans.where("default_interval > 0").join(videos.select("video_id", "frame_count"), "video_id")
    grid = grid.select("video_id", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1, F.col("default_interval"))).alias("frame"))
    s = segments.select(F.col("video_id").alias("v"), "start_frame", "end_frame")
    rest = grid.join(s, (F.col("video_id") == F.col("v")) & F.col("frame").between(F.col("start_frame"), F.col("end_frame")), "left_anti")
    return rest.unionByName(segment_frames(segments)).distinct()


def plan_stats(sampled: DataFrame) -> DataFrame:
    return sampled.groupBy("video_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def segment_video(frames: DataFrame, length: int) -> DataFrame:
    """Fixed-length segments: number, and frames within it counted from 1."""
    return frames.withColumn("segment", F.floor(F.col("video_frame_idx") / length).cast("bigint")).withColumn("local_frame", F.pmod("video_frame_idx", F.lit(length)) + 1)


def split_round_robin(samples: DataFrame, parts: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Samples dealt to parts in order, within each group given (a dataset root, a video), or over the whole table, which ranges of the order number."""
    if within:
        rows = samples.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    else:
        rows = numbered(samples, [F.col(c) for c in order], "__n")
    return rows.withColumn("part", F.pmod(F.col("__n") - 1, F.lit(parts)).cast("int")).drop("__n")


def uniform_sample(samples: DataFrame, k: int, order: list[str], within: list[str]) -> DataFrame:
    """Every k-th sample of each group from the first on."""
    return samples.withColumn("__r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.pmod(F.col("__r") - 1, F.lit(k)) == 0).drop("__r")


def inference_frames(videos: DataFrame, first: int, most: int, step: int) -> DataFrame:
    """Every frame of each video with its id and whether inference runs on it."""
    rows = videos.select("video_id", "frame_offset", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1)).alias("frame"))
    chosen = (F.col("frame") >= first) & (F.col("frame") < first + most) & (F.pmod(F.col("frame") - first, F.lit(step)) == 0)
    return rows.select("video_id", "frame", (F.col("frame") + F.col("frame_offset")).alias("frame_id"), chosen.alias("chosen"))


def to_yolo_frames(rows: DataFrame, videos: DataFrame, prefix: str = "frame") -> DataFrame:
    """(video_id, file_name, content): a label file for every frame of each video, empty where it has no box; lines in the rows' order."""
    grid = videos.select("video_id", "width", "height", F.explode(F.sequence(F.col("frame_offset").cast("bigint"), F.col("frame_offset") + F.col("frame_count") - F.lit(1).cast("bigint"))).alias("frame_id"))
    x, y = (F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height")
    w, h = (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", *[F.floor(v * 1e6 + 0.5) / 1e6 for v in (x, y, w, h)])
    both = grid.join(rows.select("video_id", "frame_id", "class_id", "x1", "y1", "x2", "y2", "order"), ["video_id", "frame_id"], "left")
    lines = F.array_sort(F.collect_list(F.when(F.col("class_id").isNotNull(), F.struct("order", line.alias("line")))))
    content = F.array_join(F.transform(lines, lambda s: s["line"]), "\n")
    return both.groupBy("video_id", "frame_id").agg(content.alias("content")).select("video_id", F.format_string(f"{prefix}_%06d.txt", "frame_id").alias("file_name"), "content")


def select_frames(videos: DataFrame, k: int) -> DataFrame:
    """Every k-th frame of each video (video_id, stem, frame_count) from the first on, named by its number from 1."""
    rows = videos.where("frame_count > 0").select("video_id", "stem", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("frame_count") - 1).cast("bigint"), F.lit(k).cast("bigint"))).alias("frame"))
    return rows.select("video_id", "frame", F.concat_ws("_", "stem", (F.col("frame") + 1).cast("string")).alias("name"))


def benchmark_frames(videos: DataFrame, start: int, step: int, measured: int, warm_up: int = 1) -> DataFrame:
    """(video_id, position, frame, warm_up): a fixed set of frames of each video, the first ones to warm up; those beyond the video are left out. A video without any measured frame has no row: that is an error of the request."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(warm_up + measured - 1).cast("bigint"))).alias("position")
    rows = videos.select("video_id", "frame_count", at).withColumn("frame", F.col("position") * step + start).where("frame < frame_count").withColumn("warm_up", F.col("position") < warm_up)
    enough = rows.groupBy("video_id").agg(F.bool_or(~F.col("warm_up")).alias("ok")).where("ok")
    return rows.join(enough.select("video_id"), "video_id", "left_semi").select("video_id", "position", "frame", "warm_up")


def export_sampled(track_frames: DataFrame, sampled: DataFrame, videos: DataFrame, include_empty: bool = True, prefix: str = "frame") -> DataFrame:
    """(video_id, frame, stem, content, boxes) of the sampled frames, with the label lines of the tracks' boxes in track order; frames without a box only if they are wanted."""
    width, height = F.col("width"), F.col("height")
    x, y = (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[T.decimals(v) for v in (x, y, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height)])
    wanted = track_frames.join(sampled.select("video_id", F.col("frame").alias("video_frame_idx")), ["video_id", "video_frame_idx"], "left_semi")  # before lines are made of them
    rows = wanted.join(videos.select("video_id", "width", "height"), "video_id").select("video_id", F.col("video_frame_idx").alias("frame"), F.struct("track_id", line.alias("line")).alias("l"))
    lines = rows.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list("l")).alias("l"))
    out = sampled.select("video_id", "frame").join(lines, ["video_id", "frame"], "left" if include_empty else "inner")
    content = F.array_join(F.transform("l", lambda s: s["line"]), "\n")
    return out.select("video_id", "frame", F.format_string(f"{prefix}_%06d", "frame").alias("stem"), F.coalesce(content, F.lit("")).alias("content"), F.coalesce(F.size("l"), F.lit(0)).alias("boxes"))


def tiered_sample(track_frames: DataFrame, videos: DataFrame, window: int = 60, stride: int = 15, intervals: tuple[int, int, int, int] = (20, 10, 5, 2)) -> DataFrame:
    """(video_id, frame): frames taken the denser the more moves around them.

    The score of a window of frames is the mean motion of box centres within it. A frame has the largest score of the windows that
    hold it; by the video's quantiles 0.5, 0.75 and 0.9 of scores it belongs to a tier, whose interval its number has to divide.
    """
    w = Window.partitionBy("video_id", "track_id").orderBy("video_frame_idx")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    moved = track_frames.select("video_id", "video_frame_idx", F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)).alias("m"))
    per_frame = moved.groupBy("video_id", "video_frame_idx").agg(F.sum("m").alias("m"), F.count("m").alias("n"))
    number = F.lit(stride).cast("bigint")
    first, last = F.greatest(F.ceil((F.col("f") - window + 1) / number), F.lit(0)), F.floor(F.col("f") / number)
    windows = lambda df: df.withColumn("k", F.explode(F.sequence(first, last)))
    scores = windows(per_frame.withColumnRenamed("video_frame_idx", "f")).groupBy("video_id", "k").agg((F.sum("m") / F.greatest(F.sum("n"), F.lit(1))).alias("s"))
    grid = videos.where("frame_count > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("frame_count") - 1).cast("bigint"))).alias("f"))
    best = windows(grid).join(scores, ["video_id", "k"], "left").groupBy("video_id", "f").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("s"))
    cuts = best.groupBy("video_id").agg(*[F.percentile("s", F.lit(q)).alias(f"q{k}") for k, q in enumerate((0.5, 0.75, 0.9))])
    a, b, c, d = intervals
    every = F.when(F.col("s") > F.col("q2"), d).when(F.col("s") > F.col("q1"), c).when(F.col("s") > F.col("q0"), b).otherwise(a)
    return best.join(cuts, "video_id").where(F.pmod(F.col("f"), every) == 0).select("video_id", F.col("f").alias("frame"))
