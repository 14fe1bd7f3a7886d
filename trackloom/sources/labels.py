"""Readers of label files, tracking documents and model answers, as DataFrames with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import text as T
from trackloom.sources import folders

TRACKING_SCHEMA = """metadata struct<video_path:string,fps:double,width:int,height:int,frame_count:int,frame_offset:int,num_tracks:int>,
tracks array<struct<track_id:bigint,class_id:int,frames:array<struct<frame_id:bigint,video_frame_idx:bigint,bbox_xyxy:array<double>>>>>"""
PLAN_SCHEMA = "default_interval int, include_empty_frames boolean, file_prefix string, segments array<struct<start_frame:int,end_frame:int,interval:int,label:string>>"
ANSWER_SCHEMA = "image string, width int, height int, answer string, error string, num_boxes int, _corrupt_record string"


def _video() -> Column:
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(F.col("path"), "/"), -2)


def read_yolo_labels(spark: SparkSession, path: str, videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, detections, warnings) of label files ``*_<number>.txt`` below ``path``, a folder per video.

    ``videos``: (video_id, width, height, frame_count) with the folder's name as video_id. Numbers count from 1 where the
    folder's smallest is 1, else from 0. A line has five or six fields; the sixth is the score, 1 if missing, held to 0..1.
    Lines that don't parse and boxes of no size go to the warnings; frames without boxes stay. Tasks list the folders and read
    the files, once, names and lines together, so that empty files are rows and no name passes through the driver.
    """
    files = folders.files(spark, path, ".txt").withColumns({"video_id": _video(), "n": F.regexp_extract("path", r"_([0-9]+)\.txt$", 1)})
    unnamed = files.where("n = ''").select("path", F.lit("no frame number").alias("warning"))
    files = files.where("n <> ''").withColumn("frame_id", F.col("n").cast("bigint"))
    first = files.groupBy("video_id").agg((F.min("frame_id") == 1).cast("int").alias("offset"))
    files = files.join(first, "video_id").withColumn("video_frame_idx", F.col("frame_id") - F.col("offset")).join(videos, "video_id")
    frames = files.where((F.col("video_frame_idx") >= 0) & (F.col("video_frame_idx") < F.col("frame_count")))
    rows = frames.select("*", F.posexplode(F.split("value", "\r?\n")).alias("det_idx", "line")).where(F.trim("line") != "")
    f = F.split(F.trim("line"), r"\s+")
    num = lambda k: F.get(f, F.lit(k)).try_cast("double")
    rows = rows.withColumns({"k": F.size(f), "c": num(0), "cx": num(1), "cy": num(2), "w": num(3), "h": num(4), "s": F.when(F.size(f) == 6, num(5)).otherwise(1.0)})
    good = F.col("k").isin(5, 6) & F.col("c").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull() & F.col("s").isNotNull()
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.col(top) - 1.0)
    boxed = rows.withColumns({
        "x1": clamp((F.col("cx") - F.col("w") / 2) * F.col("width"), "width"), "y1": clamp((F.col("cy") - F.col("h") / 2) * F.col("height"), "height"),
        "x2": clamp((F.col("cx") + F.col("w") / 2) * F.col("width"), "width"), "y2": clamp((F.col("cy") + F.col("h") / 2) * F.col("height"), "height"),
    })
    whole = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    detections = boxed.where(good & whole).select("video_id", "frame_id", "video_frame_idx", "det_idx", F.col("c").cast("int").alias("class_id"), "x1", "y1", "x2", "y2", F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)).alias("score"))
    bad = boxed.where(~(good & whole)).select("path", F.concat(F.when(~good, "cannot parse: ").otherwise("empty box: "), "line").alias("warning"))
    return frames.select("video_id", "frame_id", "video_frame_idx", "path"), detections, unnamed.unionByName(bad)


def read_tracking_results(spark: SparkSession, path: str) -> DataFrame:
    """Track frames of tracking documents, one file per video; a frame's index falls back to its id, then to 0."""
    docs = spark.read.schema(TRACKING_SCHEMA).option("multiLine", "true").json(path).select(F.col("_metadata.file_name").alias("document"), F.explode("tracks").alias("t"))
    rows = docs.select("document", "t.track_id", "t.class_id", F.explode("t.frames").alias("f"))
    at = F.coalesce("f.video_frame_idx", "f.frame_id", F.lit(0).cast("bigint"))
    box = [F.get("f.bbox_xyxy", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return rows.select("document", "track_id", "class_id", F.coalesce("f.frame_id", at).alias("frame_id"), at.alias("video_frame_idx"), *box)


def to_tracking_results(track_frames: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, document): the JSON document of each video's tracks, frames and tracks in order: boxes clipped and in whole pixels, zeros where nothing is left, with the first and last frames. A video without tracks has a document, too."""
    rows = track_frames.join(videos.select("video_id", "width", "height"), "video_id")
    b = G.round_bbox_int(G.Box.of(), F.col("width").cast("double"), F.col("height").cast("double"))
    frame = F.struct("frame_id", F.col("video_frame_idx").cast("bigint").alias("video_frame_idx"), F.array(*[b[c] for c in G.Box._fields]).alias("bbox_xyxy"))
    tracks = rows.groupBy("video_id", "track_id", "class_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    ends = [F.element_at("frames", k)[c].alias(f"{side}_{short}") for side, k in (("start", 1), ("end", -1)) for c, short in (("frame_id", "frame_id"), ("video_frame_idx", "video_frame_idx"))]
    tracks = tracks.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "class_id", F.size("frames").alias("num_frames"), *ends, "frames"))).alias("tracks"))
    whole = videos.join(tracks, "video_id", "left").withColumn("tracks", F.coalesce("tracks", F.array().cast(tracks.schema["tracks"].dataType)))
    meta = F.struct("fps", "width", "height", "frame_count", "frame_offset", F.size("tracks").alias("num_tracks"))
    return whole.select("video_id", F.to_json(F.struct(meta.alias("metadata"), "tracks")).alias("document"))


def read_sampling_plans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plans, segments) of plan documents; the interval defaults to 30, empty frames are included, the prefix is frame."""
    docs = spark.read.schema(PLAN_SCHEMA).option("multiLine", "true").json(path).withColumn("plan_id", F.col("_metadata.file_name"))
    plans = docs.select("plan_id", F.coalesce("default_interval", F.lit(30)).alias("default_interval"), F.coalesce("include_empty_frames", F.lit(True)).alias("include_empty_frames"), F.coalesce(F.nullif(F.trim("file_prefix"), F.lit("")), F.lit("frame")).alias("file_prefix"))
    return plans, docs.select("plan_id", F.explode("segments").alias("s")).select("plan_id", "s.*")


def read_raw_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) of JSON lines; a line that isn't JSON is a failure."""
    rows = spark.read.schema(ANSWER_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    ok = F.col("answer").isNotNull() & F.col("error").isNull()
    return rows.where(ok).drop("error", "_corrupt_record"), rows.where(~ok).select("image", F.coalesce("error", F.lit("not JSON")).alias("error"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Boxes of model answers, in order: a label holds for all boxes up to the next one; coordinates are on a grid of 1000."""
    tokens = F.regexp_extract_all("answer", F.lit(r"(?s)<ref>.*?</ref>|<box>\s*<\d+>\s*<\d+>\s*<\d+>\s*<\d+>\s*</box>"), F.lit(0))
    rows = answers.select("image", "width", "height", F.posexplode(tokens).alias("pos", "token"))
    label = F.when(F.col("token").startswith("<ref>"), F.regexp_extract("token", r"(?s)<ref>(.*?)</ref>", 1))
    before = Window.partitionBy("image").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("label", F.coalesce(F.last(label, ignorenulls=True).over(before), F.lit(""))).where(F.col("token").startswith("<box>"))
    v = F.regexp_extract_all("token", F.lit(r"<(\d+)>"), F.lit(1))
    at = lambda k, size: (F.get(v, F.lit(k)).cast("double") / 1000 * F.col(size))
    return rows.select("image", "pos", F.lower(F.regexp_replace(F.trim("label"), r"\s+", " ")).alias("label"), at(0, "width").alias("x1"), at(1, "height").alias("y1"), at(2, "width").alias("x2"), at(3, "height").alias("y2"))


def answers_to_labels(answers: DataFrame, classes: Column, prompt: str = "", default: int = 0) -> DataFrame:
    """(image, content, boxes): the scored label lines of each answer's boxes, in order, with score 1; images whose answer failed, or without boxes, have empty labels. answers: image, width, height, answer, of which the last is null after a failure."""
    boxes = parse_answers(answers.where(F.col("answer").isNotNull()).select("image", "width", "height", "answer"))
    number = T.class_id(F.col("label"), classes, F.lit(prompt), F.lit(default))
    sized = boxes.join(answers.select("image", "width", "height"), "image")
    line = T.scored_line(number, G.Box.of(), F.col("width"), F.col("height"), F.lit(1.0))
    lines = sized.select("image", "pos", line.alias("line")).where("line is not null").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    rows = answers.select("image").join(lines, "image", "left")
    return rows.select("image", F.coalesce(F.array_join(F.transform("l", lambda r: r["line"]), "\n"), F.lit("")).alias("content"), F.coalesce(F.size("l"), F.lit(0)).alias("boxes"))
