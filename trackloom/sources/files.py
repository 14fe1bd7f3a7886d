"""File listings, manifests, task tables, keyframe documents and flat exports, as DataFrames.

A listing is a DataFrame of files (path, length): ``list_files`` gives it by Spark's own readers, so no name passes the driver.
Folders without any file don't show in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import text as T

#: What the suffixes stand for.
IMAGES = ["jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff"]
VIDEOS = ["mp4", "avi", "mov", "mkv", "webm", "m4v"]
#: The task table's columns, in order, with their headings.
HEADINGS = {
    "申请日期": "application_date", "申请人": "applicant", "项目": "project", "标注内容": "annotation_content", "数据集溯源": "dataset_source",
    "每小时可标": "hourly_capacity", "数据量": "data_amount", "预计工时/单人": "estimated_hours", "数据路径": "data_path", "标注说明书路径": "guide_path",
}
ALSO = {"希望完成时间": "desired_completion_date"}
#: Fixed value: how many shares a root's files are dealt to where they meet their root.
SHARES = 256
#: Fixed value: the name of a part that is its data set's root.
ROOT_NAME = "数据集根目录"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]*$", "")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r".\.([^.]+)$", 1))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan_samples(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, errors, warnings) of data sets: a root holds the folders images, labels and annotations, whose files belong together by stem without case.

    Errors: two files of a kind and stem, an image without label or annotation, a stem in two roots. Warnings count a root's
    labels and annotations without image. Samples (stem, root, image, label, annotation) are those without an error.
    """
    kinds = {"images": IMAGES, "labels": ["txt"], "annotations": ["xml"]}
    named = lambda df: df.select("path", _folder(F.col("path")).alias("folder")).select("path", _folder(F.col("folder")).alias("root"), _name(F.col("folder")).alias("kind"), F.lower(_stem(F.col("path"))).alias("key"), _suffix(F.col("path")).alias("suffix"))
    f = named(files)
    has = F.col("kind").isin(*kinds)
    roots = f.where(has).groupBy("root").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds]).where(" and ".join(kinds)).select("root")
    fits = F.lit(False)
    for kind, suffixes in kinds.items():
        fits = fits | ((F.col("kind") == kind) & F.col("suffix").isin(*suffixes))
    # All that follows groups by the key, and what else there is. Paths alone are shuffled, as all else is a part of them.
    # Roots are few and hold much: each is dealt to some tasks, not to one, to meet the files.
    dealt = f.where(fits).select("path", "root", F.pmod(F.xxhash64("path"), F.lit(SHARES)).alias("share"))
    of_roots = roots.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
    f = named(dealt.join(of_roots, ["root", "share"]).select("path").repartition(F.lower(_stem(F.col("path")))))
    twice = f.groupBy("root", "kind", "key").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").select("root", "path", F.lit("stem twice in a folder").alias("error"))
    one = lambda k: F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k)
    rows = f.groupBy("root", "key").agg(*[one(k) for k in kinds])
    rows = rows.withColumn("n", F.count("images").over(Window.partitionBy("key")))
    bare = rows.where(F.col("images").isNotNull() & (F.col("labels").isNull() | F.col("annotations").isNull())).select("root", F.col("images").alias("path"), F.concat_ws(" and ", F.when(F.col("labels").isNull(), "no label"), F.when(F.col("annotations").isNull(), "no annotation")).alias("error"))
    shared = rows.where(F.col("images").isNotNull() & (F.col("n") > 1)).select("root", F.col("images").alias("path"), F.lit("stem in two roots").alias("error"))
    whole = rows.where(F.col("images").isNotNull() & F.col("labels").isNotNull() & F.col("annotations").isNotNull() & (F.col("n") == 1))
    samples = whole.select(_stem(F.col("images")).alias("stem"), "root", F.col("images").alias("image"), F.col("labels").alias("label"), F.col("annotations").alias("annotation"))
    extra = rows.where(F.col("images").isNull()).groupBy("root").agg(F.count("labels").alias("labels"), F.count("annotations").alias("annotations"))
    return samples, twice.unionByName(bare).unionByName(shared), extra


def discover_folders(files: DataFrame, root: str, markers: list[str], most_depth: int = 4, least: int = 1) -> DataFrame:
    """(relative_path, depth, markers, image_count) of the folders below ``root`` whose children's names hit ``least`` of the markers, without case, and that don't lie in one found already.

    image_count counts the images anywhere below the folder's ``images``, where that is a marker it has, and is null elsewhere.
    """
    if not 0 <= most_depth <= 32 or not markers or not 1 <= least <= len({m.lower() for m in markers}):
        raise ValueError("depths go from 0 to 32, and hits from 1 to the number of markers")
    wanted = sorted({m.strip().lower() for m in markers if m.strip()})
    inner = F.split(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"), "/")
    steps = files.where(F.col("path").startswith(root.rstrip("/") + "/")).select(inner.alias("s"), _suffix(F.col("path")).alias("suffix"))
    # Each file names all folders above it, with the child that leads to it.
    each = steps.select("suffix", F.col("s"), F.explode(F.sequence(F.lit(0), F.least(F.size("s") - 2, F.lit(most_depth)))).alias("depth")).where(F.size("s") >= 2)
    each = each.select("depth", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "/").alias("dir"), F.get("s", F.col("depth")).alias("child"), (F.size("s") - 1 > F.col("depth")).alias("is_dir"), "suffix").where("is_dir")
    hits = F.col("child").isNotNull() & F.lower("child").isin(*wanted)
    images = F.count_if((F.lower("child") == "images") & F.col("suffix").isin(*IMAGES))
    found = each.groupBy("dir", "depth").agg(F.array_sort(F.collect_set(F.when(hits, F.col("child")))).alias("markers"), images.alias("n")).where(F.size("markers") >= least)
    above = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), k), "/"))
    inside = found.where("depth > 0").select("dir", F.explode(above).alias("top")).join(found.select(F.col("dir").alias("top")), "top", "left_semi").select("dir").distinct()
    out = found.join(inside, "dir", "left_anti")
    has_images = F.exists("markers", lambda m: F.lower(m) == "images")
    return out.select(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("relative_path"), "depth", "markers", F.when(has_images, F.col("n")).alias("image_count"))


def list_media(files: DataFrame, root: str, kind: str = "images", recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(media, collisions): the images or videos below a folder, and those of which two would get one label file."""
    suffixes = IMAGES if kind == "images" else VIDEOS
    base = root.rstrip("/") + "/"
    rows = files.where(F.col("path").startswith(base) & _suffix(F.col("path")).isin(*suffixes))
    if not recursive:
        rows = rows.where(_folder(F.col("path")) == base[:-1])
    target = F.lower(F.concat(_folder(F.col("path")), F.lit("/"), _stem(F.col("path"))))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(target)))
    return rows.drop("n"), rows.where("n > 1").drop("n")


def first_media(media: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files by their paths without case, then as they are; all of them for 0. No file at all is an error."""
    out = media.orderBy(F.lower("path"), "path").limit(most) if most > 0 else media
    if out.isEmpty():
        raise ValueError("no files of this kind")
    return out


def list_image_folders(files: DataFrame, output_root: str, existing: DataFrame) -> DataFrame:
    """(folder, images, output, conflict) of the folders that hold images themselves: the output folder that is planned, and whether it is there already."""
    rows = files.where(_suffix(F.col("path")).isin(*IMAGES)).groupBy(_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("images"))
    rows = rows.withColumn("output", F.concat(F.lit(output_root.rstrip("/") + "/"), _name(F.col("folder"))))
    there = existing.select(F.col("path").alias("output"), F.lit(True).alias("there")).distinct()
    many = F.count("*").over(Window.partitionBy("output")) > 1
    return rows.join(there, "output", "left").select("folder", "images", "output", (F.coalesce("there", F.lit(False)) | many).alias("conflict"))


def parse_manifest(lines: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(parts, errors) of manifest lines (line_no, value) with up to three columns: a path; a path and a count, or a name and a path; name, path and count.

    Errors are lines with more columns, counts that are none, paths that are missing or have no root, and those that name a
    place again. A part without name takes its path's.
    """
    cells = F.transform(F.split("value", "\t"), lambda c: F.trim(c))
    rows = lines.select("line_no", cells.alias("c")).where(F.exists("c", lambda x: x != ""))
    n, at = F.size("c"), lambda k: F.get("c", F.lit(k))
    digits = at(1).rlike("^[0-9]+$")
    rows = rows.select(
        "line_no", n.alias("n"), F.when(n == 3, at(0)).when((n == 2) & ~digits, at(0)).otherwise("").alias("name"),
        F.when(n == 1, at(0)).when((n == 2) & digits, at(0)).when(n <= 3, at(1)).alias("raw"), F.when(n == 3, at(2)).when((n == 2) & digits, at(1)).alias("count"),
    )
    path = T.work_path(F.lit(root), F.col("raw"))
    count = F.when(F.col("count").rlike(r"^\+?[0-9]+$"), F.col("count").cast("bigint"))
    rows = rows.withColumns({"work_path": path, "image_count": count})
    key = F.lower(F.regexp_replace(F.replace("work_path", F.lit("\\"), F.lit("/")), "/+$", ""))
    again = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) > 1
    error = F.when(F.col("n") > 3, "columns").when(F.col("count").isNotNull() & F.col("image_count").isNull(), "count").when(F.coalesce("raw", F.lit("")) == "", "path").when(F.col("work_path").isNull(), "root").when(again, "twice")
    rows = rows.withColumn("error", error)
    absolute = F.col("raw").rlike(r"^(?:/|\\\\|[A-Za-z]:[\\/])")
    tail = F.element_at(F.split(F.replace(F.regexp_replace("raw", r"[/\\]+$", ""), F.lit("\\"), F.lit("/")), "/"), -1)
    inner = F.array_join(F.filter(F.split("raw", r"[\\/]"), lambda p: p != ""), " / ")
    name = F.when(F.col("name") != "", F.col("name")).when(absolute, tail).when(F.col("raw").isin(".", ".\\", "./"), ROOT_NAME).otherwise(inner)
    return rows.where("error is null").select("line_no", name.alias("name"), "work_path", "image_count"), rows.where("error is not null").select("line_no", "error")


def parse_task_table(lines: DataFrame) -> DataFrame:
    """(line_no, and the task columns) of pasted lines (line_no, value): by the first line's headings if three or more of its cells are known ones, else by place. Lines without project and content go."""
    known = HEADINGS | ALSO
    cells = F.transform(F.split("value", "\t"), lambda c: F.trim(c))
    rows = lines.select("line_no", cells.alias("c")).where(F.exists("c", lambda x: x != ""))
    first = rows.groupBy().agg(F.min_by("c", "line_no").alias("head"), F.min("line_no").alias("top"))
    headed = F.size(F.filter("head", lambda h: h.isin(*known))) >= 3
    names = F.create_map(*[F.lit(x) for k in known.items() for x in k])
    by_name = F.transform("head", lambda h: F.try_element_at(names, h))
    first = first.select("top", headed.alias("headed"), F.when(headed, by_name).otherwise(F.array(*map(F.lit, HEADINGS.values()))).alias("fields"))
    rows = rows.join(F.broadcast(first)).where(~(F.col("headed") & (F.col("line_no") == F.col("top"))))
    field = lambda name: F.coalesce(F.get("c", (F.array_position("fields", name) - 1).cast("int")), F.lit(""))
    value = {name: F.when(F.array_position("fields", name) > 0, field(name)).otherwise("") for name in [*HEADINGS.values(), *ALSO.values()]}
    out = rows.select("line_no", *[v.alias(k) for k, v in value.items()])
    return out.where((F.col("project") != "") | (F.col("annotation_content") != ""))


def video_dimensions(names: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """(video, width, height, fps) from names: the first three numbers in a row, between underscores, that are a size of 128 or more either way and a rate from 1 to 240; else what is supplied, null without."""
    tokens = F.split(_stem(F.col("video")), "_")
    digits = lambda t: t.rlike("^[0-9]{1,9}$")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 3, F.lit(0))), lambda k: F.slice(tokens, k + 1, F.lit(3)))
    number = lambda t, k: F.get(t, F.lit(k)).try_cast("int")
    fits = F.filter(triples, lambda t: (F.size(t) == 3) & F.forall(t, digits) & (number(t, 0) >= 128) & (number(t, 1) >= 128) & number(t, 2).between(1, 240))
    rows = names.select("video", F.get(fits, F.lit(0)).alias("t")).select("video", *[number(F.col("t"), k).alias(c) for k, c in enumerate(("width", "height", "fps"))])
    if supplied is None:
        return rows
    other = supplied.select("video", *[F.col(c).alias(f"__{c}") for c in ("width", "height", "fps")])
    return rows.join(other, "video", "left").select("video", *[F.coalesce(c, f"__{c}").alias(c) for c in ("width", "height", "fps")])


SEQUENCE = "array<struct<frame:int,enabled:boolean,rotation:double,x:double,y:double,width:double,height:double,time:double>>"
VALUE = f"struct<framesCount:int,duration:double,sequence:{SEQUENCE},labels:array<string>>"
TASK = f"struct<box:array<{VALUE}>,video:string,data:struct<box:array<{VALUE}>,video:string>,annotations:array<struct<result:array<struct<id:string,type:string,value:{VALUE}>>>>>"
PREFIX = "/data/local-files/?d="


def to_label_studio(track_frames: DataFrame, videos: DataFrame, class_names: Column | None = None) -> DataFrame:
    """(video_id, document): each video's tracks as keyframes in percent, frames counted from 1, with a disabled one behind a track that ends before its video. videos: video_id, video_path, width, height, fps, frame_count."""
    names = F.create_map().cast("map<string,string>") if class_names is None else class_names
    rows = track_frames.join(videos.select("video_id", "width", "height", "fps", "frame_count"), "video_id")
    frame = (F.col("video_frame_idx") + 1).cast("int")
    when = lambda f: F.when(F.col("fps") > 0, f / F.col("fps")).otherwise(0.0)
    key = F.struct(
        frame.alias("frame"), F.lit(True).alias("enabled"), F.lit(0.0).alias("rotation"), (F.col("x1") / F.col("width") * 100).alias("x"), (F.col("y1") / F.col("height") * 100).alias("y"),
        ((F.col("x2") - F.col("x1")) / F.col("width") * 100).alias("width"), ((F.col("y2") - F.col("y1")) / F.col("height") * 100).alias("height"), when(frame).alias("time"),
    )
    t = rows.groupBy("video_id", "track_id", "class_id", "fps", "frame_count").agg(F.array_sort(F.collect_list(key)).alias("s"), F.max(frame).alias("last"))
    tail = F.transform(F.slice("s", F.lit(-1), F.lit(1)), lambda k: F.struct(
        (k["frame"] + 1).alias("frame"), F.lit(False).alias("enabled"), *[k[c].alias(c) for c in ("rotation", "x", "y", "width", "height")], when(k["frame"] + 1).alias("time")
    ))
    total = F.when(F.col("frame_count") > 0, F.col("frame_count")).otherwise(F.col("last")).cast("int")
    t = t.withColumn("total", total).withColumn("s", F.when(F.col("last") < F.col("total"), F.concat("s", tail)).otherwise(F.col("s")))
    value = F.struct(F.col("total").alias("framesCount"), when(F.col("total")).alias("duration"), F.col("s").alias("sequence"), F.array(T.class_name(F.col("class_id"), names)).alias("labels"))
    item = F.struct(F.concat(F.lit("track-"), "track_id").alias("id"), F.lit("box").alias("from_name"), F.lit("video").alias("to_name"), F.lit("videorectangle").alias("type"), value.alias("value"))
    v = t.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("track_id", item.alias("item")))).alias("r")).join(videos.select("video_id", "video_path"), "video_id")
    result = F.transform("r", lambda r: r["item"])
    task = F.struct(F.lit(1).alias("id"), F.array(F.struct(result.alias("result"), F.size("r").alias("result_count"))).alias("annotations"), F.struct(F.concat(F.lit(PREFIX), "video_path").alias("video")).alias("data"))
    return v.select("video_id", F.to_json(F.array(task)).alias("document"))


def label_studio_keyframes(documents: DataFrame) -> DataFrame:
    """(document, video, item, label, frames_count, frame, enabled, x, y, width, height) of documents (document, value): their first task, whichever of the three places its boxes are in."""
    task = F.coalesce(F.get(F.from_json("value", f"array<{TASK}>"), F.lit(0)), F.from_json("value", TASK))
    d = documents.select("document", task.alias("t"))
    items = F.coalesce("t.box", "t.data.box", F.transform(F.get("t.annotations", F.lit(0))["result"], lambda r: r["value"]))
    video = F.coalesce("t.video", "t.data.video")
    rows = d.select("document", F.regexp_replace(video, "^" + PREFIX.replace("?", r"\?"), "").alias("video"), F.posexplode(items).alias("item", "b"))
    rows = rows.select("document", "video", "item", F.get("b.labels", F.lit(0)).alias("label"), F.col("b.framesCount").alias("frames_count"), F.explode("b.sequence").alias("k"))
    return rows.select("document", "video", "item", "label", "frames_count", "k.frame", F.coalesce("k.enabled", F.lit(True)).alias("enabled"), "k.x", "k.y", "k.width", "k.height")


def frame_counts(keyframes: DataFrame) -> DataFrame:
    """(document, frame_count): the largest count that a box names, or else the largest keyframe."""
    return keyframes.groupBy("document").agg(F.coalesce(F.max(F.when(F.col("frames_count") > 0, F.col("frames_count"))), F.max("frame"), F.lit(0)).alias("frame_count"))


def flat_rows(track_frames: DataFrame, videos: DataFrame) -> DataFrame:
    """The flat export's rows: boxes in whole pixels, clipped; zeros where nothing is left. Written with a header, it is the flat CSV."""
    rows = track_frames.join(videos.select("video_id", "width", "height"), "video_id")
    b = G.round_bbox_int(G.Box.of(), F.col("width").cast("double"), F.col("height").cast("double"))
    return rows.select("video_id", "frame_id", "video_frame_idx", "track_id", "class_id", *[b[c].alias(c) for c in G.Box._fields])


def write_tracks_csv(track_frames: DataFrame, videos: DataFrame, path: str) -> None:
    """A folder for each video with its rows by track and frame."""
    flat_rows(track_frames, videos).repartition("video_id").sortWithinPartitions("video_id", "track_id", "frame_id").write.partitionBy("video_id").option("header", "true").csv(path)


def anomaly_documents(profiles: DataFrame, segments: DataFrame, parameters: dict) -> DataFrame:
    """(video_id, document): the tracks' profiles with their anomalous segments, and the parameters."""
    each = segments.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "n_frames", "min_area", "max_area", "max_abs_z", "reasons"))).alias("segments"))
    tracks = profiles.join(each, ["video_id", "track_id"], "left")
    row = F.struct("track_id", "n_valid", "median", "p10", "p90", "mad", F.coalesce("segments", F.array().cast(each.schema["segments"].dataType)).alias("segments"))
    own = F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())]) if parameters else F.create_map().cast("map<string,string>")
    return tracks.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("tracks")).select("video_id", F.to_json(F.struct(own.alias("parameters"), "tracks")).alias("document"))


def project_documents(tracks: DataFrame) -> DataFrame:
    """(video_id, document) of editable tracks: frames are a map by frame number."""
    frames = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("frame_id").cast("string").alias("k"), F.array("x1", "y1", "x2", "y2").alias("v")))))
    t = tracks.groupBy("video_id", "track_id", "class_id").agg(frames.alias("frames"))
    return t.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "class_id", F.map_entries("frames").alias("e")))).alias("r")).select(
        "video_id", F.to_json(F.struct(F.transform("r", lambda r: F.struct(r["track_id"].alias("track_id"), r["class_id"].alias("class_id"), F.map_from_entries(r["e"]).alias("frames"))).alias("tracks"))).alias("document")
    )


def read_projects(documents: DataFrame) -> DataFrame:
    """(video_id, track_id, class_id, frame_id, box) of project documents (video_id, document)."""
    kind = "struct<tracks:array<struct<track_id:bigint,class_id:int,frames:map<string,array<double>>>>>"
    t = documents.select("video_id", F.explode(F.from_json("document", kind)["tracks"]).alias("t"))
    rows = t.select("video_id", "t.track_id", "t.class_id", F.explode("t.frames").alias("f", "b"))
    return rows.select("video_id", "track_id", "class_id", F.col("f").cast("bigint").alias("frame_id"), *[F.get("b", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def plan_documents(plans: DataFrame, segments: DataFrame) -> DataFrame:
    """(plan_id, document) of sampling plans with their segments in order."""
    own = segments.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "interval", "label"))).alias("segments"))
    rows = plans.join(own, "plan_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast(own.schema["segments"].dataType)))
    return rows.select("plan_id", F.to_json(F.struct("default_interval", "include_empty_frames", "file_prefix", "segments")).alias("document"))


def prelabel_plan(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(video, status, reason) of videos (path) and prelabel files (path): a video takes the folder of its stem, without case; ``ready`` with one folder that has labels, ``skipped`` without, ``error`` where stems or folders come twice."""
    v = videos.select("path", F.lower(_stem(F.col("path"))).alias("stem")).withColumn("same", F.count("*").over(Window.partitionBy("stem")))
    f = files.where(_suffix(F.col("path")).isin("txt", "xml")).groupBy(_folder(F.col("path")).alias("folder")).agg(F.count_if(_suffix(F.col("path")) == "txt").alias("labels"))
    f = f.groupBy(F.lower(_name(F.col("folder"))).alias("stem")).agg(F.count("*").alias("folders"), F.min("folder").alias("folder"), F.sum("labels").alias("labels"))
    rows = v.join(f, "stem", "left")
    reason = F.when(F.col("same") > 1, "stem twice").when(F.col("folders") > 1, "folder twice").when(F.col("folders").isNull(), "no folder").when(F.col("labels") == 0, "no labels")
    status = F.when(F.coalesce(reason, F.lit("")).isin("stem twice", "folder twice"), "error").when(reason.isNotNull(), "skipped").otherwise("ready")
    return rows.select(F.col("path").alias("video"), "folder", status.alias("status"), reason.alias("reason"))


def organize_prelabels(videos: DataFrame, files: DataFrame) -> DataFrame:
    """(video, folder, status, reason, action, conflicts) of videos (path, length) and files of prelabel folders (path, length, digest).

    A video takes the folder of its stem, without case: ``skipped`` without one. ``error`` where stems or folders come twice, where
    the folder has a file of the video's name and another length, where it has neither ``labels`` nor a folder of the stem, and
    where both have files of a name with other contents: ``conflicts`` names the first five. Else it is ``ready``; the action is
    ``rename`` for labels alone, ``done`` for the stem's folder alone, ``merge`` for both. Nothing is renamed here. Lengths and
    digests that aren't given are taken to agree.
    """
    given = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    v = videos.select("path", given(videos, "length", "bigint").alias("length"), F.lower(_stem(F.col("path"))).alias("stem"), _name(F.col("path")).alias("name"))
    v = v.withColumn("same", F.count("*").over(Window.partitionBy("stem")))
    f = files.select("path", given(files, "length", "bigint").alias("f_length"), given(files, "digest", "string").alias("digest"))
    # A file lies in a folder itself (a video's copy) or in one within it (labels, or the stem's).
    at = f.select("*", _name(F.col("path")).alias("file"), _folder(F.col("path")).alias("inner"))
    owner = F.explode(F.array(F.struct(F.col("inner").alias("folder"), F.lit("").alias("kind")), F.struct(_folder(F.col("inner")).alias("folder"), F.lower(_name(F.col("inner"))).alias("kind"))))
    own = at.select("file", "f_length", "digest", owner.alias("o")).select("file", "f_length", "digest", "o.*").withColumn("stem", F.lower(_name(F.col("folder"))))
    own = own.join(v.select("stem").distinct(), "stem", "left_semi").where(F.col("kind").isin("", "labels") | (F.col("kind") == F.col("stem")))
    own = own.where((F.col("kind") != "") | (F.lower(_name(_folder(F.col("folder")))) != F.col("stem")))  # the stem's folder within one of its own is no other
    within = own.where("kind <> ''").withColumn("labelled", F.col("kind") == "labels")
    twice = within.groupBy("stem", "folder", "file").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    clashes = twice.groupBy("stem", "folder").agg(F.slice(F.array_sort(F.collect_set("file")), 1, 5).alias("conflicts"))
    sides = within.groupBy("stem", "folder").agg(F.bool_or("labelled").alias("has_labels"), F.bool_or(~F.col("labelled")).alias("has_stem"))
    folders = own.groupBy("stem", "folder").agg(F.count("*").alias("n")).join(sides, ["stem", "folder"], "left").join(clashes, ["stem", "folder"], "left")
    one = folders.groupBy("stem").agg(F.count("*").alias("folders"), *[F.min_by(c, "folder").alias(c) for c in ("folder", "has_labels", "has_stem", "conflicts")])
    copies = own.where("kind = ''").select("stem", "folder", F.col("file").alias("name"), F.col("f_length").alias("copy"))
    rows = v.join(one, "stem", "left").join(copies.groupBy("stem", "folder", "name").agg(F.max("copy").alias("copy")), ["stem", "folder", "name"], "left")
    a, b = F.coalesce("has_labels", F.lit(False)), F.coalesce("has_stem", F.lit(False))
    reason = (
        F.when(F.col("same") > 1, "stem twice").when(F.col("folders").isNull(), "no folder").when(F.col("folders") > 1, "folder twice")
        .when(F.col("copy") != F.col("length"), "video of another size").when(~a & ~b, "no labels").when(a & b & (F.size("conflicts") > 0), "conflicts")
    )
    status = F.when(reason.isNull(), "ready").when(reason == "no folder", "skipped").otherwise("error")
    action = F.when(reason.isNull(), F.when(a & b, "merge").when(a, "rename").otherwise("done"))
    return rows.select(F.col("path").alias("video"), "folder", status.alias("status"), reason.alias("reason"), action.alias("action"), F.when(reason == "conflicts", F.col("conflicts")).alias("conflicts"))
