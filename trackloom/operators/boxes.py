"""Boxes of images: exports, keyframes and the comparison of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import text as T
from trackloom.operators import graphs
from trackloom.operators.ordering import numbered

BOX = ["x1", "y1", "x2", "y2"]


def expand_keyframes(keys: DataFrame) -> DataFrame:
    """(video_id, track_id, frame, video_frame_idx, box) from (video_id, track_id, frame, enabled, box).

    A track ends at its first disabled key; its frames up to there are linear between keys, and the last key alone is one frame.
    """
    order = Window.partitionBy("video_id", "track_id").orderBy("frame")
    stopped = F.max((~F.col("enabled")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ["frame", *BOX]]
    live = keys.select("*", stopped.alias("stopped"), *following).where("not stopped")
    filled = live.withColumn("at", F.explode(F.sequence("frame", F.coalesce(F.greatest(F.col("next_frame") - 1, "frame"), "frame"))))
    t = (F.col("at") - F.col("frame")) / (F.col("next_frame") - F.col("frame"))
    box = [F.coalesce(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * t, F.col(c)).alias(c) for c in BOX]
    return filled.select("video_id", "track_id", F.col("at").alias("frame"), (F.col("at") - 1).alias("video_frame_idx"), *box)


def export_frames(frames: DataFrame, videos: DataFrame, interval: int) -> DataFrame:
    """(video_id, video_frame_idx, boxes): every ``interval``-th frame of each video with how many boxes it has, none included."""
    at = videos.where("frame_count > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("frame_count") - 1).cast("bigint"), F.lit(interval).cast("bigint"))).alias("video_frame_idx"))
    counts = frames.groupBy("video_id", "video_frame_idx").agg(F.count("*").alias("boxes"))
    return at.join(counts, ["video_id", "video_frame_idx"], "left").fillna(0, ["boxes"])


def export_files(frames: DataFrame, videos: DataFrame, interval: int, class_labels: DataFrame | None = None, segment: str | None = None) -> DataFrame:
    """(video_id, segment, name, labels, annotations): the YOLO text and the VOC document of every ``interval``-th frame of each video, boxes or not.

    frames: video_id, track_id, class_id, video_frame_idx, box; videos: video_id, stem, width, height, frame_count. The text has a
    line for each box, unclipped, by track; the document has what is left of the boxes within the picture, under their class's
    label (class_id, label), else ``class_`` and its number. ``segment`` names a column of both tables: with it, each segment's
    frames are numbered by themselves and the segment's name comes before that of the file, so that all can go to one folder.
    """
    key = ["video_id", *([segment] if segment else [])]
    at = videos.where("frame_count > 0").select(*key, "stem", "width", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("frame_count") - 1).cast("bigint"), F.lit(interval).cast("bigint"))).alias("video_frame_idx"))
    prefix = F.concat(F.col(segment).cast("string"), F.lit("_")) if segment else F.lit("")
    at = at.withColumn("name", F.concat(prefix, "stem", F.format_string("_frame_%06d", "video_frame_idx")))
    rows = at.join(frames, [*key, "video_frame_idx"])
    cx, cy, w, h = (F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height"), (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *map(T.decimals, (cx, cy, w, h)))
    lines = rows.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_id", line.alias("line")))), lambda s: s["line"]), "\n").alias("labels"))
    if class_labels is not None:
        rows = rows.join(class_labels.select("class_id", "label"), "class_id", "left")
    label = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
    label = F.coalesce("label", label) if class_labels is not None else label
    image = F.concat("name", F.lit(".jpg")).alias("image")
    documents = to_voc(rows.select(image, F.col("track_id").alias("order"), label.alias("name"), *BOX), at.select(image, "width", "height"))
    out = at.join(lines, "name", "left").join(documents.select(F.regexp_replace("image", r"\.jpg$", "").alias("name"), F.col("xml").alias("annotations")), "name")
    return out.select("video_id", (F.col(segment) if segment else F.lit(None).cast("string")).alias("segment"), "name", F.coalesce("labels", F.lit("")).alias("labels"), "annotations")


def to_voc(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(image, xml): boxes clipped to their image and rounded half to even, degenerate ones dropped, with a mark where they touch the border, in the order of their numbers.

    boxes: image, order, name, box; images: image, width, height. Images without boxes have a document too.
    """
    inside = lambda c, top: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(top).cast("double")))
    clipped = boxes.join(images, "image").select("image", "order", "name", "width", "height", *[inside(c, "width" if c[0] == "x" else "height").alias(c) for c in BOX]).where("x2 > x1 and y2 > y1")
    cut = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x2") >= F.col("width")) | (F.col("y2") >= F.col("height"))
    whole = lambda c: F.bround(c, 0).cast("bigint")
    corner = lambda tag, v: F.concat(F.lit(f"<{tag}>"), v.cast("string"), F.lit(f"</{tag}>"))
    escaped = F.replace(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    least, most = lambda c: F.greatest(whole(c), F.lit(0)), lambda c, top: F.least(whole(c), F.col(top).cast("bigint"))
    one = F.concat(
        F.lit("<object><name>"), escaped, F.lit("</name><pose>Unspecified</pose><truncated>"), cut.cast("int").cast("string"), F.lit("</truncated><difficult>0</difficult><bndbox>"),
        corner("xmin", least("x1")), corner("ymin", least("y1")), corner("xmax", most("x2", "width")), corner("ymax", most("y2", "height")), F.lit("</bndbox></object>"),
    )
    objects = clipped.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", one.alias("xml")))), lambda o: o["xml"]), "").alias("objects"))
    head = F.concat(F.lit("<annotation><folder>images</folder><filename>"), F.col("image").cast("string"), F.lit("</filename><size><width>"), F.col("width").cast("string"), F.lit("</width><height>"), F.col("height").cast("string"), F.lit("</height><depth>3</depth></size><segmented>0</segmented>"))
    return images.join(objects, "image", "left").select("image", F.concat(head, F.coalesce("objects", F.lit("")), F.lit("</annotation>")).alias("xml"))


def class_ids(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(label, class_id) of all labels (label, position) and known ones (label, class_id), as they would be named one after another.

    A known label keeps its id. Of the new ones, by their first positions, ``class_N`` gets N, any other the number of labels that
    are known by then: both kinds count, and ids may come twice. Null labels have none. Labels are numbered over ranges of their
    first positions, so no task has to go through them all.
    """
    first = labels.where("label is not null").groupBy("label").agg(F.min("position").alias("position"))
    fresh = numbered(first.join(known.select("label"), "label", "left_anti"), [F.col("position"), F.col("label")], "__n")
    size = known.agg(F.countDistinct("label").alias("__known"))  # one row
    given = F.regexp_extract("label", r"^class_([0-9]+)$", 1)
    own = F.coalesce(given.try_cast("bigint"), F.col("__known") + F.col("__n") - 1)
    return known.select("label", F.col("class_id").cast("bigint").alias("class_id")).distinct().unionByName(fresh.join(F.broadcast(size)).select("label", own.alias("class_id")))


def same_label(a: Column, b: Column) -> Column:
    """Labels without case and outer white space; an empty one agrees with all."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return ~(given(a) & given(b)) | (F.lower(F.trim(a)) == F.lower(F.trim(b)))


def compare_box_sets(candidates: DataFrame, refs: DataFrame, cands: DataFrame) -> DataFrame:
    """(video_id, frame_id, tp, extra, missed): pairs are matched from the best iou down, ties by the higher reference, then candidate.

    candidates: (video_id, frame_id, l, r, iou) as ``fusion.iou_join`` gives them. Where refs and cands, with their det_idx, have
    a column ``label``, pairs of different labels don't match. The choice goes in rounds over all images at once.
    """
    if "label" in refs.columns and "label" in cands.columns:
        side = lambda df, k: df.select("video_id", "frame_id", F.col("det_idx").alias(k), F.col("label").alias(f"{k}_label"))
        candidates = candidates.join(side(refs, "l"), ["video_id", "frame_id", "l"]).join(side(cands, "r"), ["video_id", "frame_id", "r"]).where(same_label(F.col("l_label"), F.col("r_label")))
    image = ["video_id", "frame_id"]
    taken = graphs.chosen_pairs(candidates.select(*image, "l", "r", "iou"), [*image, "l"], [*image, "r"], F.struct("iou", "l", "r"))
    matched = taken.groupBy(*image).agg(F.count("*").alias("tp"))
    count = lambda df, c: df.groupBy(*image).agg(F.count("*").alias(c))
    both = count(refs, "n_ref").join(count(cands, "n_cand"), image, "full").join(matched, image, "left").fillna(0, ["n_ref", "n_cand", "tp"])
    return both.select(*image, "tp", (F.col("n_cand") - F.col("tp")).alias("extra"), (F.col("n_ref") - F.col("tp")).alias("missed"))


def floor_percentile(frames: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, value at the index floor((n - 1) q) of the key's sorted values): equal values are counted first, and of the running counts the one is taken that passes the index."""
    counts = frames.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(value)
    rows = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return rows.where(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(q))).groupBy(key).agg(F.min(value).alias(value))


def summarize_runs(frames: DataFrame, baseline: int, compared: DataFrame | None = None) -> DataFrame:
    """Of frames (run, seconds, boxes): rates, median and 95th percentile of the seconds, speed-up over the run ``baseline``, and, with ``compared`` (run, tp, extra, missed), precision and recall against it, null where there is nothing to divide by and for the baseline itself."""
    runs = frames.groupBy("run").agg(F.count("*").alias("frames"), F.sum("seconds").alias("seconds"), F.sum("boxes").alias("boxes"), F.median("seconds").alias("p50"))
    runs = runs.join(floor_percentile(frames, "run", "seconds", 0.95).withColumnRenamed("seconds", "p95"), "run")
    rated = runs.select("run", "frames", (F.col("frames") / F.col("seconds")).alias("fps"), (F.col("boxes") / F.col("seconds")).alias("boxes_per_second"), "p50", "p95")
    base = rated.where(F.col("run") == baseline).agg(F.max("fps").alias("base"))  # one row
    out = rated.join(F.broadcast(base)).withColumn("speed_up", F.col("fps") / F.col("base")).drop("base")
    if compared is None:
        return out
    sums = compared.where(F.col("run") != baseline).groupBy("run").agg(*[F.sum(c).alias(c) for c in ("tp", "extra", "missed")])
    share = lambda other: F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0).cast("bigint"))
    return out.join(sums.select("run", share("extra").alias("precision"), share("missed").alias("recall")), "run", "left")


#: Columns of a summary and their digits in its table: those of ``summarize_runs``.
SUMMARY = {"run": None, "frames": None, "fps": 4, "speed_up": 2, "boxes_per_second": 3, "p50": 3, "p95": 3, "precision": 3, "recall": 3}


def summary_files(runs: DataFrame, baseline: str) -> DataFrame:
    """(name, content) of a summary as summary.csv, summary.json and summary.md, runs in their order, to be written by ``folders.write_files``.

    Values have six digits in the first two, nulls are empty there and null in JSON; the table rounds halves up and shows a dash.
    Runs are a handful of rows, which meet in three texts.
    """
    have = [c for c in SUMMARY if c in runs.columns]
    fixed = lambda c, d: F.col(c).cast("string") if d is None else F.format_string(f"%.{d}f", F.floor(F.col(c) * 10**d + 0.5) / 10**d)
    value = lambda c, none: F.when(F.col(c).isNull(), none).otherwise(fixed(c, None if SUMMARY[c] is None else 6))
    quoted = F.regexp_replace(F.to_json(F.array("run")), r"^\[|\]$", "")  # a text or a number
    line = {
        "csv": F.concat_ws(",", *[value(c, "") for c in have]),
        "json": F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), quoted if c == "run" else value(c, "null")) for c in have]), F.lit("}")),
        "md": F.concat(F.lit("| "), F.concat_ws(" | ", *[F.when(F.col(c).isNull(), "-").otherwise(fixed(c, SUMMARY[c])) for c in have]), F.lit(" |")),
    }
    rows = runs.agg(F.array_sort(F.collect_list(F.struct("run", *[v.alias(k) for k, v in line.items()]))).alias("r"))
    text = lambda kind, between: F.array_join(F.transform("r", lambda x: x[kind]), between)
    table = "| " + " | ".join(have) + " |\n|" + "---:|" * len(have) + "\n"
    contents = {
        "summary.csv": F.concat(F.lit(",".join(have) + "\n"), text("csv", "\n"), F.lit("\n")),
        "summary.json": F.concat(F.lit(f'{{"baseline": "{baseline}", "cases": ['), text("json", ", "), F.lit("]}")),
        "summary.md": F.concat(F.lit(f"Compared with the output of `{baseline}`, which is no ground truth.\n\n{table}"), text("md", "\n"), F.lit("\n")),
    }
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("content")) for k, v in contents.items()])).alias("f")).select("f.*")
