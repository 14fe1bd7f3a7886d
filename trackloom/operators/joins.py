"""Joins on overlap: boxes by grids, intervals by bins. Each pair is found in one place only, so nothing has to be made distinct."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

BOX = ["x1", "y1", "x2", "y2"]
FRAME = ["video_id", "frame_id"]


def _celled(df: DataFrame, levels: int) -> DataFrame:
    """Each box once for each cell of its own level and of the ``levels`` above it: of level n the cells have sides of 2^n, and a box's own has the smallest cells that are no smaller than its sides. Boxes without area meet nothing and go."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    own = df.where("x2 > x1 and y2 > y1").withColumn("own", F.ceil(F.log2(side)).cast("int"))
    own = own.withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + levels)))
    cells = lambda c: F.explode(F.sequence(*[F.floor(F.col(f"{c}{k}") / F.pow(F.lit(2.0), "level")).cast("bigint") for k in (1, 2)]))
    return own.withColumn("cx", cells("x")).withColumn("cy", cells("y"))


def near_boxes(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The pairs of boxes of a frame that a grid leaves to be looked at for an overlap of ``least`` or more: l_ and r_ columns of both.

    An overlap of t means that the longer sides differ by 1 / t at most, so pairs meet on the level of the larger box, where either
    covers four cells at most. They are kept in the cell that holds the corner of what they share.
    """
    levels = math.ceil(math.log2(1 / least))
    named = lambda df, side: _celled(df, levels).select(*FRAME, "level", "cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in ("det_idx", "own", *BOX)])
    at = lambda axis: F.floor(F.greatest(f"l_{axis}1", f"r_{axis}1") / F.pow(F.lit(2.0), "level")).cast("bigint") == F.col(f"c{axis}")
    once = (F.col("level") == F.greatest("l_own", "r_own")) & at("x") & at("y")
    return named(left, "l").join(named(right, "r"), [*FRAME, "level", "cx", "cy"]).where(once).drop("level", "cx", "cy", "l_own", "r_own")


def iou_join(left: DataFrame, right: DataFrame, least: float, crowd: int = 256) -> DataFrame:
    """Detections of the same video and frame that overlap by ``least`` or more: (video_id, frame_id, l, r, iou), l and r being det_idx.

    Frames with up to ``crowd`` boxes on a side are joined as they are; in fuller ones a grid finds the boxes near each other, so
    that the work grows with those. A ``least`` below 1/64 bounds no sizes: then all of a frame's boxes meet.
    """
    named = lambda df, side: df.select(*FRAME, *[F.col(c).alias(f"{side}_{c}") for c in ("det_idx", *BOX)])
    if least < 1 / 64:
        pairs = named(left, "l").join(named(right, "r"), FRAME)
    else:
        full = lambda df: df.groupBy(*FRAME).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*FRAME)
        crowded = full(left).union(full(right)).distinct()
        few = named(left.join(crowded, FRAME, "left_anti"), "l").join(named(right, "r"), FRAME)
        many = near_boxes(left.join(crowded, FRAME, "left_semi"), right.join(crowded, FRAME, "left_semi"), least)
        pairs = few.unionByName(many)
    found = pairs.withColumn("iou", G.iou(G.Box.of("l_"), G.Box.of("r_"))).where((F.col("iou") > 0) & (F.col("iou") >= least))
    return found.select(*FRAME, F.col("l_det_idx").alias("l"), F.col("r_det_idx").alias("r"), *[f"{s}_{c}" for s in "lr" for c in BOX], "iou")


def window_overlaps(sessions: DataFrame, windows: DataFrame, now: Column, bin_seconds: int = 86400) -> DataFrame:
    """The columns of ``windows`` (with begins and ends) and of ``sessions`` (with started_at and ended_at), and clipped_seconds, for each window that a session reaches into.

    A session without end lasts until ``now``; windows are half open, and sessions that only touch one aren't in it. Both are dealt
    to bins of time, and a pair is kept in the bin where its overlap begins. Bins should be about as long as the windows: a
    session has a row for each bin it reaches into. Backward sessions and empty windows meet nothing; null starts neither.
    """
    bins = lambda t: F.floor(F.unix_micros(t) / (bin_seconds * 1_000_000)).cast("bigint")
    covered = lambda a, b: F.explode(F.sequence(bins(a), bins(b)))
    as_time = lambda c: F.col(c).cast("timestamp")
    s = sessions.withColumn("__a", as_time("started_at")).withColumn("__b", F.coalesce(as_time("ended_at"), now.cast("timestamp"))).where("__b > __a").withColumn("__bin", covered(F.col("__a"), F.col("__b")))
    w = windows.withColumn("__c", as_time("begins")).withColumn("__d", as_time("ends")).where("__d > __c").withColumn("__bin", covered(F.col("__c"), F.col("__d")))
    begin, end = F.greatest("__a", "__c"), F.least("__b", "__d")
    met = w.join(s, "__bin").where((end > begin) & (bins(begin) == F.col("__bin")))
    return met.withColumn("clipped_seconds", (F.unix_micros(end) - F.unix_micros(begin)) / 1e6).drop("__a", "__b", "__c", "__d", "__bin")
