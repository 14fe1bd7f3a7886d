"""Box geometry as column expressions. A box is four DOUBLE columns; functions that may drop a box return null."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in zip(self._fields, self, strict=True)])


def unpack(box: Column) -> Box:
    return Box(*[box[c] for c in Box._fields])


def _within(v: Column, top: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), top)


def clip_bbox(b: Box, width: Column, height: Column) -> Column:
    """Clamped to [0, W-1] x [0, H-1]; null if nothing is left."""
    c = Box(_within(b.x1, width - 1.0), _within(b.y1, height - 1.0), _within(b.x2, width - 1.0), _within(b.y2, height - 1.0))
    return F.when((c.x2 > c.x1) & (c.y2 > c.y1), c.struct())


def clip_bbox_editor(b: Box, width: Column, height: Column) -> Column:
    """Clamped to [0, W] x [0, H]; never dropped."""
    w, h = width.cast("double"), height.cast("double")
    return Box(_within(b.x1, w), _within(b.y1, h), _within(b.x2, w), _within(b.y2, h)).struct()


def yolo_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return clip_bbox(Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height), width, height)


def bbox_to_xywh(b: Box) -> Column:
    """Centre and size; a negative size is 0."""
    cx, cy = center(b)
    return F.struct(cx.alias("cx"), cy.alias("cy"), F.greatest(b.x2 - b.x1, F.lit(0.0)).alias("w"), F.greatest(b.y2 - b.y1, F.lit(0.0)).alias("h"))


def xywh_to_bbox(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    w, h = F.greatest(w, F.lit(0.0)) / 2, F.greatest(h, F.lit(0.0)) / 2
    return Box(cx - w, cy - h, cx + w, cy + h)


def area(b: Box) -> Column:
    return F.greatest(b.x2 - b.x1, F.lit(0.0)) * F.greatest(b.y2 - b.y1, F.lit(0.0))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def iou(a: Box, b: Box) -> Column:
    """0 where the intersection or the union is empty."""
    both = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0)) * F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def round_bbox_int(b: Box, width: Column, height: Column) -> Column:
    """Clipped, then rounded half to even; zeros where nothing is left."""
    c = clip_bbox(b, width, height)
    return F.struct(*[F.coalesce(F.bround(c[n], 0), F.lit(0.0)).cast("int").alias(n) for n in Box._fields])


def expand_bbox(b: Box, ratio: float) -> Box:
    """Width and height scaled by 1 + ratio about the centre."""
    (cx, cy), w, h = center(b), (b.x2 - b.x1) * (1 + ratio) / 2, (b.y2 - b.y1) * (1 + ratio) / 2
    return Box(cx - w, cy - h, cx + w, cy + h)


def buffered_iou(a: Box, b: Box, ratio: float) -> Column:
    return iou(expand_bbox(a, ratio), expand_bbox(b, ratio))


def pseudo_depth(b: Box, height_weight: float) -> Column:
    return b.y2 + max(0.0, height_weight) * (b.y2 - b.y1)


def depth_bin(depth: Column, low: Column, high: Column, bins: int) -> Column:
    """0 is nearest, that is deepest in the picture."""
    share = F.when(high > low, (high - depth) / (high - low)).otherwise(0.0)
    return F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def direction_affinity(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(1 + cosine) / 2; 0.5 where a direction is unknown."""
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    return F.coalesce(F.when((na > 1e-6) & (nb > 1e-6), ((ax * bx + ay * by) / (na * nb) + 1) / 2), F.lit(0.5))


def height_affinity(a: Box, b: Box) -> Column:
    ha, hb = F.greatest(a.y2 - a.y1, F.lit(1.0)), F.greatest(b.y2 - b.y1, F.lit(1.0))
    return F.least(ha, hb) / F.greatest(ha, hb)


def interpolate_bbox(a: Box, b: Box, t: Column) -> Box:
    return Box(*[p + (q - p) * t for p, q in zip(a, b, strict=True)])


def percent_to_xyxy(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A percent box in pixels, as round_bbox_int leaves it."""
    return round_bbox_int(Box(x / 100 * width, y / 100 * height, (x + w) / 100 * width, (y + h) / 100 * height), width, height)


def make_even(v: Column) -> Column:
    return (v + F.pmod(v, F.lit(2))).cast("int")


def track_color(track_id: Column) -> Column:
    return F.struct(F.pmod(track_id * 37 + 80, F.lit(256)).cast("int").alias("r"), F.pmod(track_id * 97 + 140, F.lit(256)).cast("int").alias("g"), F.pmod(track_id * 17 + 220, F.lit(256)).cast("int").alias("b"))


def scale_grid(v: Column, size: Column, grid: int = 1000) -> Column:
    return v / grid * size


def to_square(b: Box, width: Column, height: Column, size: int = 1008) -> Box:
    """A box of a picture in the square grid of ``size`` that a model reads, each axis scaled by itself."""
    sx, sy = size / width.cast("double"), size / height.cast("double")
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def crop_window(b: Box, crop_w: Column, crop_h: Column, width: Column, height: Column) -> Column:
    """The window's corner and the paddings where it leaves the picture."""
    cx, cy = center(b)
    x, y = F.bround(cx - crop_w / 2, 0), F.bround(cy - crop_h / 2, 0)
    zero = F.lit(0.0)
    pads = (F.greatest(-x, zero), F.greatest(-y, zero), F.greatest(x + crop_w - width, zero), F.greatest(y + crop_h - height, zero))
    return F.struct(x.cast("int").alias("x1"), y.cast("int").alias("y1"), *[p.cast("int").alias(n) for p, n in zip(pads, ("left", "top", "right", "bottom"), strict=True)])
