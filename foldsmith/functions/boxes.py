"""Boxes as column expressions: forms, clipping, geometry, overlap [P2, P3, P6-P10, P14, P22, P23, F4, F14]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A centre box in pixels, clipped to the image; the far edge stays where it is."""
    x1, y1 = F.greatest(F.lit(0.0), cx - w / 2), F.greatest(F.lit(0.0), cy - h / 2)
    x2, y2 = F.least(width.cast("double"), cx + w / 2), F.least(height.cast("double"), cy + h / 2)
    return from_corners(x1, y1, x2, y2)


def from_normal_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A centre box in fractions of the image, clipped."""
    return from_centre(cx * width, cy * height, w * width, h * height, width, height)


def from_normal_centre_whole(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A centre box in fractions of the image, not clipped."""
    return box(cx * width - w * width / 2, cy * height - h * height / 2, w * width, h * height)


def to_corners(b: Column) -> Column:
    return F.array(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])


def to_normal_centre(b: Column, width: Column, height: Column) -> Column:
    """Cx, cy, w, h in fractions of the valid area."""
    return F.array((b["x"] + b["w"] / 2) / width, (b["y"] + b["h"] / 2) / height, b["w"] / width, b["h"] / height)


def has_area(b: Column) -> Column:
    """P2."""
    return (b["w"] > 0) & (b["h"] > 0)


def min_side(b: Column, least: float) -> Column:
    """P4; 0 lets all through."""
    return F.least(b["w"], b["h"]) >= least if least else F.lit(True)


def inside(b: Column, width: Column, height: Column, slack: float = 1.0) -> Column:
    """Positive and inside the image, up to `slack` pixels."""
    return has_area(b) & (b["x"] >= -slack) & (b["y"] >= -slack) & (b["x"] + b["w"] <= width + slack) & (b["y"] + b["h"] <= height + slack)


def flip(b: Column, width: Column) -> Column:
    """P10: mirrored left to right."""
    return box(width - b["x"] - b["w"], b["y"], b["w"], b["h"])


def frame(width: Column, height: Column, fixed_square: bool, padded: bool) -> tuple[Column, Column]:
    """What box fractions refer to: the padded square's side, or the image itself."""
    side = F.greatest(width, height)
    return (side, side) if fixed_square and not padded else (width, height)


def short_side_size(width: Column, height: Column, size: int, most: int) -> tuple[Column, Column]:
    """(width, height) after the short side becomes `size`, no side beyond `most`; half-even rounding."""
    low, high = F.least(width, height).cast("double"), F.greatest(width, height).cast("double")
    short = F.when(high / low * size > most, F.bround(most * low / high)).otherwise(F.lit(float(size)))
    long = F.bround(short * high / low)
    wide = height <= width
    return F.when(wide, long).otherwise(short).cast("int"), F.when(wide, short).otherwise(long).cast("int")


def square_scale(width: Column, height: Column, size: int) -> Column:
    """Factor of coordinates when an image is padded to a square and resized."""
    return size / F.greatest(width, height)


def iou(a: Column, b: Column) -> Column:
    """intersection over union; 0 if the union is empty."""
    iw = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - iw * ih
    return F.when(union > 0, iw * ih / union).otherwise(0.0)


def grid(v: Column, tolerance: float = 0.05) -> Column:
    """place on a grid, half-even; compare these whole numbers."""
    return F.bround(v / tolerance).cast("long")


def default_area(area: Column, b: Column) -> Column:
    """The area as given, else width times height."""
    return F.coalesce(area, b["w"] * b["h"])
