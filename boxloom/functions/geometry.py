"""Box expressions. A box is any struct or row with x0, y0, x1, y1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> Column:
    """The box of a row, from columns with a prefix."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, w * 0) * F.greatest(h, h * 0)


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    return _ratio(intersection(a, b), union_area(a, b))


def ioa(a: Column, b: Column) -> Column:
    """Shared area over the first box's area."""
    return _ratio(intersection(a, b), area(a))


def overlap_min_area(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def hull(a: Column, b: Column) -> Column:
    """The smallest box around two."""
    return F.struct(*[f(a[c], b[c]).alias(c) for f, c in ((F.least, "x0"), (F.least, "y0"), (F.greatest, "x1"), (F.greatest, "y1"))])


def inside(a: Column, b: Column) -> Column:
    """Whether a lies in b; sides may touch."""
    return (a["x0"] >= b["x0"]) & (a["y0"] >= b["y0"]) & (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"])


def guarded_inside(a: Column, b: Column) -> Column:
    """Whether a lies in b and b's score is good enough to stand for it."""
    return inside(a, b) & ((b["score"] >= 0.25) | (b["score"] >= 0.5 * a["score"]))


def closeness(b: Column) -> Column:
    """How near a normalised box's centre is to the image's centre; 0 in a corner."""
    dx, dy = (b["x0"] + b["x1"]) / 2 - 0.5, (b["y0"] + b["y1"]) / 2 - 0.5
    return F.lit(math.sqrt(2) / 2) - F.sqrt(dx * dx + dy * dy)


def normalise(b: Column, w: Column, h: Column) -> Column:
    """Pixels to [0, 1]."""
    return F.struct((b["x0"] / w).alias("x0"), (b["y0"] / h).alias("y0"), (b["x1"] / w).alias("x1"), (b["y1"] / h).alias("y1"))


def to_pixels(b: Column, w: Column, h: Column) -> Column:
    return F.struct((b["x0"] * w).alias("x0"), (b["y0"] * h).alias("y0"), (b["x1"] * w).alias("x1"), (b["y1"] * h).alias("y1"))


def transform_box(b: Column, w: Column, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0, flip: bool = False) -> Column:
    """Scale, take off a crop's offset, and mirror within width w."""
    x0, y0, x1, y1 = b["x0"] * scale - dx, b["y0"] * scale - dy, b["x1"] * scale - dx, b["y1"] * scale - dy
    if flip:
        x0, x1 = w - x1, w - x0
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def novelty(overlap: Column) -> Column:
    """Gain of a box whose (label-doubled) overlap with what was sampled is given."""
    return F.lit(2.0) / (overlap + 0.5)


def stage3_score(norm_area: Column, near: Column) -> Column:
    """Static weight of the equal-contribution sampler."""
    return 0.05 + 2 * math.sqrt(2) * norm_area + near


def stage4_score(votes: Column, extra: Column) -> Column:
    """Weight from other detectors' votes for one label."""
    return 0.1 + 1.2 * votes / (votes + 1.0) + 2.0 * extra


def stage5_score(cover: Column, extra: Column) -> Column:
    """Weight that prefers boxes little covered by others."""
    return 0.01 + 99.0 / (0.8 + cover) + 1.5 * extra


def place_text(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, corner: str = "top_left") -> Column:
    """Box of a text of size (w, h) with one corner at (x, y), moved into the image; a text larger than the image is cut at its end."""
    left = x - w if corner.endswith("right") else x
    top = y - h if corner.startswith("bottom") else y

    def side(start: Column, size: Column, end: Column) -> tuple[Column, Column]:
        start = F.greatest(start, F.lit(0))
        return F.greatest(F.least(start, end - size), F.lit(0)), F.least(start + size, end)

    (x0, x1), (y0, y1) = side(left, w, width), side(top, h, height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
