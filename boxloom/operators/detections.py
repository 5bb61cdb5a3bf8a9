"""Filters over detections: one row a box with image_id, detector, pos, label, score, x0..y1, width, height.

All are narrow but for the pooled labels, which use the image's partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g

#: Detectors in the order in which they are read.
DETECTORS = ("yw", "ow", "gd", "od")


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds of the filters; the defaults are the pipeline's."""

    score: dict[str, float] = field(default_factory=lambda: {"yw": 0.145, "ow": 0.175, "gd": 0.195, "od": 0.285})
    min_side: float = 0.05
    min_area: float | None = None
    max_area: float = 0.60
    edge_cut: float = 0.35
    shared_style: float = 0.35


def drop_blank_labels(boxes: DataFrame) -> DataFrame:
    return boxes.where(F.length(F.trim("label")) > 0)


def score_threshold(boxes: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Per-detector threshold, inclusive; detectors without one are dropped. One CASE, no join."""
    limit = F.lit(None).cast("double")
    for name, value in config.score.items():
        limit = F.when(F.col("detector") == name, value).otherwise(limit)
    return boxes.where(F.col("score") >= limit)


def strict_score(boxes: DataFrame, least: float) -> DataFrame:
    return boxes.where(F.col("score") > least)


def with_validity(boxes: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Adds clamped corners c*, area_px and reject (null, outside, edge_cut, thin or over_max), tested in this order."""
    w, h = F.col("width"), F.col("height")
    out = boxes.withColumns({f"c{c}": F.least(F.greatest(F.col(c), F.lit(0)), w if c[0] == "x" else h) for c in ("x0", "y0", "x1", "y1")})
    out = out.withColumn("area_px", (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0")))
    bw, bh = F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")
    small = (F.col("area_px") < config.min_area * w * h) if config.min_area is not None else ((bw < config.min_side * w) | (bh < config.min_side * h))
    reject = (
        F.when((F.col("x0") > w) | (F.col("y0") > h) | (F.col("x1") < 0) | (F.col("y1") < 0), "outside")
        .when(F.col("area_px") < config.edge_cut * g.area(g.box()), "edge_cut")
        .when(small, "thin")
        .when(F.col("area_px") > config.max_area * w * h, "over_max")
    )
    return out.withColumn("reject", reject)


def valid_boxes(tested: DataFrame) -> DataFrame:
    """Survivors of with_validity, clamped."""
    return tested.where("reject is null").withColumns({c: F.col(f"c{c}") for c in ("x0", "y0", "x1", "y1")})


def drop_shared_style(tested: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Valid boxes without large ones whose label was over-max anywhere in the image, in any detector."""
    pooled = F.max(F.when(F.col("reject") == "over_max", 1).otherwise(0)).over(Window.partitionBy("image_id", "label"))
    marked = tested.withColumn("pooled", pooled).where("reject is null")
    return valid_boxes(marked.where((F.col("pooled") == 0) | ~(F.col("area_px") > config.shared_style * F.col("width") * F.col("height")))).drop("pooled")


def over_max_labels(tested: DataFrame) -> DataFrame:
    """(image_id, label) of over-max boxes."""
    return tested.where("reject = 'over_max'").select("image_id", "label").distinct()


def funnel(boxes: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Boxes left after each step, by image and detector; one pass."""
    tested = with_validity(boxes, config)
    named = F.length(F.trim("label")) > 0
    limit = F.lit(None).cast("double")
    for name, value in config.score.items():
        limit = F.when(F.col("detector") == name, value).otherwise(limit)
    scored = named & (F.col("score") >= limit)
    count = lambda c: F.count_if(c)
    return tested.groupBy("image_id", "detector").agg(
        F.count("*").alias("n_all"),
        count(named).alias("n_named"),
        count(scored).alias("n_scored"),
        *[count(scored & (F.col("reject") == r)).alias(f"n_{r}") for r in ("outside", "edge_cut", "thin", "over_max")],
        count(scored & F.col("reject").isNull()).alias("n_valid"),
    )
