"""Equal-contribution sampling (stage 3) and the reports about detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions.rng import uniform, uniform_int

from .detections import DETECTORS


def caps(boxes: DataFrame, seed: int = 0, low: int = 18, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """(image_id, cap): one uniform draw between the least and the greatest contribution; absent detectors count as 0."""
    counts = boxes.groupBy("image_id").agg(*[F.count_if(F.col("detector") == d).alias(d) for d in detectors])
    hi, lo = F.greatest(*detectors), F.least(*detectors)
    counts = counts.select("image_id", hi.alias("hi"), F.when(hi >= low, F.greatest(lo, F.lit(low))).otherwise(hi).alias("lo"))
    return counts.select("image_id", uniform_int(uniform(seed, F.lit("cap"), "image_id"), F.col("lo"), F.col("hi")).alias("cap"))


def equal_contribution(boxes: DataFrame, seed: int = 0, low: int = 18) -> DataFrame:
    """At most `cap` boxes of each detector and image, drawn by weight without replacement.

    Weights do not change between draws, so the draw equals keeping the largest
    ln(u) / w (Efraimidis and Spirakis, 2006). The cap comes from windows over
    the image, so one exchange on image_id serves everything.
    """
    per = Window.partitionBy("image_id")
    w = boxes
    for d in DETECTORS:
        w = w.withColumn(f"_{d}", F.count_if(F.col("detector") == d).over(per))
    hi, lo = F.greatest(*[f"_{d}" for d in DETECTORS]), F.least(*[f"_{d}" for d in DETECTORS])
    cap = uniform_int(uniform(seed, F.lit("cap"), "image_id"), F.when(hi >= low, F.greatest(lo, F.lit(low))).otherwise(hi), hi)
    norm = g.normalise(g.box(), F.col("width"), F.col("height"))
    weight = g.stage3_score(g.area(norm), g.closeness(norm))
    key = F.log(F.greatest(uniform(seed, F.lit("s3"), "image_id", "detector", "pos"), F.lit(1e-300))) / weight
    w = w.withColumn("_cap", cap).withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy("image_id", "detector").orderBy(F.desc("_key"), "pos"))
    return w.withColumn("_rank", rank).where("_rank <= _cap").select(*boxes.columns)


def contribution(boxes: DataFrame, detectors: tuple[str, ...] = DETECTORS, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Boxes of each detector by image, or by image and replica, zeros kept."""
    return boxes.groupBy(*by).agg(*[F.count_if(F.col("detector") == d).alias(f"n_{d}") for d in detectors], F.count("*").alias("n_boxes"), F.count_distinct("label").alias("n_labels"))


def label_rollup(boxes: DataFrame) -> DataFrame:
    """Boxes and summed scores (in ten-thousandths, so exact) by detector and label with subtotals; missing levels read (all)."""
    r = boxes.rollup("detector", "label").agg(F.count("*").alias("n_boxes"), F.sum(F.round(F.col("score") * 10000).cast("long")).alias("score_sum"), F.grouping_id().alias("level"))
    return r.select(F.coalesce("detector", F.lit("(all)")).alias("detector"), F.coalesce("label", F.lit("(all)")).alias("label"), "n_boxes", "score_sum", F.col("level").cast("long"))
