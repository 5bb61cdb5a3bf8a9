"""Containment removal, NMS and top-k inside groups, as folds over small arrays.

Groups are one image's boxes of one detector and label, so arrays are short; a
plan has one exchange on the group keys, or none if the input is partitioned by
the image already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g

GROUP = ("image_id", "detector", "label")
_FAR = 1_000_000


def _gather(boxes: DataFrame, group: tuple[str, ...], order: Column) -> DataFrame:
    rest = [c for c in boxes.columns if c not in group]
    row = F.struct(order.alias("_o"), *[F.col(c) for c in rest])
    return boxes.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("a"))


def _spread(grouped: DataFrame, kept: Column, boxes: DataFrame, group: tuple[str, ...]) -> DataFrame:
    rest = [c for c in boxes.columns if c not in group]
    return grouped.select(*group, F.explode(kept).alias("b")).select(*[F.col(c) if c in group else F.col(f"b.{c}").alias(c) for c in boxes.columns if c in group or c in rest])


def containment_removal(boxes: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The ordered fold: box i goes if a later alive box holds it, after taking with it the boxes before that one that it holds."""
    grouped = _gather(boxes, group, F.struct("pos"))
    a, n = F.col("a"), F.size("a")
    at = lambda i: F.element_at(a, i)

    def step(dead: Column, i: Column) -> Column:
        first = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), lambda j: (j > i) & ~F.element_at(dead, j) & g.guarded_inside(at(i), at(j)))), F.lit(_FAR))

        def with_first(p: Column) -> Column:
            held = lambda j: (j > i) & (j < p) & g.guarded_inside(at(j), at(i))
            return F.transform(dead, lambda x, k: x | held(k + 1) | ((k + 1 == i) & (p < _FAR)))

        return F.when(F.element_at(dead, i), dead).otherwise(F.element_at(F.transform(F.array(first), with_first), 1))

    # One flag a box, so that a step costs what the group has and all steps its square.
    dead = F.aggregate(F.sequence(F.lit(1), n), F.array_repeat(F.lit(False), n), step)
    marked = grouped.withColumn("dead", dead)
    return _spread(marked, F.filter("a", lambda b, i: ~F.element_at(F.col("dead"), i + 1)), boxes, group)


def nms(boxes: DataFrame, threshold: float = 0.4, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Best score first (ties by pos); a box stays if no kept box overlaps it by more than the threshold."""
    grouped = _gather(boxes, group, F.struct((-F.col("score")).alias("s"), F.col("pos")))
    clash = lambda k, b: g.intersection(k, b) > F.lit(threshold) * g.union_area(k, b)
    kept = F.aggregate(F.slice("a", 2, F.size("a")), F.slice("a", 1, 1), lambda acc, b: F.when(F.exists(acc, lambda k: clash(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return _spread(grouped, kept, boxes, group)


def top_k(boxes: DataFrame, k: int, group: tuple[str, ...] = ("image_id",), order: list[Column] | None = None) -> DataFrame:
    """The k best of each group; ties by detector and pos."""
    w = Window.partitionBy(*group).orderBy(*(order or [F.desc("score"), "detector", "pos"]))
    return boxes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
