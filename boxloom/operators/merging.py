"""Greedy box merges, and the alternate chain of steps that uses them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.rng import uniform_py

from . import detections, suppress
from .replicas import areas, ious, shared_areas

FIELDS = "image_id long, detector string, label string, score double, x0 double, y0 double, x1 double, y1 double, pos int"
CORNERS = ["x0", "y0", "x1", "y1"]


def _join(boxes: np.ndarray, i: int, j: int) -> np.ndarray:
    both = boxes[[i, j]]
    return np.concatenate([np.delete(boxes, [i, j], axis=0), [[*both[:, :2].min(axis=0), *both[:, 2:].max(axis=0)]]])


def _min_ratio(boxes: np.ndarray) -> np.ndarray:
    size = areas(boxes)
    least = np.minimum(size[:, None], size[None, :])
    return np.divide(shared_areas(boxes, boxes), least, out=np.zeros_like(least, float), where=least > 0)


def merge_slices(boxes: np.ndarray, scores: list[float], threshold: float = 0.3, choose: str = "last") -> tuple[np.ndarray, list[float]]:
    """Pairs that share more than the threshold of the smaller area become their hull, the better score stays.

    The next pair is the last one above the threshold in row order, or with "max" the one that shares most.
    """
    while len(boxes) > 1:
        ratio = np.triu(_min_ratio(boxes), 1)
        if not (ratio > threshold).any():
            break
        i, j = (int(x) for x in (np.argwhere(ratio > threshold)[-1] if choose == "last" else np.unravel_index(ratio.argmax(), ratio.shape)))
        best = max(scores[i], scores[j])
        boxes = _join(boxes, i, j)
        scores = [s for k, s in enumerate(scores) if k not in (i, j)] + [best]
    return boxes, scores


def merge_same_places(boxes: np.ndarray, members: list[list[int]], threshold: float = 0.9) -> tuple[np.ndarray, list[list[int]]]:
    """The pair of greatest IoU becomes its hull with both member lists, while it is at least the threshold."""
    while len(boxes) > 1:
        iou = np.triu(ious(boxes, boxes), 1)
        if iou.max() <= 0 or iou.max() < threshold:
            break
        i, j = (int(x) for x in np.unravel_index(iou.argmax(), iou.shape))
        boxes = _join(boxes, i, j)
        members = [m for k, m in enumerate(members) if k not in (i, j)] + [members[i] + members[j]]
    return boxes, members


def _by_image(boxes: DataFrame, run: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    wanted = [F.col(name).cast(kind) for name, kind in map(str.split, FIELDS.split(", "))]
    return boxes.select(wanted).groupBy("image_id").applyInArrow(run, FIELDS)


def _corners(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows[c].to_numpy() for c in CORNERS])


def _placed(rows: pa.Table, corners: np.ndarray, score: Sequence[float] | pa.ChunkedArray, pos: Sequence[int]) -> pa.Table:
    """Rows with other corners, scores and pos."""
    own = [rows[c] for c in ("image_id", "detector", "label")]
    return pa.table([*own, score if isinstance(score, pa.ChunkedArray) else pa.array(score, pa.float64()), *map(pa.array, corners.T), pa.array(pos, pa.int32())], names=[f.split()[0] for f in FIELDS.split(", ")])


def slice_merge(boxes: DataFrame, threshold: float = 0.3, choose: str = "last", detectors: tuple[str, ...] | None = None) -> DataFrame:
    """merge_slices in each (image, detector, label), of all detectors or those named, others' boxes stay; pos numbers the results. An image is one group, not each of its labels."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("detector", "label", "pos")])
        corners, scores, pos = _corners(rows), rows["score"].to_pylist(), rows["pos"].to_pylist()
        names = list(zip(rows["detector"].to_pylist(), rows["label"].to_pylist(), strict=True))
        starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
        at, parts, best, numbers = [], [], [], []
        for i, k in zip(starts, [*starts[1:], len(names)], strict=True):
            merged, kept, mine = corners[i:k], scores[i:k], pos[i:k]
            if detectors is None or names[i][0] in detectors:
                merged, kept = merge_slices(merged, kept, threshold, choose)
                mine = range(len(merged))
            parts.append(merged)
            at += [i] * len(merged)
            best += kept
            numbers += mine
        return _placed(rows.take(at), np.concatenate(parts), best, numbers)

    return _by_image(boxes, run)


def iou_label_merge(boxes: DataFrame, threshold: float = 0.9, seed: int = 0) -> DataFrame:
    """merge_same_places in each image, in a hashed order; one label and score of each merged box's members is drawn."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        image = key[0].as_py()
        # Slices are numbered by label, so pos alone does not tell them apart.
        named = list(zip(*(rows[c].to_pylist() for c in ("detector", "pos", "label")), strict=True))
        order = sorted(range(len(named)), key=lambda i: (uniform_py(seed, "shuffle", image, *named[i][:2]), *named[i]))
        merged, members = merge_same_places(_corners(rows)[order], [[i] for i in order], threshold)
        drawn = rows.take([m[int(uniform_py(seed, "label", image, n) * len(m))] for n, m in enumerate(members)])
        return _placed(drawn, merged, drawn["score"], range(len(drawn)))

    return _by_image(boxes, run)


@dataclass(frozen=True)
class ChainConfig:
    """Which steps of the alternate chain run, and their limits."""

    top_k: int | None = 80
    score: float | None = 0.15
    slice_detectors: tuple[str, ...] = ("ow",)
    slice_threshold: float = 0.3
    contain: bool = True
    nms: float | None = 0.4
    max_dets: int | None = 60
    merge_iou: float | None = 0.9


def merged_detections(boxes: DataFrame, config: ChainConfig = ChainConfig()) -> DataFrame:
    """Top-k, score, slice merge, containment, NMS, limit and label merge, each if configured; boxes are read once."""
    columns = [f.split()[0] for f in FIELDS.split(", ")]
    out = boxes.select(columns)
    if config.top_k is not None:
        out = suppress.top_k(out, config.top_k)
    if config.score is not None:
        out = detections.strict_score(out, config.score)
    if config.slice_detectors:
        # Dealt out anew by image, as Python's results are no longer known to be, once for all later steps.
        out = slice_merge(out, config.slice_threshold, detectors=config.slice_detectors).repartition("image_id")
    if config.contain:
        out = suppress.containment_removal(out)
    if config.nms is not None:
        out = suppress.nms(out, config.nms)
    if config.max_dets is not None:
        out = suppress.top_k(out, config.max_dets, order=[F.desc("score"), F.col("detector"), F.col("pos"), F.col("label")])
    return out if config.merge_iou is None else iou_label_merge(out, config.merge_iou)
