"""Stages 4 and 5: overlap-aware sampling in replicas.

Each pick changes the weights of the next, and each replica those of the next
one, so an image is handled as a whole, in numpy, through applyInArrow. An
image has hundreds of boxes; that bounds a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxloom.functions.rng import draws_py, uniform_py


@dataclass(frozen=True)
class SampleConfig:
    """Constants of stages 4 and 5; the defaults are the pipeline's."""

    seed: int = 0
    replicas: int = 5
    least_share: float = 0.3
    s4_base: float = 0.1
    s4_iou: float = 1.2
    s4_den: float = 1.0
    s4_new: float = 2.0
    s4_novelty: float = 0.5
    s4_min: int = 20
    s4_low: float = 0.3
    s4_high: float = 0.5
    s5_base: float = 0.01
    s5_num: float = 99.0
    s5_area: float = 0.4
    s5_den: float = 0.8
    s5_new: float = 1.5
    s5_punish: float = 999.0
    s5_novelty: float = 1.0
    s5_low: int = 6
    s5_high: int = 15
    s5_low_share: float = 0.25
    s5_overlap: float = 0.25
    s5_most: int = 30
    mode: str = "stage_5_no_overlap"
    misaligned_novelty: bool = False


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of areas that boxes a share with boxes b."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    return np.clip(w, 0, None) * np.clip(h, 0, None)


def areas(a: np.ndarray) -> np.ndarray:
    return (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1])


def _divide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros_like(x), where=y > 0)


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = shared_areas(a, b)
    return _divide(both, areas(a)[:, None] + areas(b)[None, :] - both)


def pick(weights: np.ndarray, u: float) -> int:
    """Inversion of the cumulated weights, of which those of 0 are never picked; the upper end falls to the last item above 0."""
    total = weights.cumsum()
    at = int(total.searchsorted(u * total[-1], side="right"))
    return at if at < len(weights) else int(np.flatnonzero(weights)[-1])


def novelty_of(overlaps: np.ndarray, same: np.ndarray) -> np.ndarray:
    """2 / (overlap with what earlier replicas hold, doubled for the same label, + .5): a row for each box, a column for each one held."""
    if not overlaps.shape[1]:
        return np.zeros(len(overlaps))
    return 2 / ((overlaps * (1 + same)).sum(axis=1) + 0.5)


def draw_votes(votes: np.ndarray, codes: np.ndarray, extra: np.ndarray, k: int, draws, c: SampleConfig) -> list[int]:
    """k picks of stage 4: other detectors' agreement on a label (votes) raises a box's weight; codes number the labels.

    A pick changes the weights of its label alone; what is picked weighs 0.
    """
    numbers, of_label = codes.tolist(), {}
    for i, x in enumerate(numbers):
        of_label.setdefault(x, []).append(i)
    new, chosen = np.full(len(codes), c.s4_new), []
    support, left = votes.sum(axis=1), np.ones(len(codes), bool)

    def weigh(at: np.ndarray) -> np.ndarray:
        s = np.maximum(support[at], 0)
        return (c.s4_base + c.s4_iou * s / (s + c.s4_den) + c.s4_new * (new[at] + extra[at])) * left[at]

    weights, own = weigh(np.arange(len(codes))), extra
    while len(chosen) < k and len(chosen) < len(codes):
        if c.misaligned_novelty and chosen:
            extra = np.zeros(len(codes))
            extra[left] = own[: len(codes) - len(chosen)]
            weights = weigh(np.arange(len(codes)))
        p = pick(weights, draws(len(chosen)))
        chosen.append(p)
        left[p], weights[p] = False, 0.0
        if len(mine := of_label[numbers[p]]) > 1:
            new[mine] = 0.0
            support[mine] -= votes[mine, p]  # a pick's votes leave the sums instead of every sum being made anew
            weights[mine] = weigh(mine)
    return chosen


def draw_uncovered(cover: np.ndarray, size: np.ndarray, codes: np.ndarray, extra: np.ndarray, k: int, draws, c: SampleConfig) -> list[int]:
    """Up to k picks of stage 5: boxes that others cover little; what a pick covers too much goes, or its column is punished. cover is changed."""
    left, chosen, rest = np.arange(len(codes)), [], np.arange(len(codes))
    new = np.full(len(codes), c.s5_new)
    while len(chosen) < k and len(left):
        s = cover[left[:, None], rest].sum(axis=1)
        e = new[left] + c.s5_area / c.s5_new * size[left] + (extra[: len(left)] if c.misaligned_novelty else extra[left])
        p = int(left[pick(c.s5_base + c.s5_num / (c.s5_den + s) + c.s5_new * e, draws(len(chosen)))])
        chosen.append(p)
        new[codes == codes[p]] = 0.0
        if c.mode == "stage_5":
            cover[:, p] *= c.s5_punish
            left = left[left != p]
        else:
            left = rest = left[(left != p) & (cover[left, p] <= c.s5_overlap)]
    return chosen


def sample_image(image, boxes: np.ndarray, labels: np.ndarray, detectors: np.ndarray, c: SampleConfig) -> list[list[int]]:
    """Positions picked in each replica, in order; boxes are normalised. An image without boxes has empty replicas.

    What pairs of boxes share is made once; replicas take their part of it.
    """
    pool, out, done = np.arange(len(boxes)), [], []
    total, size = len(pool), areas(boxes)
    codes = np.unique(labels, return_inverse=True)[1].reshape(-1)
    of = np.unique(detectors, return_inverse=True)[1].reshape(-1)
    same, both = codes[:, None] == codes[None, :], shared_areas(boxes, boxes)
    overlaps = _divide(both, size[:, None] + size[None, :] - both)
    votes = overlaps * (same & (of[:, None] != of[None, :]))
    cover = _divide(both, np.repeat(size[:, None], total, axis=1)) * (1 + same)
    np.fill_diagonal(cover, 0)
    for r in range(c.replicas):
        n = len(pool)
        if n < c.least_share * total or n < min(0.5 * total, 6):
            break
        u = lambda what, r=r: uniform_py(c.seed, image, r, what, 0)
        held, own = np.array(done, int), pool
        fresh = lambda at, held=held: novelty_of(overlaps[at[:, None], held], same[at[:, None], held])
        k = min(n, max(c.s4_min, int((c.s4_low + (c.s4_high - c.s4_low) * u("share")) * n)))
        if n > k:
            own = own[draw_votes(votes[own[:, None], own], codes[own], fresh(own) * r * c.s4_novelty, k, draws_py(c.seed, image, r, "s4"), c)]
        m = len(own)
        low = min(int(c.s5_low_share * m), c.s5_low)
        k = min(low + int(u("k") * (c.s5_high - low + 1)), m, c.s5_most)
        k = max(k, 2) if m >= 2 else k
        picks = own[draw_uncovered(cover[own[:, None], own], size[own], codes[own], fresh(own) * r * c.s5_novelty, k, draws_py(c.seed, image, r, "s5"), c)].tolist() if m else []
        out.append(picks)
        done += picks
        pool = np.setdiff1d(pool, picks, assume_unique=True)
    return out


OUT = "image_id long, sub_sample int, pick_rank int, detector string, pos int, label string, score double, x0 double, y0 double, x1 double, y1 double"
CORNERS = ["x0", "y0", "x1", "y1"]


def replica_sampling(boxes: DataFrame, config: SampleConfig = SampleConfig()) -> DataFrame:
    """Rows of all replicas; boxes in [0, 1], in the order picked. Images whose boxes all went are left to `with_empty`."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("detector", "ascending"), ("pos", "ascending")])
        column = lambda c: table[c].to_numpy().astype(float)
        corner = np.stack([column(c) / column(of) for c, of in zip(CORNERS, ("width", "height", "width", "height"), strict=True)], axis=1)
        picked = sample_image(key[0].as_py(), corner, np.array(table["label"].to_pylist(), str), np.array(table["detector"].to_pylist(), str), config)
        at = np.array([i for picks in picked for i in picks], int)
        out = table.select(["image_id", "detector", "pos", "label", "score"]).take(at)
        made = {"sub_sample": np.repeat(np.arange(len(picked)), [len(picks) for picks in picked]), "pick_rank": np.array([k for picks in picked for k in range(len(picks))], int)}
        values = {c: out[c] for c in out.column_names} | made | dict(zip(CORNERS, corner[at].T, strict=True))
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        cast = lambda x, kind: x.cast(kind) if isinstance(x, pa.ChunkedArray) else pa.array(x).cast(kind)
        return pa.table({name: cast(values[name], kinds[kind]) for name, kind in map(str.split, OUT.split(", "))})

    return boxes.select("image_id", "detector", "pos", "label", "score", *CORNERS, "width", "height").groupBy("image_id").applyInArrow(run, OUT)


def overlap_aware(boxes: DataFrame, config: SampleConfig = SampleConfig()) -> DataFrame:
    """The first replica alone."""
    from dataclasses import replace

    return replica_sampling(boxes, replace(config, replicas=1))
