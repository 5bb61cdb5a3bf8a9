"""Nearest neighbours by multi-index hashing of learned binary codes.

`TURNS` rotations (principal axes, then iterative quantisation from different
starts) and a centre are learned on a bounded sample; a vector's code is the
signs of its coordinates under each rotation. Rows are dealt evenly into
shards. A shard's codes are split into substrings of 16 bits, each with an
index of its values. If two codes differ in at most r = m q + a bits (0 <= a <
m), then one of the first a + 1 of the m substrings differs in at most q bits
or one of the others in at most q - 1: the index entries within that reach of
the probe's substrings hold every code within r. Those codes' vectors are
reranked in doubles. Where these entries hold more rows than the shard has,
no substring tells anything and all codes of the shard are compared; the codes
within r are the same. A probe with fewer than k codes within r in a shard
widens r there until it has k, so k are found if there are k.

r is learned too: it holds `target` of the true neighbours, in the whole table,
of a bounded number of rows.

The probes are a stated set, run against every shard in blocks.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows with a null id;
a repeated id stands for each of its rows, none of which is its own neighbour;
ties go to the smaller id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Vectors the rotations are learned on, at most, and those whose true neighbours the radius is learned on.
SAMPLE = 4096
TRIALS = 256
#: Rotations; a code has one bit for each dimension and rotation.
TURNS = 4
#: Every probe goes to every shard, so larger shards mean less shuffled; a shard's rows and index are held by one task.
SHARD_ROWS = 32768
MIN_SHARDS = 12
#: Probes answered at once; with the shard's rows it bounds the candidates that are held.
PROBE_BLOCK = 64


def learn(x: np.ndarray, rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centre, rotations side by side) from sample rows x."""
    rng = np.random.default_rng(seed)
    centre = x.mean(axis=0)
    y = x - centre
    axes = np.linalg.eigh(y.T @ y)[1][:, ::-1]
    v = y @ axes
    turns = []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        turns.append(axes @ turn)
    return centre, np.concatenate(turns, axis=1)


def encode(x: np.ndarray, centre: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, padded with zeros."""
    bits = np.packbits((x - centre) @ rotations >= 0, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of differing bits of codes a and b."""
    far = np.zeros((len(a), len(b)), np.uint16)
    for ours, theirs in zip(a.T, b.T, strict=True):
        far += np.bitwise_count(ours[:, None] ^ theirs[None, :])
    return far


@cache
def masks(reach: int) -> np.ndarray:
    """All 16-bit values with at most `reach` bits; none for a negative reach."""
    return np.array([sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(16), n)], np.uint16)


class MultiIndex:
    """One index for each 16-bit substring of a shard's codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.order, self.ends = [], []
        self.parts = -(-x.shape[1] * TURNS // 16)
        for part in codes.view(np.uint16).T[: self.parts]:
            order = np.argsort(part, kind="stable")
            self.order.append(order)
            self.ends.append(np.searchsorted(part[order], np.arange(65537)))

    def candidates(self, q_codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct (probe, row) positions in the index entries that can hold codes within the radius; None if these are no fewer than all pairs."""
        parts = q_codes.view(np.uint16).T[: self.parts]
        reach, more = divmod(radius, len(parts))
        # Before any entry is opened, evenly filled ones give the size.
        share = sum(len(masks(min(reach - (j > more), 16))) for j in range(len(parts))) / 65536
        if share >= 1:
            return None
        spans, total = [], 0
        for j, part in enumerate(parts):
            near = part[:, None] ^ masks(reach - (j > more))[None, :]
            lo, hi = self.ends[j][near], self.ends[j][near.astype(np.int64) + 1]
            total += int((hi - lo).sum())
            if total >= len(q_codes) * len(self.ids):
                return None
            spans.append((lo, hi))
        found = []
        for order, (lo, hi) in zip(self.order, spans, strict=True):
            probe = np.repeat(np.arange(len(q_codes)), lo.shape[1])
            lo, n = lo.ravel(), (hi - lo).ravel()
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.repeat(probe, n) * len(self.ids) + order[at])
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))

    def search(self, q_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe position, row position, score) of each probe's k best rows within the radius, which is widened where these are too few."""
        wide = np.arange(len(q))
        got = self.candidates(q_codes, radius)
        a = b = np.zeros(0, np.int64)
        if got is not None:
            a, b = got
            far = np.zeros(len(a), np.uint16)
            for ours, theirs in zip(q_codes.T, self.codes.T, strict=True):
                far += np.bitwise_count(ours[a] ^ theirs[b])
            keep = (far <= radius) & (q_ids[a] != self.ids[b])
            a, b = a[keep], b[keep]
            wide = np.flatnonzero(np.bincount(a, minlength=len(q)) < k)
            stay = ~np.isin(a, wide)
            a, b = a[stay], b[stay]
        if len(wide):
            far = differing(q_codes[wide], self.codes)
            far[q_ids[wide][:, None] == self.ids[None, :]] = np.iinfo(np.uint16).max
            some = min(k, len(self.ids)) - 1
            limit = np.maximum(np.partition(far, some, axis=1)[:, some], radius)
            more_a, more_b = np.nonzero((far <= limit[:, None]) & (far < np.iinfo(np.uint16).max))
            a, b = np.concatenate([a, wide[more_a]]), np.concatenate([b, more_b])
        score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], self.x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        order = np.lexsort((self.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        first = np.searchsorted(a, np.arange(len(q)))
        best = np.arange(len(a)) - first[a] < k
        return a[best], b[best], score[best]


def learned_radius(rows: DataFrame, trials: list, model: tuple, dims: int, k: int, target: float) -> int:
    """The distance that holds `target` of the k true neighbours of the trial rows (id, v) in the whole table."""
    ids, x = np.array([r["id"] for r in trials]), np.array([r["v"] for r in trials])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encode(x, *model)
        best = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dims)
            scores = x @ v.T
            scores[ids[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            both = np.concatenate([best[0], scores], axis=1), np.concatenate([best[1], differing(codes, encode(v, *model))], axis=1)
            top = np.argpartition(-both[0], k - 1, axis=1)[:, :k]
            best = tuple(np.take_along_axis(m, top, axis=1) for m in both)
        some = np.isfinite(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[0]), pa.array(best[0][some]), pa.array(best[1][some])], names=["trial", "score", "far"])

    near = rows.select("id", "v").mapInArrow(run, "trial bigint, score double, far bigint")
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "far"))
    far = [r["far"] for r in near.withColumn("r", rank).where(F.col("r") <= k).collect()]
    return int(np.quantile(far, target)) if far else 0


def usable(v: Column, dims: int) -> Column:
    """Whether a vector takes part."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, bad) & F.exists(v, lambda e: e != 0)


def search(vectors: DataFrame, probes: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that meets `probes` (a condition over id and v)."""
    spark = vectors.sparkSession
    out = "query_id bigint, vec_id bigint, score double"
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    common = named.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common["d"] if common else 0
    rows = materialise(named.where(usable(F.col("v"), dims)), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # A bounded sample: the rotations, and the trial rows of the radius.
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    model = learn(np.array([r["v"] for r in sample]))
    radius = learned_radius(rows, sample[:TRIALS], model, dims, k, target)
    shards = max(MIN_SHARDS, -(-n // SHARD_ROWS))
    stored = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", "v")
    asked = rows.where(probes).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "id", "v")
    dealt = stored.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"shard": None, "ids": [], "x": []}
        index: MultiIndex | None = None

        def answer(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), PROBE_BLOCK):
                q, qx = ids[at : at + PROBE_BLOCK], x[at : at + PROBE_BLOCK]
                a, b, s = index.search(q, qx, encode(qx, *model), radius, k)
                yield pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(index.ids[b]), pa.array(s)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            shard, role, ids = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, dims)
            for s in np.unique(shard):
                if s != held["shard"]:
                    held, index = {"shard": s, "ids": [], "x": []}, None
                own = (shard == s) & (role == 0)
                if own.any():
                    held["ids"].append(ids[own])
                    held["x"].append(x[own])
                asks = (shard == s) & (role == 1)
                if asks.any() and held["ids"]:
                    if index is None:
                        all_x = np.concatenate(held["x"])
                        index = MultiIndex(np.concatenate(held["ids"]), all_x, encode(all_x, *model))
                    yield from answer(ids[asks], x[asks])

    found = dealt.mapInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
