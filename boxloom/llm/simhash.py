"""SimHash near-duplicates found with BK-trees.

Fingerprints: 64 bits, the majority of the XXH64 values of word shingles.
Equal fingerprints are first drawn together. Two fingerprints within `radius`
bits agree on at least `bands - radius` of `bands` bit bands, so each is dealt
into one shard for each choice of that many bands, and every link is inside
some shard. A shard's fingerprints form BK-trees (children keyed by the whole
Hamming distance to the parent) of at most `tree_size` nodes; a larger shard
is dealt into blocks of one tree and one set of probes, shipped to the task of
that block. A probe follows only the edges within the radius of its distance.
A block returns a spanning forest of what it linked, not all pairs, and
connected components over these links give the classes.

Defined cases: null and empty texts have no words and fingerprint zero, linked
like any other; rows with a null id get their text's class; repeated rows stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators.graph import connected_components

from .store import materialise, small_batches

#: Largest BK-tree.
TREE_SIZE = 2048
#: Fingerprints expected in a shard by chance, at most; fewer bands give fewer and larger shards, and the trees more to do.
SHARD_CHANCE = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one text."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


class BKTree:
    """A BK-tree over unsigned 64-bit codes, probed with many codes at once."""

    def __init__(self, codes: list[int]):
        self.codes = np.array(codes, dtype=np.uint64)
        children: list[dict[int, int]] = []
        for i, code in enumerate(codes):
            children.append({})
            node = 0
            while i:
                d = (codes[node] ^ code).bit_count()
                below = children[node].get(d)
                if below is None:
                    children[node][d] = i
                    break
                node = below
        counts = np.array([len(c) for c in children], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.child = np.array([i for c in children for i in c.values()], np.int64)
        self.edge = np.array([d for c in children for d in c], np.int64)

    def within(self, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (probe, node) of all pairs within the radius."""
        q, node = np.arange(len(probes)), np.zeros(len(probes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(probes[q] ^ self.codes[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            counts = self.first[node + 1] - self.first[node]
            at = np.repeat(self.first[node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            q, d = np.repeat(q, counts), np.repeat(d, counts)
            keep = np.abs(self.edge[at] - d) <= radius
            q, node = q[keep], self.child[at[keep]]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _spanning(tree: list[int], probes: list[int], radius: int, same: bool) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest; positions run over tree, then probes."""
    if not tree or not probes:
        return []
    label, shift = np.arange(len(tree) + (0 if same else len(probes))), 0 if same else len(tree)
    bk, codes = BKTree(tree), np.array(probes, dtype=np.uint64)
    for at in range(0, len(codes), 512):
        a, b = bk.within(codes[at : at + 512], radius)
        a = a + at + shift
        while len(a):
            ra, rb = label[a], label[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            low = np.minimum(ra, rb)
            np.minimum.at(label, ra, low)
            np.minimum.at(label, rb, low)
            while (label[label] != label).any():
                label = label[label]
    return [(i, j) for i, j in enumerate(label.tolist()) if i != j]


def _blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Link the rows of each block; rows are sorted by block."""

    def links(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        tree = [(c, r) for role, c, r in rows if role != 2]
        probes = [(c, r) for role, c, r in rows if role != 1]
        same = all(role == 0 for role, _, _ in rows)
        reps = [r for _, r in (tree if same else tree + probes)]
        return [(reps[i], reps[j]) for i, j in _spanning([c for c, _ in tree], [c for c, _ in probes], radius, same)]

    rest: list[tuple[int, int, int]] = []
    at = None
    for b in batches:
        out: list[tuple[int, int]] = []
        gids, roles, reps = (b.column(i).to_pylist() for i in (0, 1, 3))
        codes = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
        for gid, role, code, rep in zip(gids, roles, codes, reps, strict=True):
            if gid != at:
                if len(rest) > 1:
                    out += links(rest)
                rest, at = [], gid
            rest.append((role, code, rep))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])
    out = links(rest) if len(rest) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])


def masks(bands: int, radius: int) -> list[int]:
    """Signed masks of every choice of bands - radius bands of 64 bits."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(reps: DataFrame, radius: int = 4, tree_size: int = TREE_SIZE) -> DataFrame:
    """Distinct links (u, v) between the ids of reps (fp, rep) that keep every connection within the radius."""
    n = reps.count()
    bands = next((b for b in range(radius + 1, 2 * radius + 1) if n / 2 ** (64 * (b - radius) / b) <= SHARD_CHANCE), 2 * radius) if radius else 1
    chosen = masks(bands, radius)
    keys = reps.where("rep is not null").select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in chosen])).alias("t", "key"))
    # Written, so that both sides of the join are dealt anew and a hot shard's rows can be split.
    sizes = materialise(keys.groupBy("t", "key").count().where("count > 1"), "shards")
    shards = keys.join(sizes, ["t", "key"]).withColumn("g", F.ceil(F.col("count") / F.lit(tree_size)))
    shards = shards.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")))
    # One row for each block it takes part in: its own (0), as a tree (1) against later parts, as probes (2) against earlier trees.
    dealt = shards.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        F.xxhash64("t", "key", F.least("o", "own"), F.greatest("o", "own")).alias("gid"),
        F.when(F.col("o") == F.col("own"), 0).when(F.col("o") > F.col("own"), 1).otherwise(2).alias("role"),
        "fp",
        "rep",
    )
    found = dealt.repartition("gid").sortWithinPartitions("gid").mapInArrow(lambda it: _blocks(it, radius), "u bigint, v bigint")
    return materialise(found.distinct(), "links")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable."""
    fps = materialise(fingerprints(docs, id_col, text_col, words), "fps")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = connected_components(links(reps, radius, tree_size))
    classes = materialise(reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "classes")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """docs with one row of each class: the smallest doc_id; rows of equal id and text count once.

    Rows with a null id are kept only if their class has no other row. Different
    texts under one id all stay if any of them stands for its class.
    """
    classes = near_duplicates(docs, radius, words).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(classes, docs["doc_id"].eqNullSafe(classes["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
