"""Perceptual hashes of small pictures, and near-duplicates by Hamming distance.

A hash is 64 signs of a two-dimensional cosine transform of 8 x 8 grey values.
Two hashes that differ in at most r bits agree in at least t of r + t disjoint
blocks of bits, so an equality join on every choice of t blocks finds all of
them. More blocks together make longer keys and smaller buckets, but more keys a
hash; which t makes the fewest comparisons is counted on the data.

Pictures with one hash are one row before the join, so copies cost nothing.
Pictures without a hash (a null, or not 64 values without null) are alike to none.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.text import let
from boxloom.sources.sinks import materialise

from .graph import connected_components

SIDE, BITS = 8, 64
#: Decimals that the transform is rounded to, so that equal coefficients compare as equal.
DECIMALS = 6
#: Hashes that how many blocks go together is counted on, about; and what a key costs, in comparisons.
COUNTED, KEY_COST = 50_000, 16


def cosines() -> list[list[float]]:
    """Row k: the k-th cosine at the eight places."""
    return [[math.cos(math.pi * (2 * i + 1) * k / (2 * SIDE)) for i in range(SIDE)] for k in range(SIDE)]


def transform(values: Column) -> Column:
    """64 coefficients of 64 values, row by row: rows first, then columns."""
    table = F.array(*[F.lit(x) for row in cosines() for x in row])

    def dot(x: Column, first: Column, step: int, k: Column, of: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(SIDE - 1)), F.lit(0.0), lambda s, i: s + F.get(x, (first + i * step).cast("int")) * F.get(of, (k * SIDE + i).cast("int")))

    every = F.sequence(F.lit(0), F.lit(BITS - 1))
    rows = lambda x, of: F.transform(every, lambda n: dot(x, F.floor(n / SIDE) * SIDE, 1, n % SIDE, of))
    columns = lambda x, of: F.transform(every, lambda n: dot(x, n % SIDE, SIDE, F.floor(n / SIDE), of))
    return let(table, lambda of: let(rows(values, of), lambda x: F.transform(columns(x, of), lambda c: F.round(c, DECIMALS))))


def dct_hash(values: Column) -> Column:
    """The hash as a long: from the highest bit down, whether a coefficient is above the median of all but the first."""
    def signs(c: Column) -> Column:
        middle = F.get(F.array_sort(F.slice(c, 2, BITS - 1)), F.lit((BITS - 1) // 2))
        return let(middle, lambda m: F.aggregate(c, F.lit(0).cast("long"), lambda h, x: F.call_function("shiftleft", h, F.lit(1)).bitwiseOR((x > m).cast("long"))))

    whole = (F.size(values) == BITS) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, let(transform(values), signs))


def as_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def _masks(radius: int, together: int) -> list[int]:
    """Masks, as signed longs, of every choice of `together` of the radius + together blocks."""
    n = radius + together
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in map(sum, combinations(blocks, together))]


def _keyed(hashes: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each hash and mask, with the bits that the mask takes."""
    return hashes.select("h", F.posexplode(F.array(*map(F.lit, masks))).alias("k", "mask")).select("h", "k", F.col("h").bitwiseAND(F.col("mask")).alias("bits"))


def choose_blocks(hashes: DataFrame, radius: int, most: int = 5) -> int:
    """How many blocks together make the fewest comparisons and keys over these hashes (h).

    Of many hashes an even part is counted and carried on, as only the way to the result depends on it.
    """
    if not radius:
        return 1
    n = hashes.count()
    part = max(1, n // COUNTED)
    some = hashes.where(F.pmod(F.xxhash64("h"), F.lit(part)) == 0)
    keys = [_keyed(some, _masks(radius, t)).groupBy("k", "bits").agg(F.count("*").cast("double").alias("n")) for t in range(1, most + 1)]
    found = [k.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("met"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("made")) for k in keys]
    costs = []
    for counts in found:
        met, made = counts.first()
        costs.append(met * part * part + KEY_COST * made * part)
        if KEY_COST * made * part > min(costs):
            break  # more blocks only make more keys
    return costs.index(min(costs)) + 1


def near_hashes(hashes: DataFrame, radius: int, together: int | None = None) -> DataFrame:
    """(a, b, distance) for all a < b among distinct hashes (h) that differ in 1 to `radius` bits."""
    if not 0 <= radius < BITS // 2:
        raise ValueError(f"radius {radius}")
    masks = _masks(radius, together or choose_blocks(hashes, radius))
    keyed, known = _keyed(hashes, masks), F.array(*map(F.lit, masks))
    a, b = (keyed.select("k", "bits", F.col("h").alias(x)) for x in "ab")
    x = F.col("a").bitwiseXOR(F.col("b"))
    # The planner knows the size of the hashes, not of their many keys, and would broadcast these.
    near = a.hint("merge").join(b, ["k", "bits"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius))
    # Blocks that agree are met again under every choice of them; the first counts.
    first = ~F.exists(F.slice(known, F.lit(1), F.col("k")), lambda m: x.bitwiseAND(m) == 0)
    return near.where((F.col("k") == 0) | first).select("a", "b", F.bit_count(x).alias("distance"))


def near_classes(pictures: DataFrame, radius: int, key: str, phash: str = "phash", near: DataFrame | None = None) -> DataFrame:
    """pictures with class_id, the smallest key that steps of at most `radius` bits lead to; near: (a, b, distance) of their hashes for this radius or more, if known."""
    groups = materialise(pictures.where(F.col(phash).isNotNull()).groupBy(F.col(phash).alias("h")).agg(F.min(key).alias("least")), "hashes")
    if radius:
        near = near_hashes(groups.select("h"), radius) if near is None else near.where(F.col("distance") <= radius)
        roots = connected_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
        linked = groups.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
        least = linked.groupBy("root").agg(F.min("least").alias("class_id"))
        groups = linked.join(least, "root").select("h", "class_id")
    else:
        groups = groups.withColumnRenamed("least", "class_id")
    named = groups.select(F.col("h").alias("_h"), F.col("class_id").alias("_class"))
    return pictures.join(named, F.col(phash) == F.col("_h"), "left").withColumn("class_id", F.coalesce("_class", key)).drop("_h", "_class")


def drop_near(pictures: DataFrame, radius: int, key: str, phash: str = "phash") -> DataFrame:
    """One picture of each class, that with the smallest key; of rows with one key one stays."""
    return near_classes(pictures, radius, key, phash).where(F.col("class_id") == F.col(key)).dropDuplicates([key]).drop("class_id")
