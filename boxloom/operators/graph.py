"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
round is a few joins and aggregations over the edges and is written to the
shared folder; only counts reach the driver. The minimum at a node is joined
back over salted keys, so that a hub's edges spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.sources.sinks import materialise

SALTS = 8


def _least_at(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v at u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "s"])


def _done(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: one v for each u, and no v has a v of its own."""
    rows, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return rows == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable.

    Rows with a null end and loops are ignored; no edges give no rows.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    now = materialise(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _done(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_at(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _least_at(large)
        now = materialise(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
