"""Inputs audited in one pass: which keys lack a side, and rules counted as rows go by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def audit(sides: dict[str, DataFrame], key: str, many: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """(key, n_<side>..., reasons): how often each key is on each side, and what is wrong with it.

    Reasons, in the order of the sides, joined by "; ": "null key", "no <side>",
    "<side> repeats" (but not for sides in `many`); empty if the key is complete.
    Each side is read once, with its key alone, and counted before the one
    exchange, so a key that fills a side is one row of each task.
    """
    tagged = [df.select(F.col(key), F.lit(i).alias("_side")) for i, df in enumerate(sides.values())]
    every = reduce(DataFrame.unionByName, tagged)
    counts = every.groupBy(key).agg(*[F.count_if(F.col("_side") == i).alias(f"n_{s}") for i, s in enumerate(sides)])
    reasons = [F.when(F.col(key).isNull(), "null key")]
    for s in sides:
        reasons.append(F.when(F.col(f"n_{s}") == 0, f"no {s}"))
        if s not in many:
            reasons.append(F.when(F.col(f"n_{s}") > 1, f"{s} repeats"))
    return counts.withColumn("reasons", F.concat_ws("; ", *reasons))


def observed(df: DataFrame, name: str, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df as it is, and an observation that holds, after its first action, `rows` and for each rule how many rows break it (null breaks it)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()]), seen


def require(seen: Observation) -> dict[str, int]:
    """What was observed; an error if any rule was broken."""
    found = dict(seen.get)
    if bad := {n: k for n, k in found.items() if n != "rows" and k}:
        raise ValueError(f"rules broken: {bad}")
    return found
