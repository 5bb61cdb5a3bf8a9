"""Column-wise records of one image as frames: select, mask, reorder, concatenate, print."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_field(df: DataFrame, name: str, value: Column, replace: bool = True) -> DataFrame:
    """Set a column; without replace an existing name is an error."""
    if not replace and name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, value)


def take(df: DataFrame, positions: Sequence[int], pos: str = "pos") -> DataFrame:
    """Rows of each image at the positions, renumbered in the order given; the positions are literals in one expression."""
    order = F.array(*[F.lit(int(p)) for p in positions]) if positions else F.array().cast("array<int>")
    at = F.posexplode(F.transform(order, lambda p: p))
    wanted = df.sparkSession.range(1).select(at.alias("_new", pos))
    return df.join(F.broadcast(wanted), pos).drop(pos).withColumnRenamed("_new", pos).select(*df.columns)


def pick(values: Column, positions: Column) -> Column:
    """Items of an array at an array of positions from 0, a list for each row; negative ones count from the end, others outside give null."""
    return F.transform(positions, lambda p: F.get(values, F.when(p < 0, F.size(values) + p).otherwise(p).cast("int")))


def pick_slice(values: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """values[start:stop:step] as Python slices."""
    if not step:
        raise ValueError("step 0")
    n = F.size(values)

    def bound(b: int | None, default: Column) -> Column:
        low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
        return default if b is None else F.greatest(low, F.least(high, F.lit(b) if b >= 0 else n + b))

    first = bound(start, F.lit(0) if step > 0 else n - 1)
    last = bound(stop, n if step > 0 else F.lit(-1))
    count = F.greatest(F.ceil((last - first) / step), F.lit(0)).cast("int")
    at = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: first + k * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.get(values, p.cast("int")))


def mask(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def cat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; their columns must have the same names."""
    if len({frozenset(f.columns) for f in frames}) != 1:
        raise ValueError("frames differ in columns")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def from_arrays(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row for each position of equally long arrays, with pos; unequal lengths are an error."""
    same = [F.size(a) == F.size(arrays[0]) for a in arrays[1:]]
    bad = F.lit(False)
    for s in same:
        bad = bad | ~s
    checked = F.when(bad, F.raise_error(F.lit("arrays differ in length"))).otherwise(F.arrays_zip(*arrays))
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(checked).alias("pos", "_v")).select(*rest, "pos", *[F.col(f"_v.{a}").alias(a) for a in arrays])


def lengths(df: DataFrame, key: str = "image_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))
