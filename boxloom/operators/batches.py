"""Batches of like cost under a budget of rows and of cost.

Rows are put in one order, dear ones first, and cut where another full window of
rows or of cost begins. A window of cost is the budget less the dearest row, so
that a batch, the row that reaches over its window's end included, stays within
the budget. No task sees the whole order: a row's place is the rows and cost of
the (cost, salt) groups before its own, whose totals are summed in a window over
groups, and its place in its group. Salts split a cost that many rows share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def cost_batches(rows: DataFrame, cost: Column, keys: Sequence[str], most_rows: int, most_cost: int, salt: Column | None = None) -> DataFrame:
    """rows with batch_id, a long that grows with the order: cost descending, salt, keys.

    cost is a whole number of 0 or more (null: 0). Keys make rows distinct; rows
    alike in all of them are one unit of the order whose members are not told
    apart. A row dearer than the budget is an error.
    """
    hash_ = F.pmod(F.xxhash64(*keys), F.lit(SALTS)) if salt is None else salt
    put = rows.withColumns({"_c": F.coalesce(cost.cast("long"), F.lit(0).cast("long")), "_s": hash_})
    groups = put.groupBy("_c", "_s").agg(F.count("*").alias("_n"))
    dearest = groups.agg(F.max("_c")).first()[0] or 0
    if dearest >= most_cost:
        raise ValueError(f"a row costs {dearest}, the budget is {most_cost}")
    # One row for each distinct cost and salt; sizes of crops are a few thousand.
    before = Window.orderBy(F.desc("_c"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    start = groups.withColumns({"_rows": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_cost": F.coalesce(F.sum(F.col("_n") * F.col("_c")).over(before), F.lit(0))}).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_c", "_s").orderBy(*keys)) - 1
    batch = F.floor((F.col("_rows") + F.col("_nth")) / most_rows) + F.floor((F.col("_cost") + F.col("_nth") * F.col("_c")) / (most_cost - dearest))
    return put.withColumn("_nth", nth).join(start, ["_c", "_s"]).withColumn("batch_id", batch.cast("long")).select(*rows.columns, "batch_id")
