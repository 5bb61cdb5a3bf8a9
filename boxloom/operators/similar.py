"""Items of a list that are alike in words, by a set-similarity join.

Two items are alike if their sets of words share three, or .65 of either. An item
goes if a later one of its list is like it. The join is one of Chaudhuri et al.,
"A Primitive Operator for Similarity Joins in Data Cleaning" (2006), in the form
of Bayardo et al. (2007): the words of an item are put in one order, rare ones
of its list first, and of an item of s words that needs n in common only the
first s - n + 1 become rows. Two items that are alike meet in one of them; the
rest of the pairs are never formed. Sizes that cannot reach .65 are left out in
the join, and what meets is checked on the whole sets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.text import let, settle_attributes, short_items, words
from boxloom.sources.sinks import materialise

ENOUGH, SHARE = 3, 0.65


def needed(size: int) -> int:
    """Words that an item of this size shares with any that is like it, at least: for larger partners only more."""
    return min(ENOUGH, math.ceil(SHARE * size))


def _prefix(size: Column) -> Column:
    """How many of the first words an item is found by."""
    few = F.lit(None).cast("int")
    for s in range(1, math.ceil(ENOUGH / SHARE)):
        few = F.when(size == s, s - needed(s) + 1).otherwise(few)
    return F.coalesce(few, size - ENOUGH + 1)


def crowded(items: Column) -> Column:
    """Whether two items of a list share a word in a way that can make them alike: both of one word, or both of more. False for a null list."""
    again = lambda xs: let(xs, lambda x: F.size(F.array_distinct(x)) < F.size(x))
    has = lambda x: F.contains(x, F.lit(" ")) | F.contains(x, F.lit("-"))
    plain = F.filter(items, lambda x: ~has(x))  # one word as it stands; null items are in neither
    sets = lambda w, kind: F.flatten(F.filter(w, kind))
    told = let(F.transform(F.filter(items, has), words), lambda w: again(F.concat(plain, sets(w, lambda x: F.size(x) == 1))) | again(sets(w, lambda x: F.size(x) > 1)))
    return F.coalesce(told, F.lit(False))


def alike(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, at): places, from 0, in the lists `items` of items that a later item of the list is like; keys are distinct."""
    # An item of one word is only like others of that word, so lists whose single words differ need no rows for them.
    single = F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), words), lambda w: F.size(w) == 1)
    repeated = let(F.transform(single, lambda w: F.get(w, F.lit(0))), lambda x: F.size(F.array_distinct(x)) < F.size(x))
    marked = df.select(key, items, repeated.alias("r"))  # before the items are laid out, or it is made once an item
    each = marked.select(key, "r", F.posexplode(items).alias("at", "item")).where("item is not null").select(key, "r", "at", words(F.col("item")).alias("w"))
    # Dealt out by key: counts and gathering stay there, and both sides of the join are one exchange. With a number, as
    # adaptive execution would join partitions by the size of rows that become more.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = each.where((F.size("w") > 1) | F.col("r")).repartition(parts, key).select(key, "at", F.explode("w").alias("x"))
    often = word.withColumn("n", F.count("*").over(Window.partitionBy(key, "x")))
    ordered = often.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    found = ordered.select(key, "at", F.col("o.x").alias("w"), F.size("o").alias("s"), F.explode(let(F.col("o"), lambda o: F.slice(o, F.lit(1), _prefix(F.size(o))))).alias("f")).where("f.n > 1").select(key, "at", "w", "s", F.col("f.x").alias("x"))
    # The lists lie in small files that say little of the rows they become: the planner would broadcast a side.
    a, b = found.hint("merge").alias("a"), found.alias("b")
    sizes = (F.col("a.s") >= SHARE * F.col("b.s")) & (F.col("b.s") >= SHARE * F.col("a.s")) | (F.least("a.s", "b.s") >= ENOUGH)
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.at") < F.col("b.at")) & sizes)
    told = lambda n: (n >= ENOUGH) | (n >= SHARE * F.greatest("a.s", "b.s"))
    return met.where(let(F.size(F.array_intersect("a.w", "b.w")), told)).select(F.col(f"a.{key}").alias(key), F.col("a.at").alias("at")).distinct()


def drop_alike(df: DataFrame, key: str, items: str) -> DataFrame:
    """df whose lists `items` are without items that a later one is like, in their order; keys are distinct and not null."""
    gone = alike(df, key, items).groupBy(F.col(key).alias("_k")).agg(F.collect_set("at").alias("_gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size(items) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(items)).otherwise(F.transform(left, lambda i: F.get(F.col(items), i)))
    return df.hint("merge").join(gone, F.col(key) == F.col("_k"), "left").withColumn(items, kept).drop("_k", "_gone")


def merge_attributes(df: DataFrame, key: str, shuffled: Column, phase2: Column, out: str = "merged") -> DataFrame:
    """Adds `out`: mixed phase-1 items and phase 2 as one list (see settle_attributes); keys are distinct and not null.

    The short items are written first: three sides of the joins read them, and
    the plan would mix them anew in each filter that it derives. Only lists with
    items that may be alike are joined; the others are not dealt out again.
    """
    short = df.withColumn(out, short_items(shuffled))
    short = materialise(short.withColumn("_crowded", crowded(F.col(out))), "short_items")
    apart, near = short.where("not _crowded"), short.where("_crowded")
    return apart.unionByName(drop_alike(near, key, out)).drop("_crowded").withColumn(out, settle_attributes(F.col(out), phase2))
