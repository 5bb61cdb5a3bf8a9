"""Relations of the engine derived from the driver's tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id")).distinct()
    return ids.select("image_id", _width().cast("int").alias("width"), _height().cast("int").alias("height"))


def _width():
    return F.lit(1024) + F.col("image_id") * 97 % 1025


def _height():
    return F.lit(1024) + F.col("image_id") * 61 % 1025


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each lineitem row; the part names come by a join that the planner sizes."""
    li, ok, pk = table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = li.join(parts, pk == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("image_id"),
        F.element_at(F.array(*map(F.lit, ("gd", "yw", "ow", "od"))), (ok % 4 + 1).cast("int")).alias("detector"),
        F.when(pk % 50 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("label"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax"), 4).alias("score"),
        ((pk * 37 + ok * 11) % 1400 - 60).alias("x0"),
        ((ok * 53 + pk * 7) % 1400 - 60).alias("y0"),
        F.floor(20 + F.col("l_quantity") * F.col("l_quantity") / 2).cast("long").alias("w"),
        (20 + (ok * 13 + pk * 29) % 1100).alias("h"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"),
    )
    pos = F.row_number().over(Window.partitionBy("image_id", "detector").orderBy("o"))
    return rows.select("image_id", "detector", pos.alias("pos"), "label", "score", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), _width().alias("width"), _height().alias("height"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.substring_index("text", "\n", 1).alias("web_caption"), F.concat(F.lit("This is "), "text").alias("vlm_caption"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists made of the assistant's sentences."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    lines = F.transform(F.split("text", r"\. "), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return said.select("conv_id", "turn", F.concat(F.lit("Here is the list:\n"), F.array_join(lines, "\n")).alias("answer"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, phase1, phase2) with variants that reach every merge rule."""
    names = detections(spark, sf_dir).where("trim(label) <> ''").select("image_id", "label").distinct()
    got = names.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("l"))
    extra = [F.transform("l", lambda x: F.concat(F.lit("small "), x)), F.transform("l", lambda x: F.replace(x, F.lit(" "), F.lit("-"))), F.transform("l", lambda x: F.concat(F.lit("a very old big "), x))]
    human = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in (["men"], ["woman"], ["old people"], ["a man walking"], ["children", "young child"])]), (F.col("image_id") % 5 + 1).cast("int"))
    nouns = F.transform("l", lambda x, i: F.concat(F.substring_index(x, " ", -1), F.when(i % 3 == 0, "s").otherwise("")))
    return got.select("image_id", F.array_distinct(F.concat("l", *extra, human)).alias("phase1"), F.array_distinct(nouns).alias("phase2"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 20).alias("logits"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pic_id, values): each vector as a picture of 8 x 8 values, as it is, brighter with more contrast, and with two strengths of noise."""
    noise = lambda i: ((F.col("vec_id") * 31 + i * 17) % 101 - 50) / 2500
    kinds = [lambda x, i: x, lambda x, i: x * 1.5 + 0.25, lambda x, i: x + noise(i), lambda x, i: x + 3 * noise(i)]
    made = [F.transform(F.transform("embedding", lambda x: x.cast("double")), f) for f in kinds]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.array(*made)).alias("k", "values")).select((F.col("vec_id") * 4 + F.col("k")).alias("pic_id"), "values")


def rgb_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pixels, width, height): the 64 values of a vector, folded into bytes, as the channels of 21 pixels, 7 by 3 or 3 by 7."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 1000).cast("long"), F.lit(256))), 2, "0"))
    wide = F.col("vec_id") % 2 == 0
    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return rows.select("vec_id", F.unhex(F.array_join(F.slice(byte, 1, 63), "")).alias("pixels"), F.when(wide, 7).otherwise(3).alias("width"), F.when(wide, 3).otherwise(7).alias("height"))
