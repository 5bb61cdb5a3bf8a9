"""Records from rows, verdicts on records, and the published annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions import tiling
from boxloom.functions import verdict as v

from . import suppress


def vocabulary(boxes: DataFrame) -> DataFrame:
    """(image_id, labels): the sorted distinct labels."""
    return boxes.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def reindex(boxes: DataFrame) -> DataFrame:
    """Adds label_id, the label's 0-based place in its image's vocabulary, without a join."""
    return boxes.withColumn("label_id", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")) - 1).cast("long"))


def with_empty(samples: DataFrame, images: DataFrame, survivors: DataFrame, replicas: int = 5) -> DataFrame:
    """(image_id, sub_sample) records to write: those sampled, and all replicas of images without any survivor."""
    empty = images.join(survivors.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("sub_sample"))
    return samples.select("image_id", "sub_sample").distinct().union(empty)


#: Detectors in the order of their records' sources.
DETECTORS = ("gd", "yw", "ow", "od")


def records(samples: DataFrame, images: DataFrame, survivors: DataFrame | None = None) -> DataFrame:
    """One nested record for each (image, replica), arrays in the order picked; with survivors also the empty replicas of images without any."""
    row = F.struct("pick_rank", "label", "score", "detector", F.array("x0", "y0", "x1", "y1").alias("box"))
    nested = samples.groupBy("image_id", "sub_sample").agg(F.array_sort(F.collect_list(row)).alias("r"))
    if survivors is not None:
        none = with_empty(nested.where("false"), images, survivors)
        nested = nested.unionByName(none.select("image_id", "sub_sample", F.lit(None).cast(nested.schema["r"].dataType).alias("r")))
    of = lambda c, kind: F.coalesce(F.col(f"r.{c}"), F.array().cast(f"array<{kind}>"))
    return nested.join(images, "image_id").select(
        F.col("image_id").cast("string").alias("new_key"),
        "sub_sample",
        F.array("width", "height").alias("image_size"),
        F.lit("merged").alias("model_type"),
        F.lit("all_boxes").alias("annotation_type"),
        of("label", "string").alias("OV_merged"),
        of("box", "array<double>").alias("bboxes"),
        of("score", "double").alias("scores"),
        of("detector", "string").alias("ovd_belonging"),
        F.array(*map(F.lit, DETECTORS)).alias("ovd_source"),
    )


def prefixed(fields: Column, prefix: str) -> Column:
    """A map with prefix and `_` before its keys."""
    return F.transform_keys(fields, lambda k, _: F.concat(F.lit(prefix + "_"), k))


def merged_maps(maps: Column) -> Column:
    """An array of maps as one; a key of several is an error, whatever the session says of such keys."""
    names = F.flatten(F.transform(maps, F.map_keys))
    twice = F.filter(names, lambda n: F.size(F.filter(names, lambda x: x == n)) > 1)
    return F.when(F.size(twice) > 0, F.raise_error(F.concat(F.lit("keys of several maps: "), F.array_join(F.array_distinct(twice), ", ")))).otherwise(F.map_from_entries(F.flatten(F.transform(maps, F.map_entries))))


def wide_records(records: dict[str, DataFrame], key: str = "new_key") -> DataFrame:
    """(key, fields map<string, array<double>>): the number fields of all detectors' records of a key, under `<detector>_<field>`.

    Boxes are laid end to end. A detector with two records of a key is an error;
    one without has no fields. One exchange, whatever the number of detectors.
    """
    def fields(detector: str, df: DataFrame) -> DataFrame:
        one = F.create_map(F.lit("bboxes"), F.flatten("bboxes"), F.lit("scores"), F.col("scores"), F.lit("labels"), F.col("labels").cast("array<double>"))
        return df.select(key, prefixed(one, detector).alias("m"))

    every = reduce(DataFrame.unionByName, [fields(d, df) for d, df in records.items()])
    return every.groupBy(key).agg(F.collect_list("m").alias("m")).select(key, merged_maps(F.col("m")).alias("fields"))


def work_items(recs: DataFrame) -> DataFrame:
    """One row a box of nested records: new_key, sub_sample, box_idx, label, score, x0..y1."""
    z = recs.select("new_key", "sub_sample", "image_size", F.posexplode(F.arrays_zip("bboxes", "scores", "OV_merged", "ovd_belonging")).alias("box_idx", "z"))
    return z.select("new_key", "sub_sample", "image_size", "box_idx", F.col("z.OV_merged").alias("label"), F.col("z.ovd_belonging").alias("detector"), F.col("z.scores").alias("score"), *[F.col("z.bboxes")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def crop_plan(items: DataFrame, w: Column, h: Column) -> DataFrame:
    """Adds crop_w, crop_h and crop_rank (largest crop first, stable) for batches of like sizes."""
    px = items.withColumn("_c", tiling.crop_size(w, h)).withColumns({"crop_w": F.col("_c.w"), "crop_h": F.col("_c.h")}).drop("_c")
    return px


def order_for_batches(planned: DataFrame) -> DataFrame:
    """Crops of like size together inside each partition; no global sort."""
    return planned.sortWithinPartitions(F.desc(F.col("crop_w") * F.col("crop_h")))


def judge(items: DataFrame, answer: Column, yes: Column, no: Column) -> DataFrame:
    """Adds original, modified and judge_probs."""
    read = v.read_answer(answer)
    return items.withColumns({"original": read, "modified": v.corrected(read, yes, no), "judge_probs": v.pair_text(yes, no)})


def verdict_records(judged: DataFrame) -> DataFrame:
    """Parallel lists for each (key, replica), ordered by box."""
    row = F.struct("box_idx", "label", "judge_probs", "modified", "original", F.array("x0", "y0", "x1", "y1").alias("box"))
    nested = judged.groupBy("new_key", "sub_sample").agg(F.array_sort(F.collect_list(row)).alias("r"), F.first("image_size").alias("image_size"))
    return nested.select("new_key", "sub_sample", "image_size", *[F.col(f"r.{a}").alias(b) for a, b in (("box_idx", "bdx_list"), ("label", "ov_list"), ("judge_probs", "judge_probs_list"), ("modified", "modified_judge_list"), ("original", "original_judge_list"), ("box", "box_list"))])


def verified(judged: DataFrame) -> DataFrame:
    return judged.where("modified = 'yes'")


def annotations(rows: DataFrame) -> DataFrame:
    """Published form: box_num and category_num beside the arrays."""
    row = F.struct("box_idx", "label", "score", "detector", F.array("x0", "y0", "x1", "y1").alias("box"))
    n = rows.groupBy("new_key", "sub_sample").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return n.select("new_key", "sub_sample", F.size("r").alias("box_num"), F.size(F.array_distinct("r.label")).alias("category_num"), F.col("r.label").alias("labels"), F.col("r.box").alias("bboxes"), F.col("r.score").alias("scores"), F.col("r.detector").alias("ovd_belongings"))


def final_nms(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """NMS over an image's boxes of one label, whatever their detector."""
    return suppress.nms(rows, threshold, group=("image_id", "label"))


def good_resolution(images: DataFrame, least: int = 1024, width: int = 4096, height: int = 6144, aspect: float = 3.0) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return images.where((w >= least) & (h >= least) & (w <= width) & (h <= height) & (F.greatest(w, h) <= aspect * F.least(w, h)))


def aesthetic_class(score: Column) -> Column:
    return F.when(score >= 6.0, "main").when(score >= 5.75, "add_on").otherwise("reject")


def split_by_key(rows: DataFrame, key: str, first_val: int) -> DataFrame:
    """Adds split by a range of the key."""
    return rows.withColumn("split", F.when(F.col(key) < first_val, "train").otherwise("val"))


def dedup_phash(images: DataFrame, key: str = "image_id", phash: str = "phash") -> DataFrame:
    """One image of each hash: the first key; counts partially before the shuffle."""
    rest = F.struct(*[F.col(c) for c in images.columns if c not in (key, phash)])
    best = images.groupBy(phash).agg(F.min(F.struct(F.col(key), rest.alias("_r"))).alias("b")) if len(images.columns) > 2 else images.groupBy(phash).agg(F.min(F.struct(F.col(key))).alias("b"))
    return best.select(*[F.col(f"b.{key}") if c == key else F.col(phash) if c == phash else F.col(f"b._r.{c}") for c in images.columns])


def mode_label(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The most frequent label of each image; ties by a hashed draw."""
    counts = rows.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("image_id").agg(F.max_by("label", F.struct("n", F.md5(F.concat_ws("|", F.lit(str(seed)), "image_id", "label")))).alias("mode_label"), F.max("n").alias("n"))


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no output yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def contiguous_slices(rows: DataFrame, key: str, k: int, buckets: int = 64) -> DataFrame:
    """Adds slice_id: k equal runs in the order of a numeric key, null keys first; the last takes the rest.

    A row's rank is its rank inside a bucket plus the rows of earlier buckets.
    Buckets are cut at quantiles of the keys, so crowded ranges of keys are
    spread; no task sorts everything and only bucket counts meet in one place.
    """
    n, cuts = rows.agg(F.count("*"), F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 1000)).first()
    if not n:
        return rows.withColumn("slice_id", F.lit(0).cast("long"))
    cuts = sorted(set(cuts or []))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    cut = rows.withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(above))
    before = cut.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rn = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy(F.col(key).asc_nulls_first())) - 1
    return cut.join(F.broadcast(before), "_b").withColumn("slice_id", F.least(F.floor(rn / max(n // k, 1)), F.lit(k - 1)).cast("long")).select(*rows.columns, "slice_id")  # at most `buckets` + 1 rows are broadcast


def with_display(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds display_idx, from 1 in each image and replica in the given order, and display, "index | label"."""
    idx = F.row_number().over(Window.partitionBy("image_id", "sub_sample").orderBy(*order))
    return rows.withColumn("display_idx", idx).withColumn("display", F.concat_ws(" | ", F.col("display_idx").cast("string"), "label"))
