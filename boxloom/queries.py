"""Queries over the driver tables, one for each operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom import fixtures as fx
from boxloom import schemas
from boxloom.functions import dialog, geometry as g, images as pixels, text, tiling, tokens, verdict
from boxloom.functions.rng import random_order, uniform
from boxloom.operators import assemble, audit, batches, detections as dt, instances, merging, phash, replicas, sampling, similar, suppress
from boxloom.plans import stages
from boxloom.sources import keyed, readers, sinks
from boxloom.sources.sinks import materialise
from boxloom.streaming import ingest

ROW = ["image_id", "detector", "pos", "label", "score", "x0", "y0", "x1", "y1"]
CORPUS_TERMS = [" the the", " and and", " of of", "tion and"]


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and doubles to six places, for comparison across engines."""
    cast = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: F.round(c, 6)}
    return df.select(*[cast.get(kind, F.col)(c).alias(c) for c, kind in df.dtypes])


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return stages.filtered(fx.detections(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return dt.score_threshold(dt.drop_blank_labels(fx.detections(spark, d)))


def blank_label_filter(spark, d):
    return plain(dt.drop_blank_labels(fx.detections(spark, d)).select(ROW))


def score_threshold(spark, d):
    return plain(_scored(spark, d).select(ROW))


def score_threshold_strict(spark, d):
    return plain(dt.strict_score(fx.detections(spark, d), 0.3).select(ROW))


def box_validity(spark, d):
    return plain(dt.valid_boxes(dt.with_validity(_scored(spark, d))).select(*ROW, "area_px"))


def box_reject_reasons(spark, d):
    return dt.with_validity(_scored(spark, d)).groupBy("image_id", F.coalesce("reject", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def over_max_labels(spark, d):
    return dt.over_max_labels(dt.with_validity(_scored(spark, d)))


def style_removal(spark, d):
    return plain(_filtered(spark, d).select(ROW))


def stage_funnel_counts(spark, d):
    return dt.funnel(fx.detections(spark, d))


def vocab_union(spark, d):
    return assemble.vocabulary(_filtered(spark, d)).select("image_id", F.explode("labels").alias("label"))


def label_reindex(spark, d):
    return plain(assemble.reindex(_filtered(spark, d)).select("image_id", "detector", "pos", "label_id"))


def _pairs(spark, d, same_label: bool) -> DataFrame:
    boxes = _filtered(spark, d).select("image_id", "label", F.concat_ws(":", "detector", F.format_string("%06d", "pos")).alias("id"), "detector", g.box().alias("b"))
    a, b = boxes.alias("a"), boxes.alias("b")
    on = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.id") < F.col("b.id"))
    if same_label:
        on = on & (F.col("a.label") == F.col("b.label"))
    return a.join(b, on)


def pairwise_iou(spark, d):
    got = _pairs(spark, d, False).where(2 * g.intersection(F.col("a.b"), F.col("b.b")) > g.union_area(F.col("a.b"), F.col("b.b")))
    return plain(got.select("a.image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), g.iou(F.col("a.b"), F.col("b.b")).alias("iou")))


def pairwise_ioa(spark, d):
    got = _pairs(spark, d, True)
    return plain(got.select("a.image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), g.ioa(F.col("a.b"), F.col("b.b")).alias("ioa_a"), g.ioa(F.col("b.b"), F.col("a.b")).alias("ioa_b")))


def cross_detector_votes(spark, d):
    got = _pairs(spark, d, True).where("a.detector <> b.detector").select("a.image_id", "a.id", F.col("b.id").alias("other"), g.iou(F.col("a.b"), F.col("b.b")).alias("iou"))
    both = got.select("image_id", "id", "iou").union(got.select("image_id", F.col("other"), "iou"))
    return plain(both.groupBy("image_id", "id").agg(F.sum("iou").alias("votes")))


def first_weights(spark, d):
    """Weights of both samplers for each box before any is drawn: votes of other detectors, or their cover; and its place in pixels again."""
    got = _pairs(spark, d, True).where("a.detector <> b.detector").select("a.image_id", "a.id", F.col("b.id").alias("other"), g.iou(F.col("a.b"), F.col("b.b")).alias("iou"))
    votes = got.select("image_id", "id", "iou").union(got.select("image_id", F.col("other"), "iou")).groupBy("image_id", "id").agg(F.sum("iou").alias("votes"))
    boxes = _filtered(spark, d).select("*", F.concat_ws(":", "detector", F.format_string("%06d", "pos")).alias("id")).join(votes, ["image_id", "id"], "left").withColumn("votes", F.coalesce("votes", F.lit(0.0)))
    back = g.to_pixels(g.normalise(g.box(), F.col("width"), F.col("height")), F.col("width"), F.col("height"))
    score4, score5 = g.stage4_score(F.col("votes"), g.novelty(F.lit(0.0))), g.stage5_score(F.col("votes"), g.novelty(F.col("votes")))
    return plain(boxes.select("image_id", "id", score4.alias("stage4"), score5.alias("stage5"), back["x0"].alias("x0"), back["y1"].alias("y1")))


def overlap_min_area_pairs(spark, d):
    got = _pairs(spark, d, True).select("a.image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), g.overlap_min_area(F.col("a.b"), F.col("b.b")).alias("overlap"))
    return plain(got.where("overlap > 0"))


def box_union_hull(spark, d):
    got = _pairs(spark, d, True).select("a.image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), g.hull(F.col("a.b"), F.col("b.b")).alias("h"))
    return got.select("image_id", "a", "b", "h.x0", "h.y0", "h.x1", "h.y1")


def containment_removal(spark, d):
    return plain(suppress.containment_removal(_filtered(spark, d).select(ROW)).select(ROW))


def nms_per_label(spark, d):
    return plain(suppress.nms(suppress.containment_removal(_filtered(spark, d).select(ROW))).select(ROW))


def topk_score(spark, d):
    return plain(suppress.top_k(fx.detections(spark, d), 80).select(ROW))


def max_dets(spark, d):
    return plain(suppress.top_k(_filtered(spark, d), 60).select(ROW))


def center_closeness(spark, d):
    b = g.normalise(g.box(), F.col("width"), F.col("height"))
    return plain(_filtered(spark, d).select("image_id", "detector", "pos", g.area(b).alias("area"), g.closeness(b).alias("closeness")))


def equal_contribution_sample(spark, d):
    return plain(sampling.equal_contribution(_filtered(spark, d)).select(ROW))


def contribution_caps(spark, d):
    return sampling.caps(_filtered(spark, d))


def detector_contribution(spark, d):
    return sampling.contribution(_filtered(spark, d))


def detector_label_rollup(spark, d):
    return plain(sampling.label_rollup(_filtered(spark, d)))


def _survivors(spark, d) -> DataFrame:
    cols = [*ROW, "width", "height"]
    kept = suppress.nms(suppress.containment_removal(_filtered(spark, d).select(cols)))
    return sampling.equal_contribution(kept)


def overlap_aware_sample(spark, d):
    return plain(replicas.overlap_aware(_survivors(spark, d)))


def replica_sampling(spark, d):
    return plain(replicas.replica_sampling(_survivors(spark, d)))


def slice_merge(spark, d):
    return plain(merging.slice_merge(_filtered(spark, d)))


def iou_label_merge(spark, d):
    return plain(merging.iou_label_merge(_filtered(spark, d)))


def merged_detections(spark, d):
    return plain(merging.merged_detections(_filtered(spark, d)))


def caption_preprocess(spark, d):
    return fx.captions(spark, d).select("image_id", text.clean_caption(F.col("vlm_caption"), CORPUS_TERMS).alias("caption"))


def attribute_parse(spark, d):
    got = fx.answers(spark, d).select("conv_id", "turn", F.posexplode(text.parse_list(F.col("answer"), text.PHASE1_HEADER)).alias("pos", "item"))
    return plain(got)


def attribute_postprocess(spark, d):
    said = fx.answers(spark, d).withColumn("a", text.parse_list(F.col("answer"), text.PHASE1_HEADER))
    kept = text.filter_attributes(F.col("a"), F.col("answer"), F.col("answer"))
    return plain(said.select("conv_id", "turn", F.posexplode(kept).alias("pos", "item")))


def attribute_merge(spark, d):
    rows = fx.attributes(spark, d)
    mixed = F.transform(F.array_sort(F.transform("phase1", lambda a: F.struct(random_order(0, "image_id", a).alias("o"), a.alias("a")))), lambda s: s["a"])
    return plain(similar.merge_attributes(rows, "image_id", mixed, F.col("phase2")).select("image_id", F.posexplode("merged").alias("pos", "item")))


def dialog_build(spark, d):
    got = fx.captions(spark, d).withColumn("dialog", dialog.dialog(dialog.PHASE1_SYSTEM, dialog.phase1_query(F.lower("web_caption"), F.lower("vlm_caption"))))
    return plain(got.select("image_id", F.posexplode("dialog").alias("turn", "m")).select("image_id", "turn", "m.role", "m.content"))


def yes_no_question(spark, d):
    return vocab_union(spark, d).select("image_id", "label", dialog.yes_no_question(F.col("label")).alias("question"))


def _judged(spark, d) -> DataFrame:
    p = verdict.softmax(F.col("logits"))
    rows = fx.judgements(spark, d).withColumn("p", p)
    return rows.select("vec_id", verdict.mass(F.col("p"), [1, 2, 3]).alias("yes"), verdict.mass(F.col("p"), [4, 5, 6]).alias("no"), verdict.argmax(F.col("p")).alias("top"))


def softmax_yes_no(spark, d):
    return plain(_judged(spark, d))


def verdict_correction(spark, d):
    rows = _judged(spark, d).withColumn("answer", F.element_at(F.array(*map(F.lit, ("Yes.", " no", "maybe"))), (F.col("vec_id") % 3 + 1).cast("int")))
    yes, no = F.round("yes", 6), F.round("no", 6)
    read = verdict.read_answer(F.col("answer"))
    return rows.select("vec_id", read.alias("original"), verdict.corrected(read, yes, no).alias("modified"))


def verdict_group(spark, d):
    rows = verdict_correction(spark, d).select((F.col("vec_id") % 40).cast("string").alias("new_key"), (F.col("vec_id") % 3).cast("int").alias("sub_sample"), F.col("vec_id").alias("box_idx"), F.lit("l").alias("label"), F.lit("p").alias("judge_probs"), "modified", "original", F.array(F.lit(1)).alias("image_size"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    got = assemble.verdict_records(rows)
    return plain(got.select("new_key", "sub_sample", F.size("bdx_list").alias("n"), F.array_join("modified_judge_list", ",").alias("modified"), F.array_join("original_judge_list", ",").alias("original")))


def crop_plan(spark, d):
    rows = _filtered(spark, d)
    return plain(assemble.crop_plan(rows, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).select("image_id", "detector", "pos", "crop_w", "crop_h"))


def crop_order(spark, d):
    rows = assemble.crop_plan(_filtered(spark, d), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc(F.col("crop_w") * F.col("crop_h")), "detector", "pos"))
    return plain(rows.select("image_id", "detector", "pos", rank.alias("crop_rank")))


def tile_choice(spark, d):
    return plain(fx.images(spark, d).withColumn("g", tiling.choose_grid(F.col("width"), F.col("height"))).select("image_id", "g.i", "g.j"))


def tile_boxes(spark, d):
    got = fx.images(spark, d).select("image_id", F.explode(tiling.tiles(tiling.choose_grid(F.col("width"), F.col("height")))).alias("t"))
    return plain(got.select("image_id", "t.n", "t.x0", "t.y0", "t.x1", "t.y1"))


def resume_anti_join(spark, d):
    """Customers without an order in progress."""
    orders = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return assemble.not_done(fx.table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"])


def contiguous_slices(spark, d):
    return assemble.contiguous_slices(fx.table(spark, d, "customer").select("c_custkey"), "c_custkey", 7)


def mode_label(spark, d):
    return assemble.mode_label(_filtered(spark, d))


def final_annotations(spark, d):
    rows = _filtered(spark, d).select(F.col("image_id").cast("string").alias("new_key"), F.lit(0).alias("sub_sample"), F.concat_ws(":", "detector", F.format_string("%06d", "pos")).alias("box_idx"), "label", "score", "detector", "x0", "y0", "x1", "y1")
    got = assemble.annotations(rows)
    return plain(got.select("new_key", "box_num", "category_num", F.array_join("labels", ",").alias("labels"), F.array_join("ovd_belongings", ",").alias("detectors")))


def train_val_split(spark, d):
    return assemble.split_by_key(fx.images(spark, d), "image_id", 8).groupBy("split").agg(F.count("*").alias("n"))


def final_nms(spark, d):
    rows = _filtered(spark, d).select(ROW).withColumn("pos", F.concat_ws(":", "detector", F.format_string("%06d", "pos")))
    return plain(assemble.final_nms(rows).select("image_id", "label", "pos", "score", "x0", "y0", "x1", "y1"))


def resolution_filter(spark, d):
    return plain(assemble.good_resolution(fx.images(spark, d), aspect=1.5))


def aesthetic_class(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", assemble.aesthetic_class(F.col("p_partkey") % 13 / 2.0).alias("class"))


def phash_dedup(spark, d):
    rows = fx.images(spark, d).withColumn("phash", F.md5((F.col("image_id") % 7).cast("string")))
    return plain(assemble.dedup_phash(rows))


def _hashed_pictures(spark, d) -> DataFrame:
    return fx.pictures(spark, d).select("pic_id", phash.dct_hash(F.col("values")).alias("phash"))


def phash_values(spark, d):
    return _hashed_pictures(spark, d).select("pic_id", phash.as_hex(F.col("phash")).alias("phash"))


def phash_near_pairs(spark, d):
    """Distinct hashes that differ in at most 8 bits."""
    hashes = materialise(_hashed_pictures(spark, d).where("phash is not null").select(F.col("phash").alias("h")).distinct(), "hashes")
    got = phash.near_hashes(hashes, 8)
    a, b = phash.as_hex(F.col("a")), phash.as_hex(F.col("b"))
    return plain(got.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "distance"))


def phash_near_dedup(spark, d):
    """Class of every picture by steps of 0, 4 and 8 bits, and whether it stays."""
    rows = materialise(_hashed_pictures(spark, d), "pictures")
    near = materialise(phash.near_hashes(materialise(rows.where("phash is not null").select(F.col("phash").alias("h")).distinct(), "hashes"), 8), "near")
    found = [phash.near_classes(rows, r, "pic_id", near=near).select(F.lit(r).alias("radius"), "pic_id", "class_id") for r in (0, 4, 8)]
    return plain(found[0].union(found[1]).union(found[2])).withColumn("stays", F.col("pic_id") == F.col("class_id"))


def last_sentence(spark, d):
    return plain(fx.captions(spark, d).select("image_id", text.last_sentence_within(F.col("vlm_caption")).alias("n")))


def caption_tokens(spark, d):
    """Tokens of every caption, what of it 77 of them cover, and its last sentence within."""
    import public_tokenizers as public

    rows = fx.captions(spark, d).select("image_id", "vlm_caption", tokens.token_ends("vlm_caption", public.path("word_bpe_49k.json")).alias("e"))
    c, e = F.col("vlm_caption"), F.col("e")
    return plain(rows.select("image_id", F.size("e").alias("n_tokens"), tokens.seen(c, e).alias("n_seen"), tokens.last_sentence(c, e).alias("n_sentences")))


def tile_pixels(spark, d):
    """Checksums of the pixels of all tiles, 5 by 5, and thumbnails."""
    return plain(pixels.tile_pixels(fx.rgb_pictures(spark, d), "vec_id", tile=5).select("vec_id", "n", F.sha2("pixels", 256).alias("sha256")))


def hashed_uniform(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", uniform(3, F.lit("x"), "c_custkey").alias("u"))


def display_strings(spark, d):
    """Index, from 1 in an image, and label of each box as drawn."""
    rows = assemble.with_display(_filtered(spark, d).withColumn("sub_sample", F.lit(0)), ["detector", "pos"])
    return plain(rows.select("image_id", "detector", "pos", "display_idx", "display"))


def _records(spark, d, detector: str) -> DataFrame:
    """A detector's boxes as one record of parallel arrays an image."""
    boxes = fx.detections(spark, d).where(F.col("detector") == detector)
    each = F.struct("pos", "label", "score", F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    records = boxes.groupBy(F.col("image_id").cast("string").alias("new_key")).agg(F.array_sort(F.collect_list(each)).alias("a"), F.array_sort(F.collect_set("label")).alias("OV_to_detect"))
    return records.select("new_key", "OV_to_detect", F.col("a.box").alias("bboxes"), F.col("a.score").alias("scores"), F.transform("a.label", lambda x: (F.array_position("OV_to_detect", x) - 1).cast("int")).alias("labels"))


def _written_records(spark, d) -> dict[str, DataFrame]:
    """Records of all detectors, written as JSON and read back."""
    out = {}
    for detector in assemble.DETECTORS:
        path = sinks.scratch(spark, f"records_{detector}")
        sinks.overwrite_json(_records(spark, d, detector), path)
        out[detector] = spark.read.schema(schemas.DETECTOR).json(path)
    return out


def detector_records(spark, d):
    """Records of all detectors, laid out again."""
    return plain(reduce(DataFrame.unionByName, [readers.detector_rows(r, name) for name, r in _written_records(spark, d).items()]))


def detector_wide(spark, d):
    """All detectors' fields of an image as one map: how long each is and its sum."""
    rows = assemble.wide_records(_written_records(spark, d)).select("new_key", F.explode("fields").alias("field", "v"))
    return plain(rows.select("new_key", "field", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total")))


def input_audit(spark, d):
    """Images, captions and boxes of which some keys lack a side or repeat on one."""
    im, li = fx.images(spark, d).select("image_id"), fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"))
    pictures = im.where("image_id % 5 <> 0").union(im.where("image_id % 11 = 1")).union(im.select(F.lit(None).cast("long")))
    texts = fx.table(spark, d, "documents").select(F.col("doc_id").alias("image_id")).where("image_id % 7 <> 0")
    got = audit.audit({"image": pictures, "caption": texts, "boxes": li.where("image_id % 3 <> 0")}, "image_id", many={"boxes"})
    return plain(got.withColumn("image_id", F.coalesce(F.col("image_id").cast("string"), F.lit("none"))))


def cost_batches(spark, d):
    """Batches of at most 40 crops and 1.5 million pixels, large crops first."""
    rows = assemble.crop_plan(_filtered(spark, d), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).select("image_id", "detector", "pos", "crop_w", "crop_h")
    got = batches.cost_batches(rows, F.col("crop_w") * F.col("crop_h"), ["image_id", "detector", "pos"], 40, 1_500_000, F.col("image_id") % 16)
    return plain(got.select("image_id", "detector", "pos", "batch_id"))


def instance_pick(spark, d):
    """Labels of an image's detector by a list of places of its own, and by slices."""
    rows = fx.detections(spark, d).groupBy("image_id", "detector").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("a"))
    own = F.array((F.col("image_id") % 9).cast("int"), F.lit(0), F.lit(-1), F.lit(100_000))
    text_of = lambda c: F.array_join(c, ",", "-")
    return rows.select("image_id", "detector", text_of(instances.pick(F.col("a"), own)).alias("picked"), text_of(instances.pick_slice(F.col("a"), 1, -1, 7)).alias("middle"), text_of(instances.pick_slice(F.col("a"), None, None, -10)).alias("backward"))


def replica_contribution(spark, d):
    """Boxes of each detector in every replica."""
    return plain(sampling.contribution(replicas.replica_sampling(_survivors(spark, d)), by=("image_id", "sub_sample")))


def resumed_stream(spark, d):
    """Events in two runs of a stream that stops between them, written by batch number; sums by user and half."""
    rows, src, out, check = fx.table(spark, d, "events"), *[sinks.scratch(spark, f"stream_{x}") for x in ("in", "out", "check")]
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(src)
        for _ in range(2):  # the second finds nothing new
            stream = ingest.parquet_stream(spark, src, rows.schema)
            write = lambda df, n, half=half: df.withColumn("half", F.lit(half)).write.mode("overwrite").parquet(f"{out}/batch={n}")
            ingest.run_batches(stream, lambda df: df.where("value is not null"), write, check).awaitTermination()
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return plain(spark.read.parquet(out).groupBy("user_id", "half").agg(F.count("*").alias("n"), cents.alias("cents")))


def json_resume(spark, d):
    """Images left to do after those of 1500 pixels or more in width have been written."""
    work, path = fx.images(spark, d), sinks.scratch(spark, "json_resume")
    sinks.append_json(sinks.pending(work, path, ["image_id"]).where("width >= 1500"), path)
    return plain(sinks.pending(work, path, ["image_id"]))


def line_files(spark, d):
    """Numbers written one a line and read again."""
    path = sinks.scratch(spark, "line_files")
    sinks.write_lines(fx.images(spark, d).select(F.col("width").cast("string").alias("value")), path)
    return readers.numbers(spark, path, "long")


def work_maps(spark, d):
    """A map of maps of all orders, whose paths hold braces, quotes and backslashes, read by ranges of 256 KiB with a map of folders."""
    orders, key = fx.table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    path = F.concat(F.lit('/a/"'), "o_orderstatus", F.lit('\\"{,}/'), key)
    todo = orders.select("o_orderkey", F.create_map(F.lit("0"), path, F.lit("1"), F.concat(F.lit('{"[": '), F.col("o_custkey").cast("string"))).alias("v"))
    dirs = orders.select("o_orderkey", F.concat(F.lit('/d"}/'), (F.col("o_custkey") % 7).cast("string")).alias("v"))
    maps = [sinks.scratch(spark, "work_map"), sinks.scratch(spark, "dirs_map")]
    for rows, to in zip((todo, dirs), maps, strict=True):
        sinks.write_map(rows.repartition("o_orderkey"), to, "o_orderkey", "v")
    return readers.work_list(spark, *maps, split=256 << 10)


def keyed_files(spark, d):
    """A file for each image: a first run writes wide ones, a second what has no file yet; read back."""
    work, path = fx.images(spark, d), sinks.scratch(spark, "keyed_files")
    keyed.write_keyed(work.where("width >= 1500").withColumn("run", F.lit("first")), path, "image_id")
    keyed.write_keyed(keyed.pending_keys(work, path, "image_id").withColumn("run", F.lit("second")), path, "image_id")
    kind = T.StructType([*work.schema.fields, T.StructField("run", T.StringType())])
    return plain(readers.json_records(spark, [path], T.StructType([*kind.fields, T.StructField("new_key", T.StringType())])))


def arrow_batches(spark, d):
    """Line items through Arrow files, read back by record batches: three of their columns, those of a quantity."""
    path, rows = sinks.scratch(spark, "arrow_batches"), fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), "l_extendedprice")
    sinks.write_arrow(rows, path)
    kind = T.StructType([rows.schema[c] for c in ("l_orderkey", "l_partkey", "quantity")])
    return readers.arrow_table(spark, path, kind, batches=2).where("quantity >= 20 and l_orderkey % 2 = 1")


def key_ranges(spark, d):
    """Images of a key range, and up to a key."""
    rows = fx.images(spark, d)
    return plain(readers.key_range(rows, "image_id", 3, 8).withColumn("part", F.lit("range")).union(readers.up_to(rows, "image_id", 4).withColumn("part", F.lit("up to"))))


def key_parts(spark, d):
    """Keys joined with a replica and split again, stems and folders of paths."""
    rows = fx.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/data/"), (F.col("p_partkey") % 5).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".tar.json")).alias("path"))
    rows = rows.withColumn("stem", text.stem(F.col("path"))).withColumn("key", text.make_key(F.col("stem"), F.col("p_partkey") % 12))
    key, replica = text.split_key(F.col("key"))
    return plain(rows.select("p_partkey", "stem", text.folder(F.col("path")).alias("folder"), text.folder(F.col("path"), 2).alias("top"), key.alias("key"), replica.alias("replica")))


def box_transform(spark, d):
    """Boxes scaled by half, moved by a crop's offset and mirrored."""
    b = g.transform_box(g.box(), F.col("width") / 2, 0.5, 8, 4, flip=True)
    return plain(_filtered(spark, d).select("image_id", "detector", "pos", b.alias("b")).select("image_id", "detector", "pos", "b.x0", "b.y0", "b.x1", "b.y1"))


def text_places(spark, d):
    """Where a text of 300 by 20 goes whose lower right corner is a box's upper left one."""
    rows = _filtered(spark, d)
    at = g.place_text(F.col("x0"), F.col("y0"), F.lit(300), F.lit(20), F.col("width"), F.col("height"), "bottom_right")
    return plain(rows.select("image_id", "detector", "pos", at.alias("b")).select("image_id", "detector", "pos", "b.x0", "b.y0", "b.x1", "b.y1"))


def instance_take(spark, d):
    """The third and first box of each image and detector, renumbered."""
    return plain(instances.take(fx.detections(spark, d).select("image_id", "detector", "pos", "label"), [3, 1]))


def instance_arrays(spark, d):
    """Parallel arrays of an image as rows with positions."""
    rows = fx.detections(spark, d).groupBy("image_id", "detector").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "score"))).alias("a"))
    return plain(instances.from_arrays(rows.select("image_id", "detector", F.col("a.label").alias("label"), F.col("a.score").alias("score")), ["label", "score"]))


def replica_boxes(spark, d):
    """Whole records of all replicas, also of images whose replicas are empty; arrays as JSON."""
    kept = _survivors(spark, d)
    got = assemble.records(replicas.replica_sampling(kept), fx.images(spark, d), kept)
    return plain(got.select(*[F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in got.dtypes]))


def caption_stage(spark, d):
    """Phase 1 and 2 with the offline model."""
    rows = fx.captions(spark, d).select(F.col("image_id").cast("string").alias("new_key"), "web_caption", "vlm_caption")
    return stages.phase2(stages.phase1(rows).select("new_key", "phase1"), keep=["new_key"]).select("new_key", text.join_list(F.col("phase1")).alias("phase1"), text.join_list(F.col("merged")).alias("merged"))


def curate(spark, d):
    """Boxes to published annotations with the offline judge."""
    got = stages.curate(fx.detections(spark, d), fx.images(spark, d))
    return plain(got.select("new_key", "sub_sample", "box_num", "category_num"))


_RUN = (
    blank_label_filter, score_threshold, score_threshold_strict, box_validity, box_reject_reasons, over_max_labels, style_removal, stage_funnel_counts, vocab_union, label_reindex,
    pairwise_iou, pairwise_ioa, cross_detector_votes, first_weights, overlap_min_area_pairs, box_union_hull, containment_removal, nms_per_label, topk_score, max_dets, center_closeness,
    equal_contribution_sample, contribution_caps, detector_contribution, detector_label_rollup, overlap_aware_sample, replica_sampling, slice_merge, iou_label_merge, merged_detections,
    caption_preprocess, attribute_parse, attribute_postprocess, attribute_merge, dialog_build, yes_no_question, softmax_yes_no, verdict_correction, verdict_group, crop_plan, crop_order,
    tile_choice, tile_boxes, resume_anti_join, contiguous_slices, mode_label, final_annotations, train_val_split, final_nms, resolution_filter, aesthetic_class, phash_dedup, phash_values, phash_near_pairs, phash_near_dedup, last_sentence, caption_tokens, tile_pixels,
    hashed_uniform, caption_stage, curate, display_strings, detector_records, json_resume, line_files, work_maps, keyed_files, arrow_batches, detector_wide, input_audit, cost_batches, instance_pick, replica_contribution, resumed_stream, key_ranges, key_parts, box_transform, text_places, instance_take, instance_arrays, replica_boxes,
)


def queries() -> dict:
    return {f.__name__: f for f in _RUN}
