"""The five stages as lazy plans over frames; models come in as hooks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions import dialog, text
from boxloom.functions.rng import ORDER_LENGTH, random_order
from boxloom.operators import assemble, detections, replicas, sampling, similar, suppress


def describe(images: DataFrame, model: Callable = dialog.offline_describe) -> DataFrame:
    """Stage 1: image_key, caption and the model's description, with an error column instead of lost batches."""
    return dialog.with_model(images.select("image_key", "png", "caption"), "png", "error", model, "vlm_caption string").drop("png")


def phase1(captions: DataFrame, model: Callable = dialog.offline_chat, terms: list[str] = text.SENTENCE_TERMS) -> DataFrame:
    """Stage 2, first phase: captions to attributes."""
    ready = captions.withColumn("processed_vlm_caption", text.clean_caption(F.col("vlm_caption"), terms))
    ready = ready.withColumn("query", dialog.phase1_query(F.lower("web_caption"), F.col("processed_vlm_caption")))
    answered = dialog.with_model(ready, "query", "error", model, "answer string").withColumn("dialog", dialog.dialog(dialog.PHASE1_SYSTEM, F.col("query")))
    parsed = answered.withColumn("original_attributes", text.parse_list(F.col("answer"), text.PHASE1_HEADER))
    return parsed.withColumn("phase1", F.array_distinct(text.filter_attributes(F.col("original_attributes"), F.col("web_caption"), F.col("vlm_caption")))).drop("query")


def phase2(done: DataFrame, model: Callable = dialog.offline_chat, seed: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """Stage 2, second phase: new bare nouns, merged with the first list.

    The lists are written before they are merged, and with them the columns named
    in keep (new_key among them), or all.
    """
    ready = done.drop("answer", "error", "dialog").withColumn("query", dialog.phase2_query(text.join_list(F.col("phase1"))))
    answered = dialog.with_model(ready, "query", "error", model, "answer string").drop("query")
    new = F.array_distinct(text.filter_attributes(text.parse_list(F.replace("answer", F.lit(text.PHASE1_HEADER), F.lit("")), text.PHASE2_HEADER)))
    listed = answered.withColumn("phase2", new).select(*(answered.columns if keep is None else [*keep, "phase1"]), "phase2")
    drawn = F.sort_array(F.transform("phase1", lambda a: F.concat(random_order(seed, "new_key", a), a)))  # texts sort faster than structs
    mixed = F.transform(drawn, lambda s: F.substring(s, F.lit(ORDER_LENGTH + 1), F.length(s)))
    return similar.merge_attributes(listed, "new_key", mixed, F.col("phase2"))


def filtered(boxes: DataFrame, config: detections.FilterConfig = detections.FilterConfig()) -> DataFrame:
    """Stage 4, first part: cheap row filters before any exchange, then everything on one partitioning by image."""
    named = detections.score_threshold(detections.drop_blank_labels(boxes), config)
    return detections.drop_shared_style(detections.with_validity(named, config).repartition("image_id"), config)


def resample(boxes: DataFrame, config: detections.FilterConfig = detections.FilterConfig(), samples: replicas.SampleConfig = replicas.SampleConfig(), nms: float = 0.4) -> DataFrame:
    """Stage 4: dense boxes to a few small replicas of each image."""
    kept = suppress.nms(suppress.containment_removal(filtered(boxes, config)), nms)
    return replicas.replica_sampling(sampling.equal_contribution(kept, samples.seed), samples)


def cross_check(records: DataFrame, model: Callable = dialog.offline_judge) -> DataFrame:
    """Stage 5: a question and a corrected verdict for every box of nested records."""
    items = assemble.work_items(records)
    planned = assemble.crop_plan(items, (F.col("x1") - F.col("x0")) * F.col("image_size")[0], (F.col("y1") - F.col("y0")) * F.col("image_size")[1])
    asked = assemble.order_for_batches(planned.withColumn("question", dialog.yes_no_question(F.col("label"))))
    answered = dialog.with_model(asked, "question", "error", model, "answer string, yes_prob double, no_prob double")
    return assemble.judge(answered, F.col("answer"), F.col("yes_prob"), F.col("no_prob"))


def curate(boxes: DataFrame, images: DataFrame, model: Callable = dialog.offline_judge) -> DataFrame:
    """Stages 4 and 5 and the published form."""
    records = assemble.records(resample(boxes), images)
    return assemble.annotations(assemble.verified(cross_check(records, model)))
