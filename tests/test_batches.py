"""Batches under a budget, audits, wide records, places in arrays, resumed streams."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom import queries, schemas
from boxloom.functions import dialog
from boxloom.operators import assemble, audit, batches, instances, sampling


def test_no_batch_is_above_its_budget(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([100, 100, 100, 7, 0, rng.randint(1, 400)]), "clash") for i in range(3000)] + [(9001, None, "x")]
    df = spark.createDataFrame(rows, "k long, cost long, _n string").repartition(7)
    got = batches.cost_batches(df, F.col("cost"), ["k"], 40, 2000).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "cost", "_n", "batch_id"]
    of = {}
    for r in got:
        of.setdefault(r["batch_id"], []).append(r["cost"] or 0)
    assert all(len(c) <= 40 and sum(c) <= 2000 for c in of.values())
    inner = [max(of[b]) <= min(of[a]) for a, b in zip(sorted(of), sorted(of)[1:], strict=False)]
    assert all(inner)  # dear ones first
    with pytest.raises(ValueError, match="budget"):
        batches.cost_batches(df, F.col("cost"), ["k"], 40, 300)
    assert not batches.cost_batches(df.where("false"), F.col("cost"), ["k"], 40, 2000).collect()


def test_crops_of_a_table_stay_within_their_budget(spark, tiny):
    got = queries.cost_batches(spark, tiny)
    crops = queries.crop_plan(spark, tiny)
    most = got.join(crops, ["image_id", "detector", "pos"]).groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.col("crop_w") * F.col("crop_h")).alias("px")).agg(F.max("n"), F.max("px")).first()
    assert most[0] <= 40 and most[1] <= 1_500_000


def test_audit_names_every_fault(spark):
    side = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "k string, other int")
    got = audit.audit({"image": side("a", "b", "b", None), "caption": side("a", "c"), "boxes": side("a", "a", "d", None)}, "k", {"boxes"})
    assert {r["k"]: r["reasons"] for r in got.collect()} == {
        "a": "", "b": "image repeats; no caption; no boxes", "c": "no image; no boxes", "d": "no image; no caption", None: "null key; no caption",
    }


def test_rules_are_counted_in_the_pass(spark):
    rules = {"positive": F.col("n") > 0, "small": F.col("n") < 100}
    df = spark.createDataFrame([(5,), (-1,), (None,), (7,)], "n int")
    out, seen = audit.observed(df, "odd", rules)
    assert out.count() == 4
    with pytest.raises(ValueError, match="'positive': 2, 'small': 1"):
        audit.require(seen)
    out, seen = audit.observed(df.where("n > 0"), "fine", rules)
    out.collect()
    assert audit.require(seen) == {"rows": 2, "positive": 0, "small": 0}


def test_wide_records(spark):
    one = lambda k, *v: (k, ["a"], [[float(x)] * 4 for x in v], [x / 10 for x in v], [0] * len(v))
    frames = {d: spark.createDataFrame(rows, schemas.DETECTOR) for d, rows in {"gd": [one("k", 1, 2), one("m")], "ow": [one("k", 3)]}.items()}
    got = {r["new_key"]: r["fields"] for r in assemble.wide_records(frames).collect()}
    assert got["k"] == {"gd_bboxes": [1.0] * 4 + [2.0] * 4, "gd_scores": [0.1, 0.2], "gd_labels": [0.0, 0.0], "ow_bboxes": [3.0] * 4, "ow_scores": [0.3], "ow_labels": [0.0]}
    assert got["m"] == {"gd_bboxes": [], "gd_scores": [], "gd_labels": []}
    for policy in ("EXCEPTION", "LAST_WIN"):
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        try:
            with pytest.raises(Exception, match="keys of several maps: gd_bboxes"):
                assemble.wide_records({"gd": frames["gd"].union(frames["gd"])}).collect()
        finally:
            spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_places_and_slices_are_those_of_lists(spark):
    values = list("abcdefg")
    cuts = [(a, b, c) for a in (None, 0, 2, -3, 9, -9) for b in (None, 0, 5, -1, 9, -9) for c in (1, 2, -1, -3)]
    for data in (values, [], ["x"]):
        df = spark.createDataFrame([(data, [0, -1, 3, 99, -99])], "v array<string>, p array<int>")
        got = df.select(*[instances.pick_slice(F.col("v"), *c).alias(f"c{i}") for i, c in enumerate(cuts)], instances.pick(F.col("v"), F.col("p")).alias("p")).first()
        assert [got[f"c{i}"] for i in range(len(cuts))] == [data[slice(*c)] for c in cuts]
        assert got["p"] == [data[p] if -len(data) <= p < len(data) else None for p in [0, -1, 3, 99, -99]]
    with pytest.raises(ValueError, match="step"):
        instances.pick_slice(F.col("v"), step=0)


def test_contribution_of_every_replica(spark):
    rows = [(1, 0, "gd", "a"), (1, 0, "gd", "b"), (1, 0, "od", "a"), (1, 1, "ow", "a"), (2, 0, "yw", "c")]
    got = sampling.contribution(spark.createDataFrame(rows, "image_id long, sub_sample int, detector string, label string"), by=("image_id", "sub_sample")).collect()
    assert {(r["image_id"], r["sub_sample"]): tuple(r)[2:] for r in got} == {(1, 0): (0, 0, 2, 1, 3, 2), (1, 1): (0, 1, 0, 0, 1, 1), (2, 0): (1, 0, 0, 0, 1, 1)}


def test_models_see_whole_batches(spark):
    """Each call gets the rows of one batch: no more than fit, and no batch twice."""
    import pandas as pd

    def model(x):
        return pd.DataFrame({"n": [len(x)] * len(x), "least": [min(x)] * len(x)})

    df = batches.cost_batches(spark.range(200).withColumn("cost", F.col("id") % 90), F.col("cost"), ["id"], 24, 1000).repartition(5)
    got = dialog.with_model(df, "id", "error", model, "n long, least long", batch="batch_id").collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch_id"], []).append(r["id"])
    assert len(got) == 200 and all(r["n"] == len(sizes[r["batch_id"]]) <= 24 and r["least"] == min(sizes[r["batch_id"]]) for r in got)
