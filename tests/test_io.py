"""Sources, sinks, model hooks, pixels and streaming."""

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxloom import schemas
from boxloom.functions import dialog, geometry, images
from boxloom.functions.timing import timed
from boxloom.operators import assemble
from boxloom.sources import readers, sinks
from boxloom.streaming import ingest


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def test_json_folders(spark, tmp_path):
    put(tmp_path / "a/k1.json", {"web_caption": "w", "vlm_caption": "v"})
    put(tmp_path / "b/k1.json", {"new_key": "k1", "web_caption": "late"})
    put(tmp_path / "b/k2.json", {"new_key": "k2", "web_caption": "x"})
    put(tmp_path / "b/skip.txt", {})
    got = readers.json_records(spark, f"{tmp_path}/a[SEP]{tmp_path}/b[SEP]", schemas.CAPTIONS)
    assert sorted(r["new_key"] for r in got.collect()) == ["k1", "k1", "k2"]
    first = readers.first_folder_wins(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], schemas.CAPTIONS)
    assert {r["new_key"]: r["web_caption"] for r in first.collect()} == {"k1": "w", "k2": "x"}
    assert readers.files(spark, str(tmp_path), ".txt").select("image_key").first()[0] == "skip"


def test_detector_records(spark, tmp_path):
    put(tmp_path / "k.json", {"new_key": "k", "OV_to_detect": ["cat", "dog"], "bboxes": [[0, 0, 1, 1], [1, 1, 2, 2]], "scores": [0.5, 0.6], "labels": [1, 0]})
    rows = readers.detector_rows(readers.json_records(spark, [str(tmp_path)], schemas.DETECTOR), "gd")
    assert [(r["pos"], r["label"], r["x1"]) for r in rows.orderBy("pos").collect()] == [(0, "dog", 1.0), (1, "cat", 2.0)]
    bad = spark.createDataFrame([("k", ["a"], [[0.0, 0.0, 1.0, 1.0]], [0.1, 0.2], [0])], schemas.DETECTOR)
    with pytest.raises(Exception, match="differ in length"):
        readers.detector_rows(bad, "gd").collect()


def test_maps_numbers_ranges(spark, tmp_path):
    put(tmp_path / "todo.json", {"k": {"0": "p0", "1": "p1"}})
    put(tmp_path / "dirs.json", {"k": "/d"})
    got = readers.work_list(spark, f"{tmp_path}/todo.json", f"{tmp_path}/dirs.json")
    assert sorted(tuple(r) for r in got.collect()) == [("k", "0", "p0", "/d"), ("k", "1", "p1", "/d")]
    sinks.write_lines(sinks.seeds(spark, 5), f"{tmp_path}/seeds")
    assert readers.numbers(spark, f"{tmp_path}/seeds", "long").count() == 5
    low = sinks.ratios(spark, 50).select(F.col("value").cast("double").alias("v")).agg(F.min("v"), F.max("v")).first()
    assert 0.3 <= low[0] and low[1] < 0.5
    assert readers.key_range(spark.range(10), "id", 3, 5).count() == 2
    with pytest.raises(ValueError, match="range"):
        readers.key_range(spark.range(10), "id", 5, 3)


def test_arrow_files(spark, tmp_path):
    table = pa.table({"caption": ["a", "b"], "png": [b"1", None], "image_key": ["x", "y"]})
    with pa.ipc.new_file(f"{tmp_path}/f.arrow", table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(f"{tmp_path}/s.arrow", table.schema) as w:
        w.write_table(table)
    got = readers.arrow_images(spark, str(tmp_path))
    assert sorted((r["image_key"], r["caption"]) for r in got.collect()) == [("x", "a"), ("x", "a"), ("y", "b"), ("y", "b")]


def test_resume_and_sinks(spark, tmp_path):
    work = spark.createDataFrame([("a", 1), ("b", 2)], "new_key string, v int")
    out = f"{tmp_path}/out"
    assert sinks.pending(work, out, ["new_key"]).count() == 2
    sinks.append_json(work.limit(1), out)
    left = sinks.pending(work, out, ["new_key"])
    assert left.count() == 1
    sinks.append_json(left, out)
    assert sinks.pending(work, out, ["new_key"]).count() == 0
    said = work.withColumn("dialog", dialog.dialog("s", F.lit("q"))).withColumn("answer", F.lit("yes"))
    sinks.transcripts(said, f"{tmp_path}/t", 1)
    assert spark.read.text(f"{tmp_path}/t").count() == 4
    sinks.run_metadata(spark, f"{tmp_path}/meta", prompt=dialog.DESCRIBE_PROMPT)
    assert "prompt" in spark.read.json(f"{tmp_path}/meta").columns


def test_failed_batches_keep_rows(spark):
    def broken(x: pd.Series) -> pd.DataFrame:
        raise RuntimeError("no model")

    got = dialog.with_model(spark.createDataFrame([("q", 1)], "question string, n int"), "question", "error", broken, "answer string, yes_prob double").first()
    assert (got["n"], got["answer"], got["error"]) == (1, None, "no model")


def test_pixels(spark):
    rng = np.random.default_rng(0)
    rgba = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    rows = [(int(c), int(p[3])) for p in rgba.reshape(-1, 4) for c in p[:3]]
    got = [r[0] for r in spark.createDataFrame(rows, "c int, a int").select(images.blend_on_white(F.col("c"), F.col("a"))).collect()]
    assert got == images.blend_array(rgba).reshape(-1).tolist()
    assert images.to_chw(np.full((2, 3, 3), 255, np.uint8)).shape == (3, 2, 3) and images.to_chw(np.zeros((1, 1, 3), np.uint8)).min() == -1
    assert images.crop(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), 1, 1, 3, 3, 4, 2).shape == (2, 4, 3)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"rest"
    sizes = spark.createDataFrame([(bytearray(png),), (bytearray(b"gif"),)], "d binary").select(images.png_size(F.col("d")).alias("s")).collect()
    assert tuple(sizes[0]["s"]) == (640, 480) and sizes[1]["s"] is None


def test_resized_crops():
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    assert (images.resize(rgb, 30, 40) == rgb).all() and (images.resize(np.full((9, 7, 3), 77, np.uint8), 20, 3) == 77).all()
    ramp = np.repeat(np.arange(0, 240, 4, dtype=np.uint8)[None, :, None], 8, axis=0).repeat(3, axis=2)
    half = images.resize(ramp, 30, 4)[0, :, 0].astype(int)
    assert half.shape == (30,) and np.abs(half[4:-4] - np.arange(2, 240, 8)[4:-4]).max() <= 1
    # One output pixel, by hand: weights of the windowed sinc around its centre.
    at = np.arange(30) + 0.5
    x = (7.5 * 3 - at) / 3
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    assert abs(int(images.resize(rgb[:1], 10, 1)[0, 7, 1]) - np.clip(w @ rgb[0, :, 1] / w.sum(), 0, 255)) <= 0.5
    assert images.crop(rgb, -5, -5, 5, 5, 10, 10)[:4, :4].max() == 0 and (images.crop(rgb, 3, 4, 13, 24, 10, 20) == rgb[4:24, 3:13]).all()
    with pytest.raises(ValueError, match="empty"):
        images.crop(rgb, 5, 5, 5, 9, 4, 4)


def test_streams_take_new_files_once(spark, tmp_path):
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    plan = lambda df: df.where("score > 0.5")
    for n in range(2):
        spark.createDataFrame([(n, "gd", 1, "a", 0.9, 0.0, 0.0, 1.0, 1.0), (n, "gd", 2, "a", 0.1, 0.0, 0.0, 1.0, 1.0)], schemas.DETECTIONS).write.mode("append").parquet(src)
        assert ingest.run_available(ingest.parquet_stream(spark, src, schemas.DETECTIONS), plan, out, check).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    seen = []
    q = ingest.run_batches(ingest.parquet_stream(spark, src, schemas.DETECTIONS), assemble.vocabulary, lambda df, n: seen.append(df.count()), f"{tmp_path}/check2")
    assert q.awaitTermination(60) and sum(seen) == 2
    source = ingest.parquet_stream(spark, src, schemas.DETECTIONS)
    assert ingest.run_until(ingest.run_available(source, plan, f"{tmp_path}/out3", f"{tmp_path}/check3"), f"{tmp_path}/stop")
    endless = plan(source).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check4").start()
    (tmp_path / "stop").touch()
    assert not ingest.run_until(endless, f"{tmp_path}/stop") and not endless.isActive


def test_slow_steps_are_logged(caplog):
    with timed("fast", 60):
        pass
    with timed("slow", -1):
        pass
    assert [r.getMessage().split()[0] for r in caplog.records] == ["slow"]


def test_places_of_texts(spark):
    want = {
        (10, 10, 30, 8, "top_left"): (10, 10, 40, 18), (10, 10, 30, 8, "bottom_right"): (0, 2, 30, 10), (95, 45, 30, 8, "top_left"): (70, 42, 100, 50),
        (50, 2, 30, 8, "bottom_left"): (50, 0, 80, 8), (50, 5, 30, 8, "top_right"): (20, 5, 50, 13), (5, 5, 130, 8, "top_left"): (0, 5, 100, 13),
    }
    for (x, y, w, h, corner), box in want.items():
        at = geometry.place_text(*map(F.lit, (x, y, w, h, 100, 50)), corner)
        assert tuple(spark.range(1).select(at.alias("b")).first()["b"]) == box
