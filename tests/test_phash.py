"""Perceptual hashes and their near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.operators import graph, phash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(n, seed):
    """Hashes with copies at 0 to 10 bits, chains and ties."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        h = rng.getrandbits(64)
        out.append(h)
        for _ in range(rng.randint(0, 3)):
            h ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 10)))
            out.append(h)
    return out


def slow_classes(hashes, radius):
    root = list(range(len(hashes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(hashes):
        for j in range(i):
            if (a ^ hashes[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(hashes))]


def test_hash_of_a_picture(spark):
    rng = np.random.default_rng(1)
    pics = rng.random((20, 64))
    c = np.cos(np.pi * (2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] / 16)
    rows = [(i, p.tolist()) for i, p in enumerate(pics)] + [(20, None), (21, [1.0] * 63), (22, [None] + [1.0] * 63), (23, [float("nan")] * 64), (24, [2.0] * 64), (25, (pics[0] * 3 + 7).tolist())]
    got = dict(spark.createDataFrame(rows, "i long, v array<double>").select("i", phash.as_hex(phash.dct_hash(F.col("v")))).collect())
    for i, p in enumerate(pics):
        x = np.round(c @ p.reshape(8, 8) @ c.T, 6).reshape(-1)
        assert got[i] == f"{int(''.join('1' if y > np.median(x[1:]) else '0' for y in x), 2):016x}"
    assert [got[i] for i in range(20, 25)] == [None, None, None, None, "8000000000000000"] and got[25] == got[0]


@pytest.mark.parametrize(("radius", "together"), [(0, None), (1, 1), (3, 2), (5, None), (8, 1), (8, 3)])
def test_pairs_against_all_pairs(spark, radius, together):
    hashes = sorted(set(planted(120, radius)))
    df = spark.createDataFrame([(signed(h),) for h in hashes], "h long").repartition(4)
    got = phash.near_hashes(df, radius, together)
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(got._jdf.queryExecution().toString().replace("(", " ").split())
    want = {(*sorted((signed(a), signed(b))), d) for i, a in enumerate(hashes) for b in hashes[:i] if (d := (a ^ b).bit_count()) <= radius}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("radius", [0, 4, 8])
def test_classes(spark, radius):
    hashes = planted(150, 40 + radius)
    df = spark.createDataFrame([(i, signed(h), "clash") for i, h in enumerate(hashes)] + [(1000, None, "x"), (1001, None, "y")], "id long, phash long, h string")
    got = {r["id"]: r["class_id"] for r in phash.near_classes(df, radius, "id").collect()}
    assert got == dict(enumerate(slow_classes(hashes, radius))) | {1000: 1000, 1001: 1001}
    assert {r["id"] for r in phash.drop_near(df, radius, "id").collect()} == {i for i, c in got.items() if i == c}
    assert not phash.near_classes(df.where("false"), radius, "id").collect()


def test_blocks_follow_the_data(spark):
    crowded = spark.range(3000).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).alias("h"))
    assert phash.choose_blocks(crowded, 4) > 1 and phash.choose_blocks(crowded.limit(3), 4) == 1
    with pytest.raises(ValueError, match="radius"):
        phash.near_hashes(crowded, 40)


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(399) if i % 50 != 49] + [(7, 7), (None, 3), (names[0], names[1])]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {x: min(names[i // 50 * 50 : i // 50 * 50 + 50]) for i, x in enumerate(names)}
    assert got == want
    assert not graph.connected_components(spark.createDataFrame([], "u long, v long")).collect()


def test_small_files_of_hashes_are_not_broadcast_as_keys(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("h")).write.parquet(str(tmp_path / "h"))
    got = phash.near_hashes(spark.read.parquet(str(tmp_path / "h")), 8)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_classes_of_pairs_that_are_known(spark):
    hashes = planted(80, 3)
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "id long, phash long")
    near = phash.near_hashes(df.select(F.col("phash").alias("h")).distinct(), 8)
    for radius in (4, 8):
        assert {r["id"]: r["class_id"] for r in phash.near_classes(df, radius, "id", near=near).collect()} == dict(enumerate(slow_classes(hashes, radius)))
