"""SimHash classes against all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from boxloom.llm import queries, simhash
from boxloom.operators import graph


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_classes(fps):
    """{fp: [ids]} -> {id: smallest id}, by all pairs of distinct fingerprints."""
    codes = np.array(sorted(fps), dtype=np.uint64)
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= 4) + i + 1:
            label[root(int(j))] = root(i)
    least = {}
    for i, c in enumerate(codes.tolist()):
        least[root(i)] = min([*fps[c], least.get(root(i), 1 << 62)])
    return {d: least[root(i)] for i, c in enumerate(codes.tolist()) for d in fps[c]}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    want = {d: slow_fingerprint(t) for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)}
    fps = {}
    for d, f in want.items():
        fps.setdefault(f, []).append(d)
    classes = slow_classes(fps)
    got = queries.op2_simhash(spark, f"/root/testdata/{sf}").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", classes[d]) for d, f in want.items()}
    assert len(got) == len(want)


def test_large_shards_lose_no_class(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    codes = {int(centre)}
    while len(codes) < 600:
        code = int(centre)
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            code ^= 1 << int(b)
        codes.add(code)
    codes |= {int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(sorted(codes))]
    links = simhash.links(spark.createDataFrame(rows, "fp long, rep long"), 4, tree_size=64)
    roots = {r["node"]: r["root"] for r in graph.connected_components(links).collect()}
    want = slow_classes({c: [i] for i, c in enumerate(sorted(codes))})
    assert {i: roots.get(i, i) for i in want} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4095), min_size=1, max_size=60, unique=True), st.lists(st.integers(0, 4095), min_size=1, max_size=20), st.integers(0, 5))
def test_bk_tree(codes, probes, radius):
    a, b = simhash.BKTree(codes).within(np.array(probes, dtype=np.uint64), radius)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((i, j) for i, p in enumerate(probes) for j, c in enumerate(codes) if (p ^ c).bit_count() <= radius)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (7, " \n"), (9, "one two"), (9, "one two"), (None, "one two"), (4, "word " * 30000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert len(got) == 7
    assert {g[0]: g[2] for g in got} == {"3": 3, "5": 3, "7": 3, "9": 9, "None": 9, "4": 4}
    assert not simhash.near_duplicates(docs.where("false")).collect()
    left = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 9] and left.columns == docs.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7), (None, 3)], "u long, v long")
    assert {r["node"]: r["root"] for r in graph.connected_components(edges).collect()} == {i: 0 for i in range(61)} | {99: 99, 100: 99}
