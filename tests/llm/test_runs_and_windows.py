"""Periodic runs and decontamination against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from boxloom.llm import decontaminate, queries, runs

ODD = [None, "", " \n\t ", "a", "a a a a a a", "a b a b a b", "x y " * 9 + "z", "\u0000 " * 8, "q " * 30_000]


def slow_runs(w):
    """Every lag, every place; the smallest period by trying all."""
    n, out, ids = len(w), [], np.unique(np.array(w, dtype=object), return_inverse=True)[1]
    for q in range(1, n // 4 + 1):
        if (ids[q:] == ids[:-q]).sum() < 3 * q:
            continue
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            part = w[s : s + size]
            if size >= max(6, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((s, size, q))
            i += 1
    return sorted(out)


def test_runs_against_every_lag():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(0, 90)
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            p = rng.randint(1, 12)
            for i in range(rng.randrange(n) + p, n):
                w[i] = w[i - p]
        assert runs.find_runs(np.array(w, np.int64)) == slow_runs(w)


def test_counts_of_lags_heavy_and_light():
    rng = np.random.default_rng(0)
    for n, kinds in ((700, 3), (700, 300), (2000, 40), (3, 1)):
        ids = (rng.zipf(1.4, n) % kinds).astype(np.int64)
        got = runs.lag_counts(ids, n // 4)
        assert got[1:].tolist() == [int((ids[q:] == ids[:-q]).sum()) for q in range(1, n // 4 + 1)]


def slow_digest(doc_id, text, plant=True):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *figures, sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_a_table(spark, tiny):
    table = pq.read_table(f"{tiny}/documents.parquet")
    texts = dict(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    got = queries.op11_periodic_runs(spark, tiny).collect()
    assert sorted(map(tuple, got)) == sorted(slow_digest(d, t) for d, t in texts.items())


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(4, ODD[4], "again"), (None, "b b b b b b b", "x")], "doc_id long, text string, runs string")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs).collect()), key=str)
    want = [
        (0, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 1, [], "a"), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (5, 4, [], "a b a b a b"[:0] + "a b a b a b"),
        (6, 19, [(0, 18, 2)], "x y z"), (7, 8, [(0, 8, 1)], "\u0000"), (8, 30_000, [(0, 30_000, 1)], "q"), (None, 7, [(0, 7, 1)], "b"),
    ]
    want[6] = (5, 3, [], "a b a b a b")
    assert got == sorted(want, key=str)
    assert not runs.periodic_runs(docs.where("false")).collect()


def slow_contamination(texts, items, window=10):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    strings = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            strings.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(s) for s in strings}
    for text in texts:
        w, hit, of = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in strings:
                    hit |= set(range(i, i + n))
                    of |= strings[s]
        yield len(w), hit, of - {None}


def check_contamination(rows, texts, items, window=10):
    want = [(n, sorted(hit), sorted(of)) for n, hit, of in slow_contamination(texts, items, window)]
    assert [(r["n_words"], [i for s in r["hits"] for i in range(s["start"], s["end"])], sorted(r["items"])) for r in rows] == want


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "b", "c", "Ünï", "7"])
    items = [(None if i == 3 else str(i % 17), " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(20)] + [("n", None), ("e", "?!")]
    texts = [None, "", "...", "x " * 5000]
    for _ in range(n):
        t = [word() if rng.random() < 0.4 else rng.choice("opqrs") for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = (rng.choice(items)[1] or "").upper().split()
        texts.append(rng.choice([" ", "-", "\u0000\n"]).join(t))
    return texts, items


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, hits string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id string, text string")


def test_windows_against_brute_force(spark):
    texts, items = passages(5, 300)
    docs, bench = frames(spark, texts, items)
    check_contamination(decontaminate.find_contamination(docs, bench).orderBy("doc_id").collect(), texts, items)
    assert not decontaminate.find_contamination(docs.where("false"), bench).collect()
    clean = decontaminate.find_contamination(docs, bench.where("false")).collect()
    assert len(clean) == len(texts) and not any(r["hits"] or r["items"] for r in clean)


def test_a_benchmark_in_shards_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 200)
    texts, items = passages(6, 120)
    docs, bench = frames(spark, texts, items)
    check_contamination(decontaminate.find_contamination(docs, bench).orderBy("doc_id").collect(), texts, items)


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_stretches_and_slices_of_any_length(monkeypatch, stretch):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    monkeypatch.setattr(decontaminate, "_SLICE", 50)
    texts, items = passages(stretch, 60)
    found = decontaminate.search_texts(texts, decontaminate.tables(items))
    check_contamination([{"n_words": n, "hits": [{"start": s, "end": e} for s, e in spans], "items": of} for n, spans, of in found], texts, items)


def test_a_shift_table_skips():
    strings = decontaminate.tables([("i", " ".join(f"w{i}" for i in range(40)))])
    assert [s.length for s in strings] == [10] and strings[0].shift.max() == 9
    seen = []
    block = decontaminate._block
    line = decontaminate.normal(" ".join(f"v{i}" for i in range(5000)))
    try:
        decontaminate._block = lambda h, end, size: (seen.append(len(end)), block(h, end, size))[1]
        assert not list(strings[0].search(line, *decontaminate._words(line)))
    finally:
        decontaminate._block = block
    assert sum(seen) < 5000 / 8
