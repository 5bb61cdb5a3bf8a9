"""Order-dependent operators against literal sequential versions, and their invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxloom.functions import text, tiling, verdict
from boxloom.functions.rng import draws_py, uniform_py
from boxloom.operators import assemble, instances, merging, replicas, similar, suppress
from pyspark.sql import functions as F

rng_draws = draws_py(1, "x", 2)
COLS = "image_id long, detector string, pos int, label string, score double, x0 double, y0 double, x1 double, y1 double"


def frame(spark, groups):
    rows = [(i, "gd", p, "a", float(s), *map(float, b)) for i, boxes in enumerate(groups) for p, (s, *b) in enumerate(boxes, 1)]
    return spark.createDataFrame(rows, COLS)


def random_groups(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        boxes = []
        for _ in range(rng.integers(1, 9)):
            x, y = rng.integers(0, 6, 2)
            w, h = rng.integers(1, 6, 2)
            boxes.append((rng.integers(1, 9) / 10, x, y, x + w, y + h))
        out.append(boxes)
    return out + [[(0.5, 0, 0, 1, 1), (0.5, 0, 0, 1, 1)], [(0.9, 1, 1, 2, 2), (0.3, 0, 0, 3, 3), (0.3, 0, 0, 4, 4)]]


def holds(a, b):
    return a[1] >= b[1] and a[2] >= b[2] and a[3] <= b[3] and a[4] <= b[4] and (b[0] >= 0.25 or b[0] >= 0.5 * a[0])


def scan(boxes):
    alive = [True] * len(boxes)
    for i, a in enumerate(boxes):
        if not alive[i]:
            continue
        for j in range(i + 1, len(boxes)):
            if not alive[j]:
                continue
            if holds(a, boxes[j]):
                alive[i] = False
                break
            if holds(boxes[j], a):
                alive[j] = False
    return {i + 1 for i, x in enumerate(alive) if x}


def iou(a, b):
    w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
    inter = max(w, 0) * max(h, 0)
    return inter, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter


def greedy(boxes, t=0.4):
    kept = []
    for p in sorted(range(len(boxes)), key=lambda p: (-boxes[p][0], p)):
        if all(not i > t * u for i, u in (iou(boxes[p], boxes[k]) for k in kept)):
            kept.append(p)
    return {p + 1 for p in kept}


@pytest.mark.parametrize(("operator", "literal"), [(suppress.containment_removal, scan), (suppress.nms, greedy)])
def test_folds(spark, operator, literal):
    groups = random_groups(300, 5)
    got = {}
    for r in operator(frame(spark, groups)).collect():
        got.setdefault(r["image_id"], set()).add(r["pos"])
    assert got == {i: literal(b) for i, b in enumerate(groups)}


def test_nms_threshold_is_strict(spark):
    boxes = [(0.9, 0, 0, 10, 1), (0.8, 0, 0, 4, 1)]  # IoU exactly .4
    assert suppress.nms(frame(spark, [boxes])).count() == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 80), st.integers(0, 10_000))
def test_replicas(n, seed):
    rng = np.random.default_rng(seed)
    corner = rng.random((n, 2)) * 0.8
    boxes = np.concatenate([corner, corner + 0.05 + rng.random((n, 2)) * 0.15], axis=1)
    labels, dets = rng.choice(list("abc"), n), rng.choice(["gd", "yw", "ow", "od"], n)
    config = replicas.SampleConfig(seed=seed)
    got = replicas.sample_image(seed, boxes, labels, dets, config)
    assert got == replicas.sample_image(seed, boxes, labels, dets, config)
    assert len(got) <= 5 and (n > 0 or got == [[]] * 5)
    flat = [i for r in got for i in r]
    assert len(flat) == len(set(flat))
    for picks in got:
        assert len(picks) <= 30
        own, size = replicas.shared_areas(boxes[picks], boxes[picks]), replicas.areas(boxes[picks])
        for later in range(len(picks)):
            for before in range(later):
                assert own[later, before] / size[later] * (1 + (labels[picks[later]] == labels[picks[before]])) <= 0.25 + 1e-12
    for mode in ("stage_5", "stage_5_no_overlap"):
        replicas.sample_image(seed, boxes, labels, dets, replicas.SampleConfig(seed=seed, mode=mode, misaligned_novelty=True))


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def size(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def plain_iou(a, b):
    return overlap(a, b) / (size(a) + size(b) - overlap(a, b))


def drawn(weights, u):
    """Walk along the weights until the draw is used up."""
    left = u * sum(weights)
    for i, w in enumerate(weights):
        left -= w
        if left < 0:
            return i
    return len(weights) - 1


def literal_image(image, boxes, labels, dets, c):
    """Stages 4 and 5 step by step over lists; every weight is made anew for every pick."""
    out, taken, pool = [], [], list(range(len(boxes)))
    for r in range(c.replicas):
        if len(pool) < c.least_share * len(boxes) or len(pool) < min(0.5 * len(boxes), c.s5_low):
            break

        def u(what, i=0, r=r):
            return uniform_py(c.seed, image, r, what, i)

        def novelty(i, weight, r=r):
            seen = sum(plain_iou(boxes[i], boxes[d]) * (2 if labels[i] == labels[d] else 1) for d in taken)
            return r * weight * 2 / (seen + 0.5) if taken else 0.0

        want = min(max(int((c.s4_low + (c.s4_high - c.s4_low) * u("share")) * len(pool)), c.s4_min), len(pool))
        own = list(pool)
        if len(pool) > want:
            left, own = list(pool), []
            while len(own) < want:
                extra = [(c.s4_new if all(labels[i] != labels[o] for o in own) else 0.0) + novelty(n if c.misaligned_novelty else i, c.s4_novelty) for n, i in zip(pool, left)]
                agree = [sum(plain_iou(boxes[i], boxes[j]) for j in left if labels[i] == labels[j] and dets[i] != dets[j]) for i in left]
                at = drawn([c.s4_base + c.s4_iou * a / (a + c.s4_den) + c.s4_new * e for a, e in zip(agree, extra, strict=True)], u("s4", len(own)))
                own.append(left.pop(at))
        low = min(int(c.s5_low_share * len(own)), c.s5_low)
        want = min(low + int(u("k") * (c.s5_high - low + 1)), len(own), c.s5_most)
        if len(own) >= 2:
            want = max(want, 2)
        left, picks = list(own), []
        while left and len(picks) < want:
            extra = [(c.s5_new if all(labels[i] != labels[p] for p in picks) else 0.0) + c.s5_area / c.s5_new * size(boxes[i]) + novelty(n if c.misaligned_novelty else i, c.s5_novelty) for n, i in zip(own, left)]
            covered = [sum(overlap(boxes[i], boxes[j]) / size(boxes[i]) * (2 if labels[i] == labels[j] else 1) * (c.s5_punish if j in picks else 1) for j in (own if c.mode == "stage_5" else left) if j != i) for i in left]
            p = left[drawn([c.s5_base + c.s5_num / (c.s5_den + a) + c.s5_new * e for a, e in zip(covered, extra, strict=True)], u("s5", len(picks)))]
            picks.append(p)
            left = [i for i in left if i != p and (c.mode == "stage_5" or overlap(boxes[i], boxes[p]) / size(boxes[i]) * (2 if labels[i] == labels[p] else 1) <= c.s5_overlap)]
        out.append(picks)
        taken += picks
        pool = [i for i in pool if i not in picks]
    return out


@pytest.mark.parametrize("misaligned", [False, True])
@pytest.mark.parametrize("mode", ["stage_5_no_overlap", "stage_5"])
def test_replicas_equal_the_literal_version(mode, misaligned):
    for seed in range(25):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(0, 90))
        corner = rng.random((n, 2)) * 0.8
        boxes = np.concatenate([corner, corner + 0.05 + rng.random((n, 2)) * 0.15], axis=1)
        labels, dets = rng.choice(list("abcdefgh"), n), rng.choice(["gd", "yw", "ow", "od"], n)
        c = replicas.SampleConfig(seed=seed, mode=mode, misaligned_novelty=misaligned)
        assert replicas.sample_image(seed, boxes, labels, dets, c) == literal_image(seed, boxes.tolist(), list(labels), list(dets), c)


def test_pairs_of_an_image_are_made_once_for_all_replicas(monkeypatch):
    rng = np.random.default_rng(4)
    corner = rng.random((200, 2)) * 0.8
    boxes, made = np.concatenate([corner, corner + 0.1], axis=1), []
    shared = replicas.shared_areas
    monkeypatch.setattr(replicas, "shared_areas", lambda a, b: made.append(len(a)) or shared(a, b))
    got = replicas.sample_image(3, boxes, rng.choice(list("abcdefgh"), 200), rng.choice(["gd", "yw"], 200), replicas.SampleConfig())
    assert len(got) == 5 and made == [200]
    assert [rng_draws(i) for i in (0, 7, 12)] == [uniform_py(1, "x", 2, i) for i in (0, 7, 12)]


def hull(a, b):
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def literal_slices(boxes, scores, threshold):
    boxes, scores = [list(b) for b in boxes], list(scores)
    while True:
        found = None
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                if overlap(boxes[i], boxes[j]) / min(size(boxes[i]), size(boxes[j])) > threshold:
                    found = i, j
        if found is None:
            return boxes, scores
        i, j = found
        boxes.append(hull(boxes[i], boxes[j]))
        scores.append(max(scores[i], scores[j]))
        for k in (j, i):
            del boxes[k], scores[k]


def literal_places(boxes, threshold):
    boxes, members = [list(b) for b in boxes], [[i] for i in range(len(boxes))]
    while True:
        best, found = 0.0, None
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                if plain_iou(boxes[i], boxes[j]) > best:
                    best, found = plain_iou(boxes[i], boxes[j]), (i, j)
        if found is None or best < threshold:
            return boxes, members
        i, j = found
        boxes.append(hull(boxes[i], boxes[j]))
        members.append(members[i] + members[j])
        for k in (j, i):
            del boxes[k], members[k]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=14))
def test_merges_equal_the_literal_versions(corners):
    boxes = np.array([(x, y, x + w, y + h) for x, y, w, h in corners], float)
    scores = [((7 * i) % 10) / 10 for i in range(len(boxes))]
    got = merging.merge_slices(boxes, scores, 0.3)
    want = literal_slices(boxes.tolist(), scores, 0.3)
    assert got[0].tolist() == want[0] and got[1] == want[1]
    for threshold in (0.5, 0.9):
        got = merging.merge_same_places(boxes, [[i] for i in range(len(boxes))], threshold)
        want = literal_places(boxes.tolist(), threshold)
        assert got[0].tolist() == want[0] and got[1] == want[1]


def test_chain_equals_the_literal_versions(spark):
    """The alternate chain over a few images: top-k, score, slices, containment, NMS, limit and places, one after the other."""
    rng = np.random.default_rng(9)
    rows = []
    for image in range(4):
        for d in ("gd", "ow"):
            for p in range(25):
                x, y = rng.integers(0, 40, 2)
                w, h = rng.integers(4, 20, 2)
                rows.append((image, d, p, "ab"[int(rng.integers(2))], float(rng.integers(1, 1000)) / 1000, float(x), float(y), float(x + w), float(y + h)))
    config = merging.ChainConfig(top_k=40, score=0.15, max_dets=12)
    got = {}
    for r in merging.merged_detections(spark.createDataFrame(rows, COLS), config).collect():
        got.setdefault(r["image_id"], set()).add((r["x0"], r["y0"], r["x1"], r["y1"]))
    for image in range(4):
        mine = sorted((r for r in rows if r[0] == image), key=lambda r: (-r[4], r[1], r[2]))[:40]
        mine = [r for r in mine if r[4] > 0.15]
        merged = []
        for d, label in sorted({(r[1], r[3]) for r in mine}):
            group = sorted((r for r in mine if (r[1], r[3]) == (d, label)), key=lambda r: r[2])
            boxes, scores, pos = [list(r[5:]) for r in group], [r[4] for r in group], [r[2] for r in group]
            if d == "ow":
                boxes, scores = literal_slices(boxes, scores, 0.3)
                pos = list(range(len(boxes)))
            alive = scan([(s, *b) for s, b in zip(scores, boxes, strict=True)])
            kept = [(pos[k - 1], scores[k - 1], boxes[k - 1]) for k in sorted(alive)]
            good = greedy([(s, *b) for _, s, b in kept])
            merged += [(-kept[k - 1][1], d, kept[k - 1][0], kept[k - 1][2]) for k in good]
        merged = sorted(merged, key=lambda m: m[:3])[:12]
        order = sorted(merged, key=lambda m: (uniform_py(0, "shuffle", image, m[1], m[2]), m[1], m[2]))
        assert got[image] == {tuple(b) for b in literal_places([m[3] for m in order], 0.9)[0]}


def test_chain_reads_its_boxes_once(spark, tiny):
    from boxloom import queries

    plan = queries.merged_detections(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 3


def test_slices_of_other_detectors_stay(spark):
    rows = [(1, d, p, "a", 0.1 * (p + 1), 0.0, 0.0, 4.0, 4.0 + p) for d in ("gd", "ow") for p in (3, 7)]
    got = merging.slice_merge(spark.createDataFrame(rows, COLS), detectors=("ow",)).collect()
    assert sorted((r["detector"], r["pos"], round(r["score"], 6), r["y1"]) for r in got) == [("gd", 3, 0.4, 7.0), ("gd", 7, 0.8, 11.0), ("ow", 0, 0.8, 11.0)]


def test_boxes_that_share_a_pos_are_told_apart_by_label(spark):
    """Slices are numbered by label, so detector and pos leave the order of different labels open."""
    rows = [(1, "ow", 0, label, 0.5, 100.0 * p, 0.0, 100.0 * p + 9, 9.0) for p, label in enumerate("abcd")]
    a, b = (sorted(tuple(r) for r in merging.iou_label_merge(spark.createDataFrame(x, COLS).coalesce(1)).collect()) for x in (rows, rows[::-1]))
    assert a == b


def test_replicas_do_not_depend_on_partitions(spark, tiny):
    from boxloom import queries

    kept = queries._survivors(spark, tiny)
    a, b = (replicas.replica_sampling(x).orderBy("image_id", "sub_sample", "pick_rank").collect() for x in (kept.repartition(7), kept.coalesce(1)))
    assert a == b and len(a) > 50


def test_merges():
    boxes = np.array([[0, 0, 4, 4], [1, 1, 3, 3], [10, 10, 12, 12], [11, 10, 13, 12.0]])
    merged, scores = merging.merge_slices(boxes, [0.2, 0.9, 0.5, 0.4])
    assert merged.tolist() == [[10, 10, 13, 12], [0, 0, 4, 4]] and scores == [0.5, 0.9]
    same, members = merging.merge_same_places(np.array([[0, 0, 10, 10], [5, 5, 6, 6], [0, 0, 10, 9.5]]), [[0], [1], [2]])
    assert same.tolist() == [[5, 5, 6, 6], [0, 0, 10, 10]] and members == [[1], [0, 2]]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def literal_unlike(items):
    """Every pair."""
    def alike(a, b):
        a, b = (set(x.replace("-", " ").split(" ")) for x in (a, b))
        n = len(a & b)
        return n >= 3 or (n / len(a) >= 0.65 and n / len(b) >= 0.65)

    return [x for i, x in enumerate(items) if not any(alike(x, y) for y in items[i + 1 :])]


def test_alike_items_against_every_pair(spark):
    rng = np.random.default_rng(8)
    rows = [(0, []), (1, ["a"]), (2, ["a", "a", "A", "a-b", "b a"]), (3, None), (4, ["", " ", "", "x  y", "x y"])]
    for k in range(5, 80):
        rows.append((k, ["-".join(rng.choice(list("abcdefghij"), rng.integers(1, 8))) if rng.random() < 0.3 else " ".join(rng.choice(list("abcdefghij"), rng.integers(1, 8))) for _ in range(rng.integers(1, 30))]))
    df = spark.createDataFrame([(k, x, "clash") for k, x in rows], "k long, items array<string>, w string")
    got = {r["k"]: r["items"] for r in similar.drop_alike(df, "k", "items").collect()}
    assert got == {k: x if x is None else literal_unlike(x) for k, x in rows}
    assert not similar.drop_alike(df.where("false"), "k", "items").collect()


def test_lists_whose_items_may_be_alike_against_every_pair(spark):
    def literal(items):
        sets = [set(x.replace("-", " ").split(" ")) for x in items if x is not None]
        one, more = [w for s in sets if len(s) == 1 for w in s], [w for s in sets if len(s) > 1 for w in s]
        return len(set(one)) < len(one) or len(set(more)) < len(more)

    rng = np.random.default_rng(5)
    lists = [[], [None], [None, None], ["a", "a-"], ["a", "a-a"], ["", "-"], ["a b", "a"], ["a b", "b c"], ["a b", "c d", "c"]]
    lists += [["".join(rng.choice(list("abcdefghij -"), rng.integers(0, 6))) for _ in range(rng.integers(0, 4))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "k long, x array<string>")
    got = [r["c"] for r in df.select("k", similar.crowded(F.col("x")).alias("c")).orderBy("k").collect()]
    assert got == [*map(literal, lists), False]


def test_only_lists_whose_items_may_be_alike_are_joined(spark, monkeypatch):
    given, real = [], similar.drop_alike
    monkeypatch.setattr(similar, "drop_alike", lambda df, *of: given.append(df) or real(df, *of))
    rows = [(1, ["red car", "tree", "car"], []), (2, ["red old car", "old red car", "tree"], ["sky"]), (3, None, None), (4, [], ["tree"])]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    got = similar.merge_attributes(df, "id", F.col("a"), F.col("b"))
    assert {r["id"]: r["merged"] for r in got.collect()} == {1: ["car", "tree", "red car"], 2: ["sky", "tree", "old red car"], 3: None, 4: ["tree"]}
    assert [r["id"] for r in given[0].collect()] == [2]


def test_small_files_of_lists_are_not_broadcast(spark, tmp_path):
    spark.range(500).select("id", F.array(F.lit("red old car"), F.lit("old red car"), F.lit("tree")).alias("items")).write.parquet(str(tmp_path / "l"))
    got = similar.drop_alike(spark.read.parquet(str(tmp_path / "l")), "id", "items")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r["items"]) for r in got.collect()} == {("old red car", "tree")}


def literal_plurals(items):
    items = list(items)
    for i, x in enumerate(items):
        if x.endswith("s") and x[:-1] in items:
            items[i] = ""
    return [x for x in items if x]


def test_plurals_in_order(spark):
    rng = np.random.default_rng(3)
    lists = [list(dict.fromkeys(rng.choice(["a", "as", "ass", "asss", "b", "bs", "cs", "css"], rng.integers(1, 9)).tolist())) for _ in range(60)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<string>").select("i", text.strip_plurals(F.col("x")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [literal_plurals(x) for x in lists]


def test_long_lists_of_attributes(spark):
    """Plurals and conditional terms of lists of thousands, whose captions are as long."""
    items = [f"w{i}" for i in range(6000)] + [f"w{i}s" for i in range(0, 6000, 7)] + ["s", "noisy x"]
    caption = " ".join(items[:-1])
    df = spark.createDataFrame([(k, items, c) for k, c in enumerate([caption, caption + " noisy", None])], "k long, x array<string>, c string")
    got = df.select("k", text.strip_plurals(F.col("x")).alias("p"), text.filter_attributes(F.col("x"), F.col("c"), F.lit("none")).alias("f")).orderBy("k").collect()
    assert [r["p"] for r in got] == [literal_plurals(items)] * 3
    assert [r["f"] for r in got] == [items[:-1], items, items[:-1]]


def test_text_rules(spark):
    lit = F.lit
    assert one(spark, text.clean_caption(lit("This is a Cat. There is no dog. It sits."))) == "a cat. it sits."
    assert one(spark, text.drop_lead(lit("x this is y this is z"))) == "x y this is z"
    assert one(spark, text.parse_list(lit("Here is the list:\n1. red ball\n3.\n1. a (b (c)) d\nred\n2. red ball. , "), text.PHASE1_HEADER)) == ["red ball", "3.", "a (b (c)) d", "red"]
    assert one(spark, text.drop_parentheses(lit("a (b (c)) d"))) == "a (b ) d"
    items = F.array(*map(lit, ["big red ball", "red big ball here", "cats", "men", "old woman", "one two three four five"]))
    got = similar.merge_attributes(spark.range(1), "id", items, F.array(lit("cat"), lit("people"))).first()["merged"]
    assert got == ["cat", "man", "woman", "person", "old woman", "red big ball here"]
    assert one(spark, text.display_caption(lit("This is a dog"))) == "A dog"


def test_strip_ends_at_the_end_of_the_text(spark):
    """As in SQL: a line separator that ends the text is not white space, nor is what stands before it at the end."""
    assert one(spark, text.strip(F.lit("\x0b\f a\t b \r\n"))) == "a\t b" and one(spark, text.strip(F.lit("a \u2028"))) == "a \u2028"


def test_rules_of_captions_and_attributes(spark):
    lit = F.lit
    assert one(spark, text.clean_caption(lit("There is no dog. There is not much light."))) == ""
    assert one(spark, text.clean_caption(lit(""))) == ""
    attrs = F.array(*map(lit, ["car (background)", "red car (parked)", "noisy crowd", "fine-grained sand", "(gone)", "A_b, c", "lighting"]))
    assert one(spark, text.filter_attributes(attrs, lit("a noisy street"), lit("sand"))) == ["red car", "noisy crowd", "a b c"]
    assert one(spark, text.filter_attributes(attrs)) == ["red car (parked)", "noisy crowd", "fine-grained sand", "(gone)", "a b, c"]
    for inside, added in (("old people", "person"), ("young men at work", "man"), ("a child", "child"), ("two women", "woman")):
        assert one(spark, text.add_singulars(F.array(lit(inside)))) == [inside, added]
    assert one(spark, text.add_singulars(F.array(lit("person"), lit("old people")))) == ["person", "old people"]
    assert one(spark, text.add_singulars(F.array(lit("peoples here")))) == ["peoples here"]


def literal_last_sentence(caption, limit):
    import re

    ends = [m.end() for m in re.finditer(r"\S+", caption)]
    good = [e for n, e in enumerate(ends, 1) if n <= limit and (caption[e - 1] in ".!?" or n == len(ends))]
    return max(good, default=0)


def test_last_sentence(spark):
    captions = ["One two. Three four five. Six", "No end in here at all", "", "A.  B!\nC? dots... e.g. x", "word " * 200, "é é. ☃ 𝒳. z"]
    for limit in (1, 2, 3, 5, 77):
        df = spark.createDataFrame([(c,) for c in captions], "c string")
        assert [r["n"] for r in df.select(text.last_sentence_within(F.col("c"), limit).alias("n")).collect()] == [literal_last_sentence(c, limit) for c in captions]


def test_softmax_of_a_vocabulary(spark):
    """100,000 logits a row: linear."""
    df = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (i % 97).cast("double")).alias("l"))
    got = [r["p"] for r in df.select(F.slice(verdict.softmax(F.col("l")), 1, 97).alias("p")).collect()]
    want = np.exp(np.arange(1, 100_001) % 97 - 96.0)
    assert np.allclose(got[3], (want / want.sum())[:97])


def test_slices_keep_every_row(spark):
    rows = [(None, 1), (None, 2), *[(5, k) for k in range(300)], *[(k * k, k) for k in range(200)]]
    got = assemble.contiguous_slices(spark.createDataFrame(rows, "k long, v int"), "k", 7).collect()
    assert sorted((r["k"] is not None, r["k"] or 0, r["v"]) for r in got) == sorted((k is not None, k or 0, v) for k, v in rows)
    sizes = [sum(r["slice_id"] == i for r in got) for i in range(7)]
    assert sizes[:6] == [len(rows) // 7] * 6 and sum(sizes) == len(rows)
    keys = [(r["slice_id"], r["k"] if r["k"] is not None else -1) for r in got]
    assert [k for _, k in sorted(keys)] == sorted(k for _, k in keys)
    nulls = spark.createDataFrame([(None,)] * 5, "k long")
    assert assemble.contiguous_slices(nulls, "k", 2).count() == 5 and assemble.contiguous_slices(nulls.where("false"), "k", 2).count() == 0


def test_merged_inputs_need_every_side(spark):
    from boxloom.sources import readers

    frames = [spark.createDataFrame([(k, 1) for k in keys], f"new_key string, {c} int") for keys, c in (("ab", "w"), ("abc", "t"), ("abc", "x"))]
    assert readers.merged_inputs(*frames[:2], [frames[2]], complete=False).count() == 2
    with pytest.raises(Exception, match="no image for c"):
        readers.merged_inputs(*frames[:2], [frames[2]]).collect()
    assert readers.merged_inputs(*frames[:2], [frames[2].where("new_key < 'c'")]).count() == 2


def test_records_of_replicas(spark):
    """Every field of a record, parallel arrays in the order picked, and empty replicas of an image without survivors."""
    samples = spark.createDataFrame([(1, 0, 1, "ow", 4, "cat", 0.5, 0.1, 0.2, 0.3, 0.4), (1, 0, 0, "gd", 2, "dog", 0.25, 0.0, 0.0, 1.0, 0.5), (1, 1, 0, "gd", 3, "cat", 0.75, 0.5, 0.5, 1.0, 1.0)], replicas.OUT)
    images = spark.createDataFrame([(1, 640, 480), (2, 100, 200)], "image_id long, width int, height int")
    got = {(r["new_key"], r["sub_sample"]): r.asDict() for r in assemble.records(samples, images, samples).collect()}
    same = {"model_type": "merged", "annotation_type": "all_boxes", "ovd_source": ["gd", "yw", "ow", "od"]}
    assert got["1", 0] == same | {"new_key": "1", "sub_sample": 0, "image_size": [640, 480], "OV_merged": ["dog", "cat"], "bboxes": [[0.0, 0.0, 1.0, 0.5], [0.1, 0.2, 0.3, 0.4]], "scores": [0.25, 0.5], "ovd_belonging": ["gd", "ow"]}
    assert sorted(got) == [("1", 0), ("1", 1), *[("2", i) for i in range(5)]]
    assert got["2", 3] == same | {"new_key": "2", "sub_sample": 3, "image_size": [100, 200], "OV_merged": [], "bboxes": [], "scores": [], "ovd_belonging": []}
    items = assemble.work_items(assemble.records(samples, images)).orderBy("new_key", "sub_sample", "box_idx").collect()
    assert [(r["label"], r["detector"], r["score"], r["x1"]) for r in items] == [("dog", "gd", 0.25, 1.0), ("cat", "ow", 0.5, 0.3), ("cat", "gd", 0.75, 1.0)]


def test_display(spark):
    rows = spark.createDataFrame([(1, 0, 1, "cat"), (1, 0, 0, "dog"), (1, 1, 0, "cat")], "image_id long, sub_sample int, pick_rank int, label string")
    assert sorted(r["display"] for r in assemble.with_display(rows, ["pick_rank"]).collect()) == ["1 | cat", "1 | dog", "2 | cat"]


def test_verdict_grid(spark):
    grid = [("err", 0.29, 0.0, "no"), ("err", 0.31, 0.1, "yes"), ("err", 0.5, 0.4, "no"), ("yes", 0.5, 0.3, "yes"), ("yes", 0.4, 0.3, "no"), ("no", 0.99, 0.0, "no")]
    df = spark.createDataFrame(grid, "a string, y double, n double, w string")
    assert all(r["w"] == r["g"] for r in df.withColumn("g", verdict.corrected(F.col("a"), F.col("y"), F.col("n"))).collect())
    assert one(spark, verdict.pair_text(F.lit(0.5), F.lit(0.25))) == "(0.5000_0.2500)"
    assert one(spark, verdict.read_answer(F.lit(" Yes, it is"))) == "yes"


def test_crops_and_tiles(spark):
    def crop(w, h):
        r = 392 / max(w, h)
        a, b = int(w * r), int(h * r)
        for bad, to in ((min(a, b) < 28, 28), (min(a, b) > 224, 224)):
            if bad:
                s = to / min(a, b)
                return max(int(a * s), to), max(int(b * s), to)
        return a, b

    sizes = [(100, 100), (1000, 20), (300, 200), (640, 480), (17, 900)]
    df = spark.createDataFrame(sizes, "w int, h int").select("w", "h", tiling.crop_size(F.col("w"), F.col("h")).alias("c"), tiling.choose_grid(F.col("w"), F.col("h")).alias("g"))
    for r in df.collect():
        assert tuple(r["c"]) == crop(r["w"], r["h"])
    assert [tuple(r["g"]) for r in df.collect()][0] == (1, 1)
    big = spark.createDataFrame([(2000, 2000)], "w int, h int").select(F.size(tiling.tiles(tiling.choose_grid(F.col("w"), F.col("h")))).alias("n")).first()["n"]
    assert big == 10


def test_instances(spark):
    df = spark.createDataFrame([(1, p, c) for p, c in enumerate("abcd")], "image_id long, pos int, v string")
    assert [r["v"] for r in instances.take(df, [2, 0, 2]).orderBy("pos").collect()] == ["c", "a", "c"]
    assert instances.cat(df, df).count() == 8
    with pytest.raises(ValueError, match="differ"):
        instances.cat(df, df.drop("v"))
    with pytest.raises(ValueError, match="exists"):
        instances.with_field(df, "v", F.lit(1), replace=False)
    arrays = spark.createDataFrame([(1, [1, 2], ["x", "y"])], "image_id long, a array<int>, b array<string>")
    assert [tuple(r) for r in instances.from_arrays(arrays, ["a", "b"]).collect()] == [(1, 0, 1, "x"), (1, 1, 2, "y")]
