"""Whole stages against literal versions, one image after the other."""

import re

import pandas as pd

from boxloom import fixtures, queries
from boxloom.functions import dialog, text
from boxloom.functions.rng import uniform_py
from boxloom.plans import stages

BLANK = " \t\n\x0b\f\r"


def said(query):
    return dialog.offline_chat(pd.Series([query]))["answer"][0]


def clean(caption):
    c = caption.lower()
    at = c.find("this is ")
    c = c[:at] + c[at + 8 :] if at >= 0 else c
    c = c[:-1] if c.endswith(".") else c
    kept = [s for s in (s.strip(BLANK) for s in c.split(". ")) if s and not any(t in s for t in text.SENTENCE_TERMS)]
    return ". ".join(kept) + "." if kept else ""


def listed(answer, header):
    body = re.sub(r"[.,\n ]+$", "", answer.replace(header, "").strip(BLANK))
    lines = [x.strip(BLANK) for x in body.split("\n")]
    return [x for x in dict.fromkeys(x[x.index(" ") + 1 :] if " " in x else x for x in lines) if x]


def attributes(items, captions=None):
    out = []
    for x in items:
        x = x.strip(BLANK).lower().replace("_", " ")
        x = x.replace(",", "") if captions else x
        if any(t in x for t in text.ATTRIBUTE_TERMS):
            continue
        if captions and any(t in x and not any(t in c for c in captions) for t in text.CONDITIONAL_TERMS):
            continue
        x = re.sub(r"\([^()]*\)", "", x).strip(BLANK) if captions else x
        if x:
            out.append(x)
    return list(dict.fromkeys(out))


def alike(a, b):
    a, b = (set(x.replace("-", " ").split(" ")) for x in (a, b))
    n = len(a & b)
    return n >= 3 or (n >= 0.65 * len(a) and n >= 0.65 * len(b))


def merged(mixed, new):
    short = [x for x in mixed if len(x.replace("-", " ").split(" ")) <= 4]
    items = list(dict.fromkeys([x for i, x in enumerate(short) if not any(alike(x, y) for y in short[i + 1 :])] + new))
    for i, x in enumerate(items):
        if x.endswith("s") and x[:-1] in items:
            items[i] = ""
    items = list(dict.fromkeys(text.HUMAN_TERMS.get(x, x) for x in items if x))
    for many, one in text.HUMAN_TERMS.items():
        if one not in items and any(p.startswith(f"{w} ") or p.endswith(f" {w}") or f" {w} " in p for p in items for w in (many, one)):
            items.append(one)
    return sorted(items, key=lambda x: (len(x), x))


def slow_captions(key, web, vlm):
    query = f"Noisy caption: {web.lower()}\nDetailed caption: {clean(vlm)}\nList every object with its attributes."
    first = attributes(listed(said(query), text.PHASE1_HEADER), (web, vlm))
    asked = f"Attributes: {', '.join(first)}\nList the plain nouns behind these attributes that are missing."
    new = attributes(listed(said(asked).replace(text.PHASE1_HEADER, ""), text.PHASE2_HEADER))
    mixed = sorted(first, key=lambda a: (uniform_py(0, key, a), a))
    return ", ".join(first), ", ".join(merged(mixed, new))


def test_captions_to_attributes_against_a_literal_version(spark, tiny):
    rows = {str(r["image_id"]): (r["web_caption"], r["vlm_caption"]) for r in fixtures.captions(spark, tiny).collect()}
    got = {r["new_key"]: (r["phase1"], r["merged"]) for r in queries.caption_stage(spark, tiny).collect()}
    assert sorted(got) == sorted(rows)
    asked = {k: v for k, v in rows.items() if None not in v and all(x.isascii() for x in v)}
    assert len(asked) > 50
    wrong = {k: (got[k], want) for k, v in asked.items() if got[k] != (want := slow_captions(k, *v))}
    assert not wrong


def test_the_offline_model_keeps_all_words():
    words = [f"word{i}xyz" for i in range(40)]
    assert said(" ".join(words)).split("\n")[1:] == [f"{i}. {w}" for i, w in enumerate(words, 1)]


def test_models_get_their_column_alone_in_batches_of_bounded_bytes(spark):
    """A model's call gets a few MB of long texts; other columns, however wide, are not sent to Python."""
    def model(x):
        return pd.DataFrame({"rows": [len(x)] * len(x), "size": [sum(map(len, x))] * len(x)})

    wide = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('word ', 40000) as query", "array(repeat('x', 300000)) as other")
    got = dialog.with_model(wide, "query", "error", model, "rows long, size long")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    rows = got.select("id", "rows", "size", "error", text.F.length(text.F.col("other")[0]).alias("n")).collect()
    assert sorted(r["id"] for r in rows) == list(range(60)) and {(r["error"], r["n"]) for r in rows} == {(None, 300000)}
    assert all(r["size"] == 200000 * r["rows"] <= dialog.BATCH_BYTES + 200000 for r in rows)


def test_models_that_skip_rows_or_fail_leave_an_error(spark):
    def skips(x):
        return pd.DataFrame({"answer": ["yes"] * (len(x) - 1)})

    got = dialog.with_model(spark.createDataFrame([("a", 1), (None, 2)], "q string, n int").coalesce(1), "q", "error", skips, "answer string").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("a", 1, None, "1 answers to 2 rows"), (None, 2, None, "1 answers to 2 rows")]


def test_the_second_phase_is_not_sent_the_captions(spark, tiny):
    """What caption_stage writes before the merge holds lists, not the texts and answers that they came from."""
    reads = queries.caption_stage(spark, tiny)._jdf.queryExecution().analyzed().toString()
    assert "Relation [new_key" in reads
    assert not [c for c in ("web_caption", "vlm_caption", "answer", "original_attributes") if c in reads]


def test_phase2_keeps_all_columns_by_default(spark):
    done = spark.createDataFrame([("k", "a caption", ["red house", "house red"])], "new_key string, web_caption string, phase1 array<string>")
    got, few = stages.phase2(done), stages.phase2(done, keep=["new_key"])
    assert got.columns == ["new_key", "web_caption", "phase1", "answer", "error", "phase2", "merged"]
    assert few.columns == ["new_key", "phase1", "phase2", "merged"] and few.first() == got.select(few.columns).first()
