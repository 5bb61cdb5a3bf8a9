"""Token offsets against the tokenizer, tiles of pixels against a literal version."""

import hashlib
import re

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pyarrow.parquet as pq
import tokenizers
from pyspark.sql import functions as F

from boxloom import fixtures, queries
from boxloom.functions import images, tiling, tokens

ODD = [None, "", "  ", "One. Two! three", "é ñ. " * 60, "no end " * 90, "A b.  C d? " * 40 + " ", "x" * 900 + ".", "Ünïcode ☃. 𝒳𝒴. " * 30]


def slow_caption(tok, text, limit=77):
    """The longest run of whole sentences whose own tokens fit, tried one by one."""
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    words = list(re.finditer(r"\s*\S+", text))
    ends = [m.end() for m in words if m[0][-1] in ".!?" or m is words[-1]]
    return count(text), max([e for e in ends if count(text[:e]) <= limit - 2], default=0)


def test_captions_against_the_tokenizer(spark, tiny):
    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = {r["image_id"]: r for r in queries.caption_tokens(spark, tiny).collect()}
    texts = {r["image_id"]: r["vlm_caption"] for r in fixtures.captions(spark, tiny).collect()}
    assert {k: (r["n_tokens"], r["n_sentences"]) for k, r in got.items() if texts[k] is not None} == {k: slow_caption(tok, t) for k, t in texts.items() if t is not None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string").withColumn("e", tokens.token_ends("t", public.path("word_bpe_49k.json")))
    rows = df.select("i", F.size("e").alias("n"), tokens.last_sentence(F.col("t"), F.col("e")).alias("s"), tokens.seen(F.col("t"), F.col("e")).alias("seen")).orderBy("i").collect()
    for r, t in zip(rows, ODD, strict=True):
        if t is not None:
            assert (r["n"], r["s"]) == slow_caption(tok, t)
            covered = len(tok.encode(t[: r["seen"]], add_special_tokens=False).ids)
            assert covered == r["n"] if r["n"] <= 75 else 75 - 3 <= covered <= 75  # a character may be four tokens
    assert rows[0]["s"] is None


def cubic(x, a=-0.5):
    x = abs(x)
    return (a + 2) * x**3 - (a + 3) * x**2 + 1 if x < 1 else a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0.0


def slow_line(line, m):
    """One output pixel after the other."""
    n, out = len(line), []
    if n == m:
        return list(line)
    for k in range(m):
        w = [cubic(((k + 0.5) * n / m - i - 0.5) / max(n / m, 1)) for i in range(n)]
        v = sum(a * b for a, b in zip(w, line, strict=True)) / sum(w)
        out.append(min(max(int(np.rint(round(v, 6))), 0), 255))
    return out


def slow_resize(rgb, w, h):
    wide = np.array([[slow_line(row[:, c].tolist(), w) for c in range(3)] for row in rgb]).transpose(0, 2, 1)
    return np.array([[slow_line(wide[:, x, c].tolist(), h) for c in range(3)] for x in range(w)]).transpose(2, 0, 1).astype(np.uint8)


def test_tiles_against_loops(spark, tiny):
    """All tiles of every eighth picture, and that every picture has those of its grid."""
    got = {}
    for r in queries.tile_pixels(spark, tiny).collect():
        got.setdefault(r["vec_id"], {})[r["n"]] = r["sha256"]
    pics = fixtures.rgb_pictures(spark, tiny).withColumn("g", tiling.choose_grid(F.col("width"), F.col("height"), 9, 5)).collect()
    assert len(pics) == pq.read_table(f"{tiny}/embeddings.parquet").num_rows == len(got)
    for p in pics:
        i, j = p["g"]
        assert sorted(got[p["vec_id"]]) == list(range(i * j + (i * j > 1)))
    for p in pics[::8]:
        (i, j), rgb = p["g"], np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"], 3)
        big = slow_resize(rgb, i * 5, j * 5)
        cut = [big[y * 5 : y * 5 + 5, x * 5 : x * 5 + 5] for y in range(j) for x in range(i)] + [slow_resize(rgb, 5, 5)] * (i * j > 1)
        assert got[p["vec_id"]] == {n: hashlib.sha256(np.ascontiguousarray(c).tobytes()).hexdigest() for n, c in enumerate(cut)}
    assert images.tile_pixels(spark.createDataFrame([(1, None, 3, 7)], "k long, pixels binary, width int, height int"), "k").isEmpty()


def test_kernels_keep_flat_pictures_and_sum_to_one():
    for kernel in images.KERNELS:
        for n, m in ((3, 7), (7, 3), (5, 5), (1, 4)):
            assert np.allclose(images.weights(n, m, kernel).sum(axis=1), 1)
        assert (images.resize(np.full((4, 6, 3), 99, np.uint8), 5, 9, kernel) == 99).all()


def test_texts_are_tokenized_in_bounded_slices():
    texts = [None, "", "a" * 30, "b" * 250, None, "c" * 60, "d" * 50]
    got = list(tokens._slices(pa.array(texts), 100))
    assert [x for part in got for x in part] == [t or "" for t in texts]
    assert all(len(part) == 1 or sum(map(len, part)) <= 100 for part in got) and not list(tokens._slices(pa.array([], pa.string())))
