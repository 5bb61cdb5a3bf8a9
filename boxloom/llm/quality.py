"""Quality rules: word and repetition figures, and cross-document line frequency.

Lines are normalised (trimmed, lower-cased, white space drawn together) and
hashed. For each host the documents that have a line are counted, and lines in
more than `max_docs` of them are removed; a document of which less than
`min_left` of its words stay is rejected as depleted. Copies of one page are
not boilerplate, they are left to the near-duplicate stage: documents whose
normalised lines are all the same, in the same order, count once.

Defined cases: a null or empty text has no words and is rejected by the base
rules; a null host is a host; repeated rows give one row each and, being
copies, count once; an empty table gives an empty result; input columns of any
name are kept in one struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = " \t\n\v\f\r"
#: Frequent lines are laid out so many times to meet the rows of hot ones.
_SALTS = 16


def repeated_words(words: list[str], size: int = 8) -> int:
    """Words covered by windows of `size` words that occur more than once; exact, by doubling ranks."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[str, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    step = 1
    while step < size:
        rank = np.unique(rank[: len(rank) - step] * (n + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    marks = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(hash, words) of each line], hash of all normalised lines."""
    import xxhash

    text = text or ""
    words = _WORDS.findall(text)
    lines = text.split("\n")
    seen: set[str] = set()
    repeats = 0
    sizes = [0] * len(lines)
    keys = [0] * len(lines)
    whole = xxhash.xxh64(seed=42)
    for i, line in enumerate(lines):
        if not line.strip(_BLANKS):
            continue
        repeats += line in seen
        seen.add(line)
        parts = line.lower().split()
        sizes[i] = len(_WORDS.findall(line))
        norm = " ".join(parts).encode("utf-8", "surrogatepass")
        keys[i] = xxhash.xxh64_intdigest(norm, 42)
        whole.update(norm + b"\n")
    wrap = lambda h: h - (1 << 64) if h >> 63 else h
    laid = [{"h": wrap(k), "w": s} if s else {"h": 0, "w": 0} for k, s in zip(keys, sizes, strict=True)]
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), repeats, repeated_words(words), laid, wrap(whole.intdigest())


def _source(docs: DataFrame, text_col: str):
    """docs as (doc, text, host), the function that measures them and its schema."""
    lines = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(measure, b.column(1).to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], lines), pa.array(cols[6], pa.int64())], names=["doc", "host", *names, "lines", "whole"])

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("_none")]).alias("doc"), F.col(text_col).alias("text"), _host(docs))
    schema = f"doc {source.schema['doc'].dataType.simpleString()}, host string, " + ", ".join(f"{n} bigint" for n in names) + ", lines array<struct<h:bigint,w:int>>, whole bigint"
    return source, run, schema


def _host(docs: DataFrame):
    return (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("host")


def judge(docs: DataFrame, max_docs: int = 50, min_left: float = 0.2, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of docs: rid, doc (struct of the other columns), the figures, base_failed, kept, removed_words.

    With keep_text also `text` as it was and `clean`, without the lines above the limit.
    """
    small_batches(docs.sparkSession)
    source, run, schema = _source(docs, text_col)
    if keep_text:
        source = source.select(F.struct("doc", "text").alias("doc"), "text", "host")
        schema = schema.replace(schema.split(", host string")[0], f"doc {source.schema['doc'].dataType.simpleString()}", 1)
    rows = materialise(source.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "figures")
    lines = rows.select("rid", "host", "whole", F.posexplode("lines").alias("pos", "l")).where("l.w > 0").select("rid", "host", "whole", "pos", "l.h", "l.w")
    common = lines.groupBy("host", "h", "whole").agg(F.lit(1).alias("one")).groupBy("host", "h").count().where(F.col("count") > max_docs)
    common = materialise(common.select("host", "h"), "common").withColumn("s", F.explode(F.array(*map(F.lit, range(_SALTS))))).alias("c")
    salted = lines.drop("whole").withColumn("s", F.pmod(F.xxhash64("rid"), F.lit(_SALTS)).cast("int")).alias("x")
    hit = salted.join(common, F.expr("x.h = c.h and x.s = c.s and x.host <=> c.host"), "left_semi")
    gone = hit.groupBy("rid").agg(F.sum("w").alias("removed_words"), F.collect_list("pos").alias("gone"))
    out = rows.drop("lines", "host", "whole").join(gone, "rid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ((F.col("n_words") - F.col("removed_words")) >= F.lit(min_left) * F.col("n_words")))
    if keep_text:
        clean = F.expr("transform(array(split(doc.text, '\\n', -1)), p -> array_join(transform(array_except(sequence(0, size(p) - 1), gone), i -> p[i]), '\\n'))[0]")
        out = out.select("*", F.col("doc.text").alias("text"), F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(clean).alias("clean")).withColumn("doc", F.col("doc.doc"))
    return out.drop("gone")


def apply_rules(docs: DataFrame, **params) -> DataFrame:
    """docs without rejected rows and without removed lines; its columns as they were."""
    judged = judge(docs, keep_text=True, **params).where("kept")
    return judged.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
