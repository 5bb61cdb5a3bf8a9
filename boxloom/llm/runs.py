"""Periodic runs of words: heavy/light counting of lags, then island scans.

A lag is worth a scan only if enough words equal the word that far ahead. The
equal pairs of all lags are counted at once, exactly: words that are frequent in
their text by the autocorrelation of their indicators (FFT; one power spectrum
sums them), rare ones by the differences of their places. Matches inside runs of
a divisor are known already and are taken off, so a text of one word needs one
scan. A lag that still has as many matches as the shortest run needs is scanned
for islands of matches.

Why that is exact: inside a run of period p, a multiple q of p has length - q
matches. No match of a run with smallest period q lies there, as an overlap of q
words would give it the period p, and two runs whose periods divide q share
fewer than q words.

Defined cases: a null or empty text has no words, no runs and an empty collapsed
text; every row gives one row, repeated ids too; other columns are ignored. A
text is handled whole in one task, in memory of some 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: A run has at least this many words, and at least so many times its period.
LEAST, TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
RUN = "start bigint, length bigint, period bigint"


def _light_gaps(order: np.ndarray, kind: np.ndarray, light: np.ndarray, most: int) -> np.ndarray:
    """How many pairs of one rare word lie 0..most words apart; order: places by word, then place."""
    counts = np.zeros(most + 1, np.int64)
    at, k = np.flatnonzero(light[:-1]), 0
    while at.size:
        k += 1
        at = at[at + k < len(order)]
        at = at[kind[at + k] == kind[at]]
        gap = order[at + k] - order[at]
        near = gap <= most
        at, gap = at[near], gap[near]
        if gap.size:
            found = np.bincount(gap)
            counts[: len(found)] += found
    return counts


def _heavy_gaps(ids: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """The same for frequent words, by autocorrelation."""
    size = 1 << int(len(ids) + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for w in heavy:
        wave = np.fft.rfft(ids == w, size)
        power += wave.real**2 + wave.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag 0..most, at how many places the word that far ahead is the same (lag 0 is left open)."""
    order = np.argsort(ids, kind="stable")
    kind, often = ids[order], np.bincount(ids)
    heavy = often * often > 4 * len(ids)  # so many pairs that a transform is cheaper
    counts = _light_gaps(order, kind, ~heavy[kind], most)
    return counts + _heavy_gaps(ids, np.flatnonzero(heavy), most) if heavy.any() else counts


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period."""
    n = len(ids)
    most = n // times if n >= least else 0
    if not most:
        return []
    lags = np.arange(most + 1)
    needed = np.maximum(least - lags, (times - 1) * lags)
    counts, known = lag_counts(ids, most), np.zeros(most + 1, np.int64)
    found: dict[tuple[int, int], int] = {}
    counts[0] = 0
    for q in np.flatnonzero(counts >= needed).tolist():
        if counts[q] - known[q] < needed[q]:
            continue
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = ids[q:] == ids[:-q]
        edges = np.flatnonzero(np.diff(same))
        begin, size = edges[::2], edges[1::2] - edges[::2]
        for k in np.flatnonzero(size >= needed[q]).tolist():
            run = int(begin[k]), int(size[k]) + q
            if run not in found:  # else it has a smaller period
                found[run] = q
                multiples = np.arange(2 * q, min(run[1], most + 1), q)
                known[multiples] += run[1] - multiples
    return sorted((s, length, q) for (s, length), q in found.items())


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run has after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): all runs, and the text without their repeats."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            sizes, ends, flat, left = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = (text or "").encode().split()  # bytes split at ASCII white space only
                number: dict[bytes, int] = {}
                got = find_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least, times)
                sizes.append(len(words))
                flat += got
                ends.append(len(flat))
                left.append(b" ".join(_collapse(words, got)).decode())
            cols = np.array(flat, np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(3)], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), runs, pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the first, then that of the smallest period."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def run_list(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """Documents with the repeats of op11's contract: in every tenth by crc32 of the id, words from place a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.transform(F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"))), lambda w: F.when(F.size(w) > 0, repeat(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, words[0]).otherwise(F.col("text")).alias("text"))
