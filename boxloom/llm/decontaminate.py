"""Benchmark passages in documents by Wu-Manber search over words.

Wu and Manber, "A Fast Algorithm for Multi-Pattern Searching" (1994), with words
as letters. Test strings are all windows of 10 words of the benchmark, and whole
items that are shorter. Of the strings of one length, a shift table over hashes
of blocks of two words says how far a window's end can move without passing an
occurrence. Where it says nothing, the hash of the block that ends there, and
that of the block that begins the window, choose a bucket of test strings, and
the words themselves are compared. A clash of hashes can only shorten a shift or
cost a comparison.

The texts of a batch are one row of words, with a word between them that no test
string holds; stretches of it are searched side by side.

Test strings go to the tasks as a broadcast of `SHARD_CHARS` characters of items
at most; a larger benchmark is cut into shards by a hash of its rows and each is
searched for in turn, and what they find is united by document.

Defined cases: a null or empty text has no words and is clean; an item without
words has no window; an item without id hits, but is not listed; rows of items
with one id are one item; every document row gives one row, repeated ids too; an
empty benchmark leaves all clean; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, small_batches

WINDOW = 10
#: Characters of benchmark items in one broadcast, about; also what an item longer than that takes.
SHARD_CHARS = 4_000_000
#: Words that one cursor searches; entries of a shift table.
STRETCH = 2048
TABLE_BITS = 20
BETWEEN = b"\0"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_HIT = "array<struct<start:bigint,end:bigint>>"


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, joined by one space."""
    return b" ".join((text or "").encode().translate(_LETTERS).split())


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_SLICE = 1 << 20
_UP, _DOWN = _powers(_BASE, _SLICE), _powers(pow(_BASE, -1, 1 << 64), _SLICE)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word buf[start:end] by differences of prefix sums; words over a mebibyte count by their first."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        part = buf[starts[i] : min(ends[j - 1], starts[i] + _SLICE)].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        at, to = starts[i:j] - starts[i], np.minimum(ends[i:j] - starts[i], len(part))
        h = (sums[to] - sums[at]) * _DOWN[at]
        out[i:j] = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
        i = j
    return out


def _words(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a line of words joined by single spaces."""
    buf = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    return word_hashes(buf, starts, ends), starts, ends


def _block(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of `size` words that end at the given words."""
    return h[end] if size == 1 else (h[end - 1] ^ (h[end - 1] >> np.uint64(31))) * np.uint64(_BASE) + h[end]


class Strings:
    """Test strings of one length: shift table and buckets."""

    def __init__(self, length: int, items_of: dict[bytes, set]):
        self.length, self.block = length, min(2, length)
        self.items = list(items_of.values())
        h = np.array([_words(s)[0] for s in items_of]).reshape(-1, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        flat = h.reshape(-1)
        first = np.arange(len(h)) * length
        for end in range(self.block - 1, length):  # the later a block ends in a string, the shorter the way
            self.shift[self._slot(_block(flat, first + end, self.block))] = length - 1 - end
        self.bucket: dict[int, dict[bytes, int]] = {}
        for i, (key, s) in enumerate(zip(self._key(flat, first + length - 1).tolist(), items_of, strict=True)):
            self.bucket.setdefault(key, {})[s] = i
        self.keys = np.sort(np.fromiter(self.bucket, np.uint64, len(self.bucket)))

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return block * np.uint64(_MIX) >> np.uint64(64 - TABLE_BITS)

    def _key(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of windows by their ends: the last block and the first one."""
        head = _block(h, end - self.length + self.block, self.block)
        return _block(h, end, self.block) * np.uint64(_MIX) ^ (head >> np.uint64(7))

    def search(self, line: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of the window's last word, number of the string) of every occurrence."""
        at = np.arange(0, len(h), STRETCH)
        stop = np.minimum(at + STRETCH, len(h))
        at = np.maximum(at, self.length - 1)
        seen = []
        while True:
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
            if not at.size:
                break
            step = self.shift[self._slot(_block(h, at, self.block))]
            seen.append(at[step == 0])
            at = at + np.maximum(step, 1)
        end = np.concatenate([np.zeros(0, np.int64), *seen])
        key = self._key(h, end)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        held = self.keys[place] == key
        for e, k in zip(end[held].tolist(), key[held].tolist(), strict=True):
            found = self.bucket[k].get(line[starts[e - self.length + 1] : ends[e]])
            if found is not None:
                yield e, found


def tables(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> list[Strings]:
    """Tables of all test strings of (id, text) items, one for each length."""
    by_length: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        words = normal(text).split()
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(b" ".join(words[i : i + n]), set()).add(item)
    return [Strings(n, of) for n, of in sorted(by_length.items())]


def search_texts(texts: list[str | None], strings: list[Strings]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the stretches of hit words and the items hit."""
    line = b" ".join([BETWEEN, *(x for t in texts for x in (normal(t), BETWEEN) if x)])
    h, starts, ends = _words(line)
    walls = np.flatnonzero(np.frombuffer(line, np.uint8)[starts] == 0)
    cover = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set] = {}
    for s in strings:
        hits: dict[int, set[int]] = {}
        for e, found in s.search(line, h, starts, ends):
            cover[e - s.length + 1] += 1
            cover[e + 1] -= 1
            hits.setdefault(int(np.searchsorted(walls, e)) - 1, set()).add(found)
        for d, which in hits.items():
            items.setdefault(d, set()).update(*(s.items[i] for i in which))
    edges = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8))) + 1
    begin, stop = edges[::2], edges[1::2]
    own = np.searchsorted(begin, walls)
    out = []
    for d in range(len(texts)):
        first = walls[d] + 1
        part = slice(own[d], own[d + 1])
        out.append((int(walls[d + 1] - first), list(zip((begin[part] - first).tolist(), (stop[part] - first).tolist(), strict=True)), [i for i in items.get(d, ()) if i is not None]))
    return out


_TABLES: dict = {}


def _scan(docs: DataFrame, key: str, text_col: str, items: list[tuple], window: int) -> DataFrame:
    """One shard of the benchmark, in all documents."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLES:  # one shard at a time in a worker
            _TABLES.clear()
            _TABLES[name] = tables(sent.value, window)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = search_texts(b.column(1).to_pylist(), _TABLES[name])
            cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in f[1]] for f in found], span), pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "n_words", "hits", "items"])

    return docs.select(key, text_col).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words bigint, hits {_HIT}, items array<string>")


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, hits array<struct<start, end>>, items array<string>): stretches of words inside test strings, and the items they are from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    of = F.pmod(F.xxhash64("item", "text"), F.lit(shards))
    if shards == 1:
        return _scan(docs, id_col, text_col, [tuple(r) for r in known.collect()], window).withColumnRenamed(id_col, "doc_id")
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "decontaminate")
    parts = None
    for k in range(shards):
        part = _scan(rows, "rid", "text", [tuple(r) for r in known.where(of == k).collect()], window)
        parts = part if parts is None else parts.unionByName(part)
    every = parts.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    whole = every.join(_united(parts.select("rid", F.explode("hits").alias("x")).select("rid", "x.start", "x.end")), "rid", "left")
    return rows.select("rid", "doc_id").join(whole, "rid").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(_HIT)).alias("hits"), "items")


def _united(spans: DataFrame) -> DataFrame:
    """(rid, hits): spans (rid, start, end) with those that touch or overlap as one; a span is a new one if it starts behind all ends before it."""
    order = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    ones = fresh.withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ones.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
