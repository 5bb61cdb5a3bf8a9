"""Line dedup by pairwise alignment.

A text is cut after each newline and each sentence end; the pieces, joined,
are the text again. Pieces are normalised and hashed. Documents are paired
through runs of adjacent pieces: from each piece on, and up to each piece, the
shortest run with at least `min_words` words is hashed, and every document that
has a run is paired with an earlier one that has it (the first of its batch,
and that with the first of all), so that n holders give n - 1 pairs and no run
is too frequent to be looked at. Each piece of a block that two documents share
lies in such a run inside the block, so whatever any earlier document gives
reason to delete goes. The regions of a pair around shared runs are aligned by
patience diff (unique common hashes, longest increasing run, then the gaps),
and blocks of adjacent aligned pieces with at least `min_words` words are
deleted from the later document. An alignment keeps the order and uses a piece once; blocks
of the first document that stand elsewhere or again in the later one are found
by an exact pass that follows. The first holder of a piece never loses it.

Defined cases: null and empty texts stay as they are; documents are ordered by
(id, row), null ids first; repeated rows are copies, the later one loses its
blocks; an empty table gives an empty result; input columns of any name stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, small_batches

#: Splits after newlines, and after sentence ends before a space; a Java expression.
CUT = r"(?<=\n)|(?<=[.!?])(?=\x20)"
#: Pieces of a document that are aligned at once, runs at their ends aside.
REGION = 512
_SALTS = 64
#: An odd number, so that powers of it can be divided by modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal items, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 == cb.get(x)}
        pairs = [(where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(pairs):
            at = bisect_left(tails, i)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [i], [k]
        run, k = [], ends[-1] if ends else -1
        while k >= 0:
            run.append(pairs[k])
            k = back[k]
        if not run:
            continue
        out += run
        edges = [(a0 - 1, b0 - 1), *reversed(run), (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def repeats(a: list[int], b: list[int], words: list[int], min_words: int) -> set[int]:
    """Positions in b of all runs with at least min_words words that a holds anywhere, in any order and as often as they come.

    Linear: the longest run of a that ends at each position of b, by a suffix
    automaton over the pieces of a that b has too.
    """
    shared = set(a) & set(b)
    # Pieces of a that b lacks only part runs; neighbours of them count as one.
    kept = [x if x in shared else None for x in a]
    follow: list[dict] = [{}]
    shorter, size, last = [-1], [0], 0
    for x in [x for i, x in enumerate(kept) if x is not None or i and kept[i - 1] is not None]:
        new = len(follow)
        follow.append({})
        size.append(size[last] + 1)
        shorter.append(0)
        at, last = last, new
        while at >= 0 and x not in follow[at]:
            follow[at][x] = new
            at = shorter[at]
        if at < 0:
            continue
        to = follow[at][x]
        if size[to] > size[at] + 1:
            follow.append(dict(follow[to]))
            size.append(size[at] + 1)
            shorter.append(shorter[to])
            twin = len(follow) - 1
            while at >= 0 and follow[at].get(x) == to:
                follow[at][x] = twin
                at = shorter[at]
            shorter[to] = to = twin
        shorter[new] = to
    before = [0, *accumulate(words)]
    marks = [0] * (len(b) + 1)
    at = run = 0
    for j, x in enumerate(b):
        while at and x not in follow[at]:
            at = shorter[at]
            run = size[at]
        at, run = (follow[at][x], run + 1) if x in follow[at] else (0, 0)
        if run and before[j + 1] - before[j + 1 - run] >= min_words:
            marks[j + 1 - run] += 1
            marks[j + 1] -= 1
    return {j for j, depth in enumerate(accumulate(marks)) if depth}


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Positions in b of aligned blocks with at least min_words words, and of blocks of a that no alignment can hold."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    # An alignment is in order and uses each piece once: blocks that moved, or come again, are left. They are looked for
    # only where a run of shared pieces is long enough and some of it is still there.
    held, gone = set(a), set(out)
    size, left = 0, False
    for j, x in enumerate(b):
        size, left = (size + words[j], left or j not in gone) if x in held else (0, False)
        if left and size >= min_words:
            return sorted(gone | repeats(a, b, words, min_words))
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, doc (struct of all columns), hashes and word counts of the pieces; written."""
    pieces = F.split(F.col(text_col), CUT, -1)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), pieces.alias("p"))
    laid = named.withColumn("p", F.expr("transform(p, x -> lower(trim(regexp_replace(x, '\\\\s+', ' '))))"))
    laid = laid.select("doc", "id", F.expr("transform(p, x -> xxhash64(x))").alias("hashes"), F.expr("transform(p, x -> if(x = '', 0, size(split(x, ' '))))").alias("words"))
    return materialise(laid.withColumn("rid", F.monotonically_increasing_id()), "units")


def run_keys(hashes: np.ndarray, words: np.ndarray, ends: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, start, end) of the shortest runs with at least min_words words that start, or end, at each piece; documents laid end to end."""
    n, least = len(hashes), max(min_words, 1)
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    # From each piece to the first end that is far enough, and to each end from the last start that is.
    stop = np.searchsorted(before, before[:-1] + least)
    start = np.searchsorted(before, before[1:] - least, side="right") - 1
    on = np.flatnonzero(stop <= ends[owner])
    up = np.flatnonzero((start >= 0) & (owner[start] == owner))
    up = up[stop[start[up]] != up + 1]
    i, k = np.concatenate([on, start[up]]), np.concatenate([stop[on], up + 1])
    # A run's hash is a polynomial in _BASE: a difference of prefix sums, divided by the power of its start.
    power = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * power(_BASE)[:-1])])
    keys = (sums[k] - sums[i]) * power(pow(_BASE, -1, 1 << 64))[i] + (k - i).astype(np.uint64)
    from_ = np.concatenate([[0], ends])[owner[i]]
    return owner[i], keys.view(np.int64), i - from_, k - from_


def met_before(owner: np.ndarray, keys: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each run the row of the first holder of its key, by the documents' rank, or -1 where the run's own document is the first."""
    order = np.lexsort((start, rank[owner], keys))
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    first = np.empty(len(keys), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.where(owner[first] == owner, -1, first)


def pairs(rows: DataFrame, min_words: int = 20) -> DataFrame:
    """(first, later, a0, a1, b0, b1): regions of two documents that hold shared runs of at least min_words words; written.

    The holders of a run in one batch meet its first one there; only that one
    looks for its own first holder among those of all batches. A region is at
    most REGION pieces and a run long on either side, so that neither a long
    document nor one with a frequent passage is sent whole to all it meets.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            # Null texts have null lists; flatten leaves them out as empty ones.
            hashes, words = (x.column(i).flatten().to_numpy() for i in (2, 3))
            if not len(hashes):
                continue
            ends = np.cumsum(np.array([n or 0 for n in x.column(2).value_lengths().to_pylist()], np.int64))
            doc, keys, start, end = run_keys(hashes, words, ends, min_words)
            if not len(keys):
                continue
            rank = np.empty(x.num_rows, np.int64)
            order = pc.sort_indices(x.select([0, 1]), sort_keys=[("id", "ascending"), ("rid", "ascending")], null_placement="at_start")
            rank[order.to_numpy()] = np.arange(x.num_rows)
            first = met_before(doc, keys, start, rank)
            rid = x.column(1).to_numpy()[doc]
            none = first < 0
            of = lambda v, kind: pa.array(v[first], kind, mask=none)  # noqa: E731, B023
            own = [x.column(0).take(pa.array(doc)), pa.array(rid), pa.array(keys), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, of(rid, pa.int64()), of(start, pa.int32()), of(end, pa.int32())], names=["id", "rid", "h", "s", "e", "f", "fs", "fe"])

    held = rows.select("id", "rid", "hashes", "words").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, rid bigint, h bigint, s int, e int, f bigint, fs int, fe int")
    # Runs that have met their first holder are spread, so that a frequent run is no large group.
    salt = F.when(F.col("f").isNull(), 0).otherwise(1 + F.pmod(F.col("rid"), F.lit(_SALTS)))
    first = F.first(F.struct("rid", "s", "e")).over(Window.partitionBy("h", salt).orderBy("id", "rid", "s"))
    met = held.withColumn("w", F.when(F.col("f").isNull(), first).otherwise(F.struct(F.col("f").alias("rid"), F.col("fs").alias("s"), F.col("fe").alias("e")))).where("w.rid <> rid")
    met = met.select(F.col("w.rid").alias("first"), F.col("rid").alias("later"), "s", "e", F.col("w.s").alias("fs"), F.col("w.e").alias("fe"))
    regions = met.groupBy("first", "later", F.expr(f"fs div {REGION}").alias("i"), F.expr(f"s div {REGION}").alias("j"))
    return materialise(regions.agg(F.min("fs").alias("a0"), F.max("fe").alias("a1"), F.min("s").alias("b0"), F.max("e").alias("b1")).drop("i", "j"), "pairs")


def removals(rows: DataFrame, min_words: int = 20) -> DataFrame:
    """(rid, gone): positions of the pieces to delete from each later document."""
    small_batches(rows.sparkSession)
    a = rows.select(F.col("rid").alias("first"), F.col("hashes").alias("a"))
    b = rows.select(F.col("rid").alias("later"), F.col("hashes").alias("b"), "words")
    cut = lambda c, s, e: F.slice(c, F.col(s) + 1, F.col(e) - F.col(s)).alias(c)
    met = pairs(rows, min_words).join(b, "later").select("first", "later", "a0", "a1", "b0", cut("b", "b0", "b1"), cut("words", "b0", "b1"))
    met = met.join(a, "first").select("later", "b0", cut("a", "a0", "a1"), "b", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            gone = [[at + i for i in common_blocks(a, b, w, min_words)] for at, a, b, w in zip(*(x.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["rid", "gone"])

    found = met.mapInArrow(run, "rid bigint, gone array<int>").where("size(gone) > 0")
    return found.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (struct of all columns), n_pieces, n_removed, removed_words and the text that stays."""
    rows = units(docs, id_col, text_col)
    out = rows.drop("hashes").withColumn("n_pieces", F.coalesce(F.size("words"), F.lit(0))).join(removals(rows, min_words), "rid", "left")
    words = F.expr("aggregate(gone, 0L, (s, i) -> s + words[i])")
    stay = F.expr(f"transform(array(split(doc.`{text_col}`, '{CUT.replace(chr(92), chr(92) * 2)}', -1)), p -> array_join(transform(array_except(sequence(0, size(p) - 1), gone), i -> p[i]), ''))[0]")
    keep = F.col("gone").isNull()
    return out.select(
        "doc",
        F.greatest("n_pieces", F.lit(0)).cast("long").alias("n_pieces"),
        F.when(keep, 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(keep, 0).otherwise(words).cast("long").alias("removed_words"),
        F.when(keep, F.col(f"doc.`{text_col}`")).otherwise(stay).alias("text"),
    )


def apply_dedup(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """docs with the blocks deleted; a document of which nothing but white space stays goes, its words are all in earlier ones."""
    done = dedup_lines(docs, min_words).where("n_removed = 0 or text rlike '\\\\S'")
    return done.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
