"""Concatenate-and-cut packing.

Pass one tokenises each partition and keeps, beside each document's ids, the
tokens before it in its partition. A prefix sum over the partitions' totals
gives every partition its global base; base plus local start is a document's
place in one endless stream. Pass two cuts the stream every `window` tokens.
Only the last sequence can be short. Pieces of a window that reaches across a
partition's border are marked, and only those need another partition's rows.

Defined cases: a null or empty text is just the end id; rows with a null id or
a repeated id are packed like any other; an empty table gives no pieces; other
columns are ignored. Pass one is written, so that a lost executor cannot make
pass two see another order than the prefix sums did.
"""

from __future__ import annotations

import array
import base64
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, small_batches

#: Largest number of partition totals (16 bytes each) that is broadcast; beyond it they are joined.
MAX_BROADCAST_PARTS = 500_000
_ENCODERS: dict = {}


def byte_bpe(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    """A byte-level BPE encoder, made once in each Python worker.

    The ranks are the same vocabulary as the tokenizers JSON file; the tests
    hold its ids against that library. It is about three times as fast.
    """
    key = (ranks_path, pattern, specials)
    if key not in _ENCODERS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
        _ENCODERS[key] = lambda text: encoding.encode(text, allowed_special="all")
    return _ENCODERS[key]


def _public_encoder():
    import public_tokenizers as public

    return byte_bpe(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, (("<|endoftext|>", 50256),))


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, encoder=_public_encoder) -> DataFrame:
    """Pass one: (doc_id, ids as little-endian uint32 binary, n, part, local start), written."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(), TaskContext.get().partitionId(), 0
        for b in batches:
            blobs, counts, starts = [], [], []
            for text in b.column(1).to_pylist():
                ids = array.array("I", encode(text or ""))
                ids.append(end_id)
                if sys.byteorder == "big":
                    ids.byteswap()
                blobs.append(ids.tobytes())
                counts.append(len(ids))
                starts.append(at)
                at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(blobs, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(counts), pa.int64()), pa.array(starts, pa.int64())],
                names=["doc_id", "ids", "n", "part", "local"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, n bigint, part bigint, local bigint"), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Add each document's place in the stream (`at`) and its partition's base and end."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    bases = materialise(totals.withColumn("base", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"), "total"), "bases")
    if bases.count() <= MAX_BROADCAST_PARTS:
        bases = F.broadcast(bases)
    return tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("local"))


def pack(docs: DataFrame, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, encoder=_public_encoder) -> DataFrame:
    """Pass two: one row per piece with its ids, place and boundary mark."""
    w = F.lit(window)
    whole = placed(tokenise(docs, id_col, text_col, end_id, encoder))
    first, last = F.floor(F.col("at") / w), F.floor((F.col("at") + F.col("n") - 1) / w)
    pieces = whole.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin: Column = F.greatest(F.col("at"), F.col("sequence_id") * w)
    end: Column = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * w)
    cut = pieces.select(
        "doc_id",
        (begin - F.col("at")).alias("start"),
        (end - begin).alias("length"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * w).alias("offset"),
        ((F.col("sequence_id") * w < F.col("base")) | ((F.col("sequence_id") + 1) * w > F.col("base") + F.col("total"))).alias("boundary"),
        "ids",
    )
    return cut.withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: (sequence_id, length, ids). A window has at most `window` pieces."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("length"), F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
