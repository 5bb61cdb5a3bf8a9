"""SentencePiece encoding through a table of distinct chunks, and decoding.

In a vocabulary in which no piece has a whitespace marker after another
character, no merge can reach across the start of a marked word. A text is
therefore the run of its marked words; each distinct one is segmented once and
the ids are joined back by position with one gather for a batch.

The table belongs to a task and is emptied when it holds `TABLE` chunks: a
table for the whole corpus would need each distinct chunk of each block of
texts, with its ids, to be shuffled twice and the texts to be shuffled to meet
them, which costs more than segmenting a chunk once a task (see README).

Defined cases: a null or empty text is just the end id and decodes to the empty
text; any row gives one row, repeated ids too; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import small_batches

MARK = "▁"
#: Chunks in a task's table, at most; what is beyond it is segmented again, never dropped.
TABLE = 400_000
_RUN = re.compile(" +[^ ]*")
_LOADED: dict = {}


def _public_model() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def processor(model: str):
    """The model, loaded once in each Python worker, after a check that chunks are independent."""
    if model not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size()))):
            raise ValueError("pieces of this model cross whitespace markers; it cannot be segmented by chunks")
        _LOADED[model] = sp
    return _LOADED[model]


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, others written as spaces."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [c[1:] for c in _RUN.findall(" " + text)]
    return text.split(" ")


class ChunkTable:
    """Distinct chunks with their ids in one flat array."""

    def __init__(self, sp):
        self.sp = sp
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, new: list[str]) -> None:
        """Segment chunks that are not in the table."""
        # A marker alone cannot be asked for: the library gives an empty text no marker.
        ids = [x if c else [self.sp.piece_to_id(MARK)] for c, x in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        words = [chunks(t) for t in texts]
        if len(self.row) > TABLE:
            self.clear()
        new = set().union(*words).difference(self.row) if words else set()
        if new:
            self.add(list(new))
        at = np.fromiter((self.row[w] for ws in words for w in ws), np.int64)
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]
        ends = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(sums[ends])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=_public_model) -> DataFrame:
    """(doc_id, ids array<int>) with the end id last."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model())
        table, end = ChunkTable(sp), sp.eos_id()
        for b in batches:
            ids, counts = table.encode([t or "" for t in b.column(1).to_pylist()])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model=_public_model) -> DataFrame:
    """(doc_id, ids, text): the library's text of the ids; null ids give the empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model())
        for b in batches:
            texts = [sp.decode(ids) if ids else "" for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, ids array<int>, text string")
