"""Alignment of two tokenizers' tokens, by running sums of their lengths.

Tokens of a text lie end to end in its bytes. On each side a running sum of their
lengths gives their ends, and both sides are brought together on the end. An end
that both have is a cut; a running count of cuts numbers the groups. Two tokens
overlap if one of them is the first to end at or after the other's end, so every
distinct end is one link: between the first token of either side that ends there
or later, which a running count finds. No pairs within a group are formed.

Neither tokenizer joins characters across a space that follows a character other
than white space, so texts are cut there, for both sides at once, and both sides
end there: a text's groups and links are those of its pieces, in order. A task
segments and aligns a distinct piece once (at most `TABLE` of them or `TABLE_BYTES`, then anew), all
new pieces of a text together as arrays. As rows of Spark, token by token, the
same sums and counts took four times the CPU seconds allowed (see README).

Texts are dealt out once, by a row number, and become tokens only then, as these
take several times as much. How many parts there are follows the bytes of the
texts. A text hands on each id pair it links once, with the number of its links;
counts over all documents are a grouping, and go back to them by a join.

Defined cases: a document has no tokens, and zeros, if its text is null or empty
or if either side's tokens do not spell a space and the text (as with U+2581);
every row gives one row and repeated ids are documents of their own; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import byte_bpe
from .pieces import MARK, processor
from .store import materialise, small_batches

#: Counts of id pairs that are broadcast, at most (16 bytes each); beyond it they are joined by a shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: An id pair as one number.
PAIR = 1 << 20
#: Bytes of text in a part, about: some 1.5 million tokens, a second or two.
PART_BYTES = 2 << 20
#: Pieces in a task's table, at most (some 400 bytes each); what is beyond it is segmented again, never dropped.
TABLE = 400_000
#: Bytes of pieces in a task's table, at most, as texts without spaces are one piece.
TABLE_BYTES = 16 << 20
#: Ids are below this.
IDS = 1 << 16
#: A link as one number: its id pair below this, and above it 1 if its a token ends there, 2 if its b token does, 3 if both do: a cut.
FLAGS = 1 << 40
#: What follows a token in the text of the groups: another of its side, the other side, another group, another piece.
_AFTER = (",", "|", ";", "\n")
#: Groups as lists.
GROUPS = "array<struct<a array<int>, b array<int>>>"
_EDGE = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")

#: A tokenizer: segments pieces that each begin with a space, and the bytes of every id.
Side = tuple[Callable[[list[str]], list[list[int]]], list[bytes]]


@cache
def byte_side() -> Side:
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        spelled = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    encode = byte_bpe(path, public.PATTERN, ())
    return lambda pieces: [encode(p) for p in pieces], [spelled.get(i, b"") for i in range(max(spelled) + 1)]


@cache
def piece_side() -> Side:
    import public_tokenizers as public

    sp = processor(public.path("piece_bpe_32k.model"))
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))]
    # The library puts a marker before a text, but not before an empty one.
    return lambda pieces: [sp.encode(p[1:]) if p != " " else [sp.piece_to_id(MARK)] for p in pieces], spelled


def pieces_of(text: str) -> list[str]:
    """A space and the text, cut before spaces after characters other than white space."""
    text = " " + text
    return _EDGE.split(text) if _ODD.search(text) else [" " + w for w in text[1:].split(" ")]


class Links:
    """Distinct pieces with their links, as packed numbers, and the text of their groups."""

    def __init__(self, sides: tuple[Callable[[], Side], ...]):
        self.sides = [side() for side in sides]
        self.sizes = [np.array([len(x) for x in spelled], np.int64) for _, spelled in self.sides]
        most = max(map(len, self.sizes))
        if most > IDS:
            raise ValueError("ids are too large")
        self.names = np.array([f"{i}{x}" for i in range(most) for x in _AFTER], object)
        self.table: dict[str, tuple[bytes, str]] = {}
        self.wrong: set[str] = set()
        self.kept = 0

    def of(self, text: str) -> tuple[np.ndarray, str] | None:
        """Links of a text and its groups' text; None if it is empty or if either side does not spell it."""
        if not text:
            return None
        pieces = pieces_of(text)
        if len(self.table) > TABLE or self.kept > TABLE_BYTES:
            self.table.clear()
            self.wrong.clear()
            self.kept = 0
        got = list(map(self.table.get, pieces))
        if None in got:
            # In their order, as only a text's last piece may end in white space.
            self.learn(list(dict.fromkeys([p for p, x in zip(pieces, got, strict=True) if x is None])))
            got = list(map(self.table.get, pieces))
        if self.wrong and not self.wrong.isdisjoint(pieces):
            # Pieces may be wrong and all of them together right.
            whole = "".join(pieces)
            ids = [list(chain.from_iterable(segment(pieces))) for segment, _ in self.sides]
            if not self.spell(ids, whole.encode()):
                return None
            got = self.laid_out(ids, np.array([len(whole.encode())]))
        links, texts = zip(*got, strict=True)
        return np.frombuffer(b"".join(links), np.int64), ";".join(texts)

    def learn(self, new: list[str]) -> None:
        """Segment and align pieces that are not in the table, of which only the last may end in white space."""
        whole = "".join(new)
        ids = [segment([whole])[0] for segment, _ in self.sides]
        ends = np.cumsum([*map(len, new)] if whole.isascii() else [len(p.encode()) for p in new])
        if self.spell(ids, whole.encode()) and (got := self.laid_out(ids, ends)):
            self.table.update(zip(new, got, strict=True))
            self.kept += int(ends[-1])
        elif len(new) == 1:
            self.table[whole] = (b"", "")
            self.wrong.add(whole)
        else:
            for half in (new[: len(new) // 2], new[len(new) // 2 :]):
                self.learn(half)

    def spell(self, ids: list[list[int]], whole: bytes) -> bool:
        """Whether both sides' tokens spell these bytes."""
        return all(b"".join([spelled[i] for i in x]) == whole for x, (_, spelled) in zip(ids, self.sides, strict=True))

    def laid_out(self, ids: list[list[int]], pieces: np.ndarray) -> list[tuple[bytes, str]] | None:
        """Packed links and the groups' text of each piece, from both sides' ids, which spell the same bytes, and the pieces' ends in these; None if a token reaches across one."""
        ids = [np.array(x, np.int64) for x in ids]
        ends = [np.cumsum(sizes[x]) for sizes, x in zip(self.sizes, ids, strict=True)]
        marks = np.zeros(pieces[-1] + 1, np.int8)
        marks[ends[0]] = 1
        marks[ends[1]] += 2
        if not (marks[pieces] == 3).all():
            return None
        end = np.flatnonzero(marks)
        mark = marks[end].astype(np.int64)
        # Tokens of each side that end by then, and the first that ends there or later.
        by = [np.cumsum(mark & 1), np.cumsum(mark >> 1)]
        first = [by[0] - (mark & 1), by[1] - (mark >> 1)]
        links = ids[0][first[0]] * PAIR + ids[1][first[1]] + mark * FLAGS
        cut = mark == 3
        group = np.cumsum(cut) - cut
        last = [x[cut] for x in by]
        after = [np.zeros(len(x), np.int64) for x in ids]
        after[0][last[0] - 1] = 1
        after[1][last[1] - 1] = 2
        stop = np.searchsorted(end, pieces)
        after[1][by[1][stop] - 1] = 3
        # Each group's tokens of the first side are written before its tokens of the second.
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + np.concatenate([[0], last[1]])[group[mark & 1 == 1]]] = ids[0] * len(_AFTER) + after[0]
        order[np.arange(len(ids[1])) + last[0][group[mark > 1]]] = ids[1] * len(_AFTER) + after[1]
        texts = "".join(self.names[order].tolist()).split("\n")
        at = [0, *((stop + 1) * links.itemsize).tolist()]
        packed = links.tobytes()
        return [(packed[i:j], x) for i, j, x in zip(at, at[1:], texts, strict=False)]


@lru_cache(maxsize=4)
def links_of(sides: tuple[Callable[[], Side], ...]) -> Links:
    """Kept by a worker from task to task."""
    return Links(sides)


def group_lists(links: np.ndarray) -> pa.Array:
    """array<struct<a, b>> of a text's links: ids of each side by group."""
    mark = links // FLAGS
    pair = links % FLAGS
    sides = [(pair // PAIR)[mark & 1 == 1], (pair % PAIR)[mark > 1]]
    last = [np.cumsum(x)[mark == 3] for x in (mark & 1, mark >> 1)]
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n]), pa.int32()), pa.array(x, pa.int32())) for n, x in zip(last, sides, strict=True)]
    return pa.StructArray.from_arrays(lists, ["a", "b"])


def alignment(text: str, row: str, sides: tuple[Callable[[], Side], ...], lists: bool) -> Column:
    """struct<n_a, n_b, n_groups, groups, pairs> of a space and the text; null where a side does not spell it or the text is empty.

    groups holds lists or is their text. Spark forgets how rows are dealt out where
    a function of Arrow batches is called, except over a window; a row is one here.
    """
    groups = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])) if lists else pa.string()
    pairs = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
    kind = pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", groups), ("pairs", pairs)])

    @F.arrow_udf(f"struct<n_a long, n_b long, n_groups long, groups {GROUPS if lists else 'string'}, pairs array<struct<pair long, n long>>>")
    def align(texts: pa.Array) -> pa.Scalar:
        got = links_of(sides).of(texts[0].as_py())
        if got is None:
            return pa.scalar(None, kind)
        links, written = got
        _, n_a, n_b, n_both = np.bincount(links // FLAGS, minlength=4).tolist()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        figures = [pa.array([n], pa.int64()) for n in (n_a + n_both, n_b + n_both, n_both)]
        each = pa.StructArray.from_arrays([pa.array(x) for x in np.unique(links % FLAGS, return_counts=True)], ["pair", "n"])
        return pa.StructArray.from_arrays([*figures, one(group_lists(links)) if lists else pa.array([written]), one(each)], fields=list(kind))[0]

    return align(text).over(Window.partitionBy(row))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text) in parts of about PART_BYTES."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # With a number, as adaptive execution would join partitions by the size of their texts, which then take many times as long.
    return rows.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "rid")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sides=(byte_side, piece_side), lists: bool = True) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, groups, pairs array<struct<pair, n>>): ids of each side by group, and a * PAIR + b of the id pairs that are linked, sorted, with the number of their links; null without tokens.

    groups is an array<struct<a, b>>, or, without lists, its text
    `a1,a2|b1;a3|b2,b3`. Row numbers are made anew with each run: write what is
    read more than once.
    """
    small_batches(docs.sparkSession)
    return dealt(docs, id_col, text_col).select("rid", "doc_id", alignment("text", "rid", tuple(sides), lists).alias("t")).select("rid", "doc_id", "t.*")


def pair_counts(done: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its a id is in more."""
    n = materialise(done.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair_counts")
    most = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / PAIR)))
    return n.select("pair", "n", (F.col("n") == most).alias("best"))


def scored(done: DataFrame) -> DataFrame:
    """(rid, n_links, n_best, count_sum) of documents with links."""
    counts = pair_counts(done)
    own = done.select("rid", F.inline("pairs").alias("pair", "links"))
    got = own.join(F.broadcast(counts) if counts.count() <= MAX_BROADCAST_PAIRS else counts, "pair")
    return got.groupBy("rid").agg(F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
