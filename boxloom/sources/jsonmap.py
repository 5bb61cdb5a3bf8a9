"""One large JSON object as rows, read in parallel by byte ranges.

Whether a byte lies inside a string depends on every quote before it, so a range
alone cannot tell. A first pass therefore says of each range, for every way in
which it might begin, how it would end and by how much brackets deepen. Those
few numbers a range, composed in order, give each range its true beginning, and
the second pass reads the entries whose separator (the opening brace or a comma
at depth one) lies in its range, the last one to its end beyond the range.

Rows are (file, at, key, value): where the entry's separator lies, and its
value, text of strings as it is and JSON of all else. An object that names a key
twice gives two rows; `last_wins` keeps the later, as a parser would. A file
that is no JSON object is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files_below, store_of

#: Bytes of a range, and of what a task reads at a time.
SPLIT, BLOCK = 64 << 20, 4 << 20
#: How a range may begin: outside strings, inside one, or inside one after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
ENTRIES = "file string, at long, key string, value string"


def _inside(block: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """For every byte whether it lies in a string (its closing quote counts as outside), and the state behind the block."""
    slashes = np.flatnonzero(block == 92)
    if slashes.size:
        first = np.concatenate([[True], np.diff(slashes) > 1])  # of a run of backslashes
        nth = np.arange(slashes.size) - np.maximum.accumulate(np.where(first, np.arange(slashes.size), 0))
        odd = (slashes[0] == 0 and state == ESCAPED) & (np.cumsum(first) == 1)
        active = slashes[(nth + odd) % 2 == 0]  # those that escape what follows
    else:
        active = slashes
    escaped = np.zeros(block.size + 1, bool)
    escaped[active + 1] = True
    if state == ESCAPED:
        escaped[0] = True
    quotes = (block == 34) & ~escaped[:-1]
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    end = (ESCAPED if escaped[-1] else INSIDE) if inside[-1] else OUTSIDE
    return inside, end


def _steps(block: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """+1 for an opening bracket outside strings, -1 for a closing one."""
    return (np.isin(block, (123, 91)).astype(np.int8) - np.isin(block, (125, 93)).astype(np.int8)) * ~inside


def summary(blocks: Iterator[np.ndarray]) -> list[tuple[int, int]]:
    """For each beginning, the state at the end and the change of depth."""
    now = [(s, 0) for s in (OUTSIDE, INSIDE, ESCAPED)]
    for block in blocks:
        for s, (state, depth) in enumerate(now):
            inside, end = _inside(block, state)
            now[s] = end, depth + int(_steps(block, inside).sum(dtype=np.int64))
    return now


def beginnings(summaries: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The true state and depth at the beginning of each range of a file, and behind the last."""
    out = [(OUTSIDE, 0)]
    for s in summaries:
        state, depth = out[-1]
        out.append((s[state][0], depth + s[state][1]))
    return out


def entries(read, low: int, high: int, size: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(place of the separator, `"key": value`) of every entry whose separator lies in [low, high); read(at, n) gives bytes."""
    at, held, open_at = low, [], None
    while at < size and (at < high or open_at is not None):
        data = read(at, min(BLOCK, (high if at < high else size) - at))
        block = np.frombuffer(data, np.uint8)
        inside, state = _inside(block, state)
        steps = _steps(block, inside)
        levels = depth + np.cumsum(steps, dtype=np.int64)
        marks = np.flatnonzero(~inside & ((block == 44) & (levels == 1) | (steps == 1) & (levels == 1) | (steps == -1) & (levels == 0)))
        start = 0
        for m in marks.tolist():
            if open_at is not None:
                yield open_at, b"".join([*held, data[start:m]])
            elif at + m >= high:
                return
            held, start = [], m + 1
            open_at = at + m if at + m < high and data[m] != 125 else None
            if at + m >= high:
                return
        if open_at is not None:
            held.append(data[start:])
        depth, at = int(levels[-1]), at + len(data)


def parsed(entry: bytes) -> tuple[str, str | None] | None:
    """Key and value of an entry; None for the blank one of an empty object."""
    if not entry.strip():
        return None
    ((key, value),) = json.loads(b"{" + entry + b"}").items()
    return key, value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class _Ranges(DataSourceReader):
    """Partitions are (file, its size, low, high, state, depth)."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.begun = json.loads(options.get("begun", "null"))
        self.first = self.begun is None

    def partitions(self) -> list[InputPartition]:
        if not self.first:
            begun, self.begun = self.begun, None  # every task is sent the reader, which must not hold all ranges
            return [InputPartition(tuple(x)) for x in begun]
        found = files_below(self.path)
        return [InputPartition((f, size, low, min(low + self.split, size), 0, 0)) for f, size in found for low in range(0, size, self.split)]

    def read(self, partition: InputPartition):
        name, size, low, high, state, depth = partition.value
        with store_of(self.path).open_input_file(name) as f:
            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            if self.first:
                found = summary(np.frombuffer(read(at, min(BLOCK, high - at)), np.uint8) for at in range(low, high, BLOCK))
                yield name, size, low, high, json.dumps(found)
            else:
                for at, entry in entries(read, low, high, size, state, depth):
                    if got := parsed(entry):
                        yield name, at, *got


class JsonRanges(DataSource):
    """First pass: a row for each range of every file below `path`, hidden ones left out."""

    @classmethod
    def name(cls) -> str:
        return "json_ranges"

    def schema(self) -> str:
        return "file string, size long, low long, high long, summary string"

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(self.options)


class JsonEntries(DataSource):
    """Second pass: the entries of ranges whose beginnings are known (option begun)."""

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Ranges(self.options)


def json_map(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, at, key, value) of all entries of the JSON objects below a path; a row for each range comes to the driver."""
    for source in (JsonRanges, JsonEntries):
        spark.dataSource.register(source)
    ranges = spark.read.format("json_ranges").option("path", path).option("split", split).load().orderBy("file", "low").collect()
    begun = []
    for name in dict.fromkeys(r["file"] for r in ranges):
        own = [r for r in ranges if r["file"] == name]
        states = beginnings([json.loads(r["summary"]) for r in own])
        if states[-1] != (OUTSIDE, 0):
            raise ValueError(f"{name} is not a JSON object")
        begun += [(name, r["size"], r["low"], r["high"], *s) for r, s in zip(own, states, strict=False)]
    if not begun:
        return spark.createDataFrame([], ENTRIES)
    return spark.read.format("json_entries").option("path", path).option("begun", json.dumps(begun)).load()


def last_wins(entries_: DataFrame) -> DataFrame:
    """(key, value): of several entries with one key the last, by file and place."""
    return entries_.groupBy("key").agg(F.max_by("value", F.struct("file", "at")).alias("value"))
