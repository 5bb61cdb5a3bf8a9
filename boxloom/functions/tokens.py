"""Tokens of captions: where each ends, and the last sentence that a model of limited length still sees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Tokens that a model takes, and those of them that begin and end every text.
LIMIT, MARKS = 77, 2
#: Code points that are tokenized at a time: the library keeps some hundred bytes a token, and an Arrow batch may hold 10,000 long texts.
SLICE = 1 << 17


@cache
def _tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def _slices(texts: pa.Array, most: int = SLICE) -> Iterator[list[str]]:
    """The texts in order, lists of at most so many code points, longer texts alone; null as empty."""
    held, size = [], 0
    for t in texts:
        x = t.as_py() or ""
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def token_ends(text: Column | str, path: str) -> Column:
    """Where each token ends, in code points, as array<int>; null for a null text. path: a tokenizer's JSON file, on every machine."""

    @F.arrow_udf("array<int>")
    def ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.array([e for _, e in x.offsets], np.int32) for given in _slices(texts) for x in _tokenizer(path).encode_batch(given, add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])), mask=texts.is_null())

    return ends(text)


def seen(text: Column, ends: Column, limit: int = LIMIT, marks: int = MARKS) -> Column:
    """Code points of a text that the first tokens cover; all of it if there are no more. Characters of several tokens count when their last is among them."""
    n = limit - marks
    whole = F.filter(F.slice(ends, 1, n), lambda e: e < F.get(ends, F.lit(n)))
    return F.when(F.size(ends) <= n, F.length(text)).otherwise(F.coalesce(F.try_element_at(whole, F.lit(-1)), F.lit(0)))


def last_sentence(text: Column, ends: Column, limit: int = LIMIT, marks: int = MARKS) -> Column:
    """Where, in code points, the last sentence ends that ends within the first tokens; 0 if none does.

    A sentence ends with a word that ends in . ! or ?, and with the last word.
    Words are placed by a running sum of their lengths, white space included.
    """
    def placed(cap: Column) -> Column:
        def step(a: Column, w: Column, n: Column) -> Column:
            at, nth = a["at"] + F.length(w), a["nth"] + 1
            return F.struct(at.alias("at"), nth.alias("nth"), F.when((at <= cap) & (w.rlike("[.!?]$") | (nth == n)), at).otherwise(a["best"]).alias("best"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), F.lit(0).alias("best"))
        fold = lambda words: F.aggregate(words, start, lambda a, w: step(a, w, F.size(words)), lambda a: a["best"])
        return let(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), fold)

    return let(seen(text, ends, limit, marks), placed)
