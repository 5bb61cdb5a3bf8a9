"""Counter-based randomness: a draw depends on its key alone, never on partitions or order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a draw, 52 bits.
ORDER_LENGTH = 13


def uniform(seed: int, *parts: Column | str) -> Column:
    """A double in [0, 1): 52 bits of md5 over seed and parts."""
    return F.conv(random_order(seed, *parts), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_py(seed: int, *parts) -> float:
    """The same draw in Python."""
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / (1 << 52)


def draws_py(seed: int, *parts):
    """i -> uniform_py(seed, *parts, i), with what stays the same made once."""
    before = hashlib.md5(("|".join(map(str, (seed, *parts))) + "|").encode())

    def draw(i: int) -> float:
        h = before.copy()
        h.update(str(i).encode())
        return int(h.hexdigest()[:13], 16) / (1 << 52)

    return draw


def uniform_int(u: Column, low: Column, high: Column) -> Column:
    """An integer in [low, high] from a draw."""
    return (low + F.floor(u * (high - low + 1))).cast("long")


def random_order(seed: int, *parts: Column | str) -> Column:
    """A sort key that shuffles rows the same way every time: the hex digits of uniform, whose order is that of its numbers."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.substring(F.md5(text), 1, ORDER_LENGTH)
