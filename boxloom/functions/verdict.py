"""Yes/no answers, their probabilities and the corrected verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, safe for large ones; each step is computed once, so the cost is linear."""
    raised = lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return let(let(F.array_max(logits), raised), lambda r: let(total(r), lambda t: F.transform(r, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """1-based position of the greatest value; the first of equal ones."""
    return F.array_position(values, F.array_max(values))


def mass(probs: Column, positions: list[int]) -> Column:
    """Sum of the probabilities at 1-based positions (the spellings of one answer)."""
    out = F.element_at(probs, positions[0])
    for p in positions[1:]:
        out = out + F.element_at(probs, p)
    return out


def read_answer(answer: Column) -> Column:
    """yes, no or err from the first letters."""
    a = F.lower(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    return F.when(a.startswith("yes"), "yes").when(a.startswith("no"), "no").otherwise("err")


def corrected(answer: Column, yes: Column, no: Column, least: float = 0.3, margin: float = 0.2) -> Column:
    """An unreadable answer follows the probabilities; a yes needs its margin; a no stands."""
    wins = yes >= no + margin
    return F.when(answer == "err", F.when(yes < least, "no").when(wins, "yes").otherwise("no")).when((answer == "yes") & ~wins, "no").otherwise(answer)


def pair_text(yes: Column, no: Column) -> Column:
    return F.format_string("(%.4f_%.4f)", yes, no)
