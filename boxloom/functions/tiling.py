"""Crop sizes and tile grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_size(w: Column, h: Column, fit: int = 392, largest: int = 224, smallest: int = 28) -> Column:
    """struct(w, h) of a crop after resizing: longest side to `fit`, then the shorter side into [smallest, largest]."""
    r = F.lit(float(fit)) / F.greatest(w, h)
    a, b = F.floor(w * r), F.floor(h * r)
    short = F.least(a, b)

    def scaled(to: int) -> tuple[Column, Column]:
        s = F.lit(float(to)) / short
        return F.greatest(F.floor(a * s), F.lit(to)), F.greatest(F.floor(b * s), F.lit(to))

    low, high = scaled(smallest), scaled(largest)
    pick = lambda i, plain: F.when(short < smallest, low[i]).when(short > largest, high[i]).otherwise(plain).cast("long")
    return F.struct(pick(0, a).alias("w"), pick(1, b).alias("h"))


def grids(most: int) -> list[tuple[int, int]]:
    """All (columns, rows) with at most `most` tiles, fewest tiles first."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda g: (g[0] * g[1], g))


def choose_grid(w: Column, h: Column, most: int = 9, tile: int = 448) -> Column:
    """struct(i, j) of the grid nearest in aspect; an exact tie goes to the later grid if the image has over half its pixels."""
    ratio = w / h
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i / j).alias("r")) for i, j in grids(most)])

    def step(acc: Column, g: Column) -> Column:
        d = F.abs(ratio - g["r"])
        better = (d < acc["d"]) | ((d == acc["d"]) & (w * h > F.lit(0.5 * tile * tile) * g["i"] * g["j"]))
        taken = F.struct(g["i"].alias("i"), g["j"].alias("j"), d.alias("d"))
        return F.when(better, taken).otherwise(acc)

    return F.aggregate(table, F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("d")), step, lambda a: F.struct(a["i"].alias("i"), a["j"].alias("j")))


def tiles(grid: Column, tile: int = 448, thumbnail: bool = True) -> Column:
    """Array of tiles (n, x0, y0, x1, y1) over the resized image, row by row; with a thumbnail (all zero) last if there are several."""
    n = grid["i"] * grid["j"]
    cells = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.struct(k.alias("n"), (k % grid["i"] * tile).alias("x0"), (F.floor(k / grid["i"]).cast("int") * tile).alias("y0"), ((k % grid["i"] + 1) * tile).alias("x1"), ((F.floor(k / grid["i"]).cast("int") + 1) * tile).alias("y1")),
    )
    if not thumbnail:
        return cells
    whole = F.struct(n.alias("n"), *[F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return F.when(n > 1, F.concat(cells, F.array(whole))).otherwise(cells)
