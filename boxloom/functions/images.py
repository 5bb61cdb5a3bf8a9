"""Pixel operators. Arithmetic runs on numpy; decoding needs an image library, asked for only when used."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiling

# The usual channel means and deviations.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def blend_on_white(channel: Column, alpha: Column) -> Column:
    """One channel of a picture with alpha on white, rounded half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), alpha / 255.0 * channel + 255.0 - alpha))).cast("int")


def blend_array(rgba: np.ndarray) -> np.ndarray:
    """The same for a whole (h, w, 4) picture."""
    alpha = rgba[..., 3:4].astype(np.float64)
    return np.rint(np.clip(alpha / 255 * rgba[..., :3] + 255 - alpha, 0, 255)).astype(np.uint8)


def to_chw(rgb: np.ndarray, symmetric: bool = True) -> np.ndarray:
    """(h, w, 3) bytes to (3, h, w) floats in [-1, 1], or normalised by channel."""
    x = rgb.astype(np.float32).transpose(2, 0, 1) / 255
    if symmetric:
        return x * 2 - 1
    return (x - np.array(MEAN, np.float32)[:, None, None]) / np.array(STD, np.float32)[:, None, None]


def _lanczos(x: np.ndarray) -> np.ndarray:
    """Windowed sinc of three lobes."""
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _bicubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    """Keys' cubic convolution kernel."""
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * a - 4 * a, 0.0))


KERNELS = {"lanczos": _lanczos, "bicubic": _bicubic}


def weights(n: int, m: int, kernel: str = "lanczos") -> np.ndarray:
    """(m, n) weights that resample n pixels to m; the kernel is widened where pixels get fewer."""
    scale = n / m
    at = (np.arange(m)[:, None] + 0.5) * scale - (np.arange(n)[None, :] + 0.5)
    w = KERNELS[kernel](at / max(scale, 1.0))
    return w / w.sum(axis=1, keepdims=True)


def resize(rgb: np.ndarray, w: int, h: int, kernel: str = "lanczos") -> np.ndarray:
    """A picture of (h, w), first along rows and then along columns, rounded to bytes after each."""
    def along(x: np.ndarray, m: int) -> np.ndarray:
        if x.shape[1] == m:
            return x
        exact = np.einsum("mn,hnc->hmc", weights(x.shape[1], m, kernel), x.astype(np.float64))
        return np.clip(np.rint(np.round(exact, 6)), 0, 255).astype(np.uint8)  # halves are halves, however a sum was ordered

    return along(along(rgb, w).transpose(1, 0, 2), h).transpose(1, 0, 2)


def tile_pixels(pictures: DataFrame, key: str, tile: int = 448, most: int = 9) -> DataFrame:
    """(key, n, pixels): tiles of pictures (key, pixels, width, height), a picture resized to its grid, and a thumbnail last if there are several.

    Pixels are rows of RGB bytes. A picture whose bytes are not width * height *
    3 is an error; one of null pixels has no tiles.
    """
    grid = tiling.choose_grid(F.col("width"), F.col("height"), most, tile)
    sized = pictures.where("pixels is not null").select(key, "pixels", "width", "height", grid.alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data, w, h, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                big = resize(rgb, g["i"] * tile, g["j"] * tile, "bicubic")
                cut = [big[y : y + tile, x : x + tile] for y in range(0, g["j"] * tile, tile) for x in range(0, g["i"] * tile, tile)]
                if len(cut) > 1:
                    cut.append(resize(rgb, tile, tile, "bicubic"))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cut), b.column(0).type), pa.array(range(len(cut)), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names=[key, "n", "pixels"])

    return sized.mapInArrow(run, f"{key} {pictures.schema[key].dataType.simpleString()}, n int, pixels binary")


def crop(rgb: np.ndarray, x0: int, y0: int, x1: int, y1: int, w: int, h: int) -> np.ndarray:
    """A box of a picture resized to (h, w); what of the box lies outside is black."""
    top, left = max(y0, 0), max(x0, 0)
    part = np.zeros((max(y1 - y0, 0), max(x1 - x0, 0), 3), np.uint8)
    if not part.size:
        raise ValueError("empty crop")
    inside = rgb[top : max(y1, 0), left : max(x1, 0)]
    part[top - y0 : top - y0 + inside.shape[0], left - x0 : left - x0 + inside.shape[1]] = inside
    return resize(part, w, h)


def decode(data: bytes | None) -> np.ndarray | None:
    """RGB pixels of an encoded picture, or None if it cannot be read."""
    from PIL import Image

    try:
        with Image.open(io.BytesIO(data)) as im:
            return blend_array(np.array(im.convert("RGBA")))
    except Exception:  # noqa: BLE001
        return None


def png_size(data: Column) -> Column:
    """struct(w, h) from a PNG's header, without decoding; null if it is none."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("w"), number(21).alias("h")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decoded_size(data: pd.Series) -> pd.Series:
    """[h, w] of each decodable picture, else null."""
    return data.map(lambda b: None if (p := decode(b)) is None else list(p.shape[:2]))
