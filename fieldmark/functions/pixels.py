"""Images made ready for a model: resampled to a short side and cut to their middle square."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.vision import normalised_colours

#: The cubic kernel's parameter and reach, and the bits of whole-number weights, as image libraries have them.
SHARPNESS, REACH, BITS = -0.5, 2.0, 22


def kernel(x: np.ndarray) -> np.ndarray:
    """The cubic kernel: one at zero, zero at other whole numbers and from ``REACH`` on."""
    a, x = SHARPNESS, np.abs(x)
    near, far = (a + 2) * x**3 - (a + 3) * x**2 + 1, a * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < REACH, far, 0.0))


@lru_cache(maxsize=256)
def weights(size: int, to: int, first: int, n: int) -> list[tuple[int, np.ndarray]]:
    """For places ``first`` to ``first + n`` of a line of ``to`` made from ``size``: where their pixels begin, and whole weights of these.

    A line that shrinks has its kernel widened by as much, so that every pixel counts.
    """
    step = size / to
    wide = max(1.0, step)
    out = []
    for at in range(first, first + n):
        middle = (at + 0.5) * step
        a, z = max(0, int(middle - REACH * wide + 0.5)), min(size, int(middle + REACH * wide + 0.5))
        k = kernel((np.arange(a, z) + 0.5 - middle) / wide)
        k = k / k.sum() * (1 << BITS)
        out.append((a, np.trunc(k + np.copysign(0.5, k))))
    return out


def _resampled(pixels: np.ndarray, places: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Places of the first axis from their pixels. Weights times pixels are whole numbers below 2**53, so doubles add them exactly."""
    sums = [np.tensordot(k, pixels[a : a + len(k)].astype(np.float64), 1) for a, k in places]
    return np.clip(np.floor(np.stack(sums) / (1 << BITS) + 0.5), 0, 255).astype(np.uint8)


def middle_square(pixels: np.ndarray, side: int) -> np.ndarray:
    """(side, side, colours) of an image (height, width, colours): the short side made ``side``, the middle kept.

    Columns first, then lines. Only what is kept is resampled, so an image of one line and any length needs no more memory than itself.
    """
    height, width = pixels.shape[:2]
    scale = side / min(width, height)
    wide, high = max(side, round(width * scale)), max(side, round(height * scale))
    columns, lines = weights(width, wide, (wide - side) // 2, side), weights(height, high, (high - side) // 2, side)
    a, z = min(x for x, _ in lines), max(x + len(k) for x, k in lines)
    narrow = _resampled(pixels[a:z].transpose(1, 0, 2), columns).transpose(1, 0, 2)
    return _resampled(narrow, [(x - a, k) for x, k in lines])


def prepared(images: DataFrame, side: int = 224, key: str = "id", batch: int = 16) -> DataFrame:
    """(key, pixels): the middle square of each image (key, width, height, content), its colours in turn, line by line, 0 to 255.

    ``content``: three bytes for each pixel, line by line. Null where it, or a side, is null, a side isn't positive, or the bytes aren't
    as many as the sides say. A task makes ``batch`` squares at a time. No rows: no rows; rows with one key: each its own.
    """

    def square(width, height, content) -> np.ndarray | None:
        if content is None or pd.isna(width) or pd.isna(height) or min(width, height) <= 0 or len(content) != 3 * int(width) * int(height):
            return None
        return middle_square(np.frombuffer(content, np.uint8).reshape(int(height), int(width), 3), side).ravel().astype(np.int16)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "pixels": [square(w, h, c) for w, h, c in zip(part["width"], part["height"], part["content"], strict=True)]})

    return images.select(key, "width", "height", "content").mapInPandas(run, f"`{key}` {images.schema[key].dataType.simpleString()}, pixels array<smallint>")


def planes(pixels: Column) -> Column:
    """Prepared pixels as models take them: all of the first colour, then the second, then the third, normalised."""
    values = normalised_colours(pixels)
    colour = lambda c: F.filter(values, lambda _, i: i % 3 == c)
    return F.concat(*[colour(c) for c in range(3)]).cast("array<float>")
