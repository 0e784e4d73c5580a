"""Resampling against plain sums over whole images, in fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.functions import pixels, vision

SCHEMA = "id long, width int, height int, content binary"


def kernel(x):
    x = abs(x)
    if x < 1:
        return Fraction(3, 2) * x**3 - Fraction(5, 2) * x**2 + 1
    return Fraction(-1, 2) * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else Fraction(0)


def line(values, to):
    """All places of a line, each as a sum over all its pixels."""
    step, out = Fraction(len(values), to), []
    wide = max(Fraction(1), step)
    for at in range(to):
        k = [kernel((i + Fraction(1, 2) - (at + Fraction(1, 2)) * step) / wide) for i in range(len(values))]
        total = sum(k)
        whole = [math.floor(abs(x) / total * 2**22 + Fraction(1, 2)) * (-1 if x < 0 else 1) for x in k]
        out.append(min(255, max(0, (sum(a * b for a, b in zip(whole, values)) + 2**21) >> 22)))
    return out


def plain(image, side):
    """The whole image resampled, columns and then lines, and cut at the end; one colour."""
    height, width = len(image), len(image[0])
    scale = side / min(width, height)
    wide, high = max(side, round(width * scale)), max(side, round(height * scale))
    rows = [line(r, wide) for r in image]
    columns = [line([r[x] for r in rows], high) for x in range(wide)]
    left, top = (wide - side) // 2, (high - side) // 2
    return [[columns[x][y] for x in range(left, left + side)] for y in range(top, top + side)]


@pytest.mark.parametrize(("width", "height", "side"), [(7, 5, 4), (5, 7, 9), (13, 4, 3), (1, 6, 5), (9, 1, 4), (1, 1, 3), (6, 6, 6), (31, 17, 2), (3, 50, 7)])
def test_squares(width, height, side):
    rng = random.Random(width * 100 + height)
    image = [[rng.choice([0, 255, rng.randrange(256)]) for _ in range(width)] for _ in range(height)]
    colours = np.array([[[p, 255 - p, 7] for p in r] for r in image], np.uint8)
    got = pixels.middle_square(colours, side)
    assert got.shape == (side, side, 3) and got[:, :, 0].tolist() == plain(image, side)
    assert got[:, :, 1].tolist() == plain([[255 - p for p in r] for r in image], side) and (got[:, :, 2] == 7).all()


def test_an_image_of_its_size_stays():
    image = np.arange(6 * 6 * 3, dtype=np.uint8).reshape(6, 6, 3)
    assert (pixels.middle_square(image, 6) == image).all()


def test_a_long_line_needs_no_large_image():
    image = np.full((1, 400_000, 3), 9, np.uint8)
    assert (pixels.middle_square(image, 224) == 9).all()  # the whole of it would be 224 times as high and as wide


def test_prepared(spark):
    image = bytes(range(5 * 4 * 3))
    rows = [(1, 5, 4, image), (1, 5, 4, image), (2, 4, 4, image), (3, None, 4, image), (4, 5, 4, None), (5, 0, 4, b""), (6, -5, -4, image), (7, 1, 1, b"\x00\x80\xff")]
    got = pixels.prepared(spark.createDataFrame(rows, SCHEMA).withColumn("pixels", F.lit("clash")), 3, batch=2).collect()
    want = pixels.middle_square(np.frombuffer(image, np.uint8).reshape(4, 5, 3), 3).ravel().tolist()
    assert sorted((r["id"], r["pixels"]) for r in got if r["pixels"]) == [(1, want), (1, want), (7, [0, 128, 255] * 9)]
    assert sorted(r["id"] for r in got if r["pixels"] is None) == [2, 3, 4, 5, 6]
    assert pixels.prepared(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planes(spark):
    row = spark.createDataFrame([([0, 128, 255, 10, 20, 30],), (None,)], "pixels array<smallint>").select(pixels.planes(F.col("pixels")).alias("x")).collect()
    colour = lambda c, p: (p / 255 - vision.MEANS[c]) / vision.DEVIATIONS[c]
    assert row[0]["x"] == pytest.approx([colour(0, 0), colour(0, 10), colour(1, 128), colour(1, 20), colour(2, 255), colour(2, 30)], rel=1e-6) and row[1]["x"] is None
