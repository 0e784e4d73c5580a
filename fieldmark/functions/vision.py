"""Box and pixel arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dhash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """A signed 64-bit hash of grey pixels, row by row: a bit is set where a pixel is brighter than the one to its right; first bit highest."""
    bits = [F.when(F.get(pixels, F.lit(r * width + c)) > F.get(pixels, F.lit(r * width + c + 1)), F.lit(1 << (63 - (r * (width - 1) + c)) if r or c else -(1 << 63))).otherwise(F.lit(0)) for r in range(height) for c in range(width - 1)]
    out = bits[0].cast("bigint")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("bigint"))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def letterbox(width: Column, height: Column, side: int = 640) -> Column:
    """struct(scale, pad_x, pad_y) of an image fitted into a square."""
    scale = F.least(side / width.cast("double"), side / height.cast("double"))
    return F.struct(scale.alias("scale"), ((side - F.round(width * scale)) / 2).alias("pad_x"), ((side - F.round(height * scale)) / 2).alias("pad_y"))


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.15) -> Column:
    """Pixel box around a relative box, padded by a share of its sides and clipped, a pixel wide and high at least."""
    dx, dy = (x2 - x1) * pad, (y2 - y1) * pad
    left, top = F.floor(F.greatest(F.lit(0.0), x1 - dx) * width), F.floor(F.greatest(F.lit(0.0), y1 - dy) * height)
    right, bottom = F.least(width, F.floor((x2 + dx) * width)), F.least(height, F.floor((y2 + dy) * height))
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(right, left + 1).alias("right"), F.greatest(bottom, top + 1).alias("bottom"))


def unboxed(x: Column, y: Column, shape: Column, width: Column, height: Column) -> Column:
    """struct(x, y): a place in the fitted square as shares of the image; ``shape`` is what ``letterbox`` gave."""
    return F.struct(((x - shape["pad_x"]) / shape["scale"] / width).alias("x"), ((y - shape["pad_y"]) / shape["scale"] / height).alias("y"))


# Means and deviations of the colours that image models are trained with.
MEANS, DEVIATIONS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def centre_crop(width: Column, height: Column, side: int = 224) -> Column:
    """struct(scale, left, top) of the middle square of an image whose short side is made ``side``."""
    scale = side / F.least(width, height).cast("double")
    return F.struct(scale.alias("scale"), F.floor((F.round(width * scale) - side) / 2).alias("left"), F.floor((F.round(height * scale) - side) / 2).alias("top"))


def normalised_colours(pixels: Column) -> Column:
    """Pixels of three colours in turn, 0 to 255, as image models take them."""
    of = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % 3 + 1).cast("int"))
    return F.transform(pixels, lambda p, i: (p / 255.0 - of(MEANS, i)) / of(DEVIATIONS, i))


# Kinds of image that may be sent, and pixels beyond which a file is taken for a trap.
KINDS, MOST_PIXELS = ("image/jpeg", "image/png", "image/webp"), 50_000_000


def upload_problem(kind: Column, content: Column, most_bytes: int) -> Column:
    """Why an uploaded file is refused, null if it isn't: its type, size, emptiness, first bytes, or the pixels that a PNG says it has."""
    head = lambda a, n: F.substring(F.hex(content), 2 * a + 1, 2 * n)
    number = lambda a: F.conv(head(a, 4), 16, 10).cast("long")
    known = F.when(head(0, 3) == "FFD8FF", "image/jpeg").when(head(0, 8) == "89504E470D0A1A0A", "image/png").when((head(0, 4) == "52494646") & (head(8, 4) == "57454250"), "image/webp")
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unsupported type")
        .when(F.octet_length(content) > most_bytes, "too large")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(known.isNull(), "not a readable image")
        .when((known == "image/png") & (number(16) * number(20) > MOST_PIXELS), "not a readable image")
    )
