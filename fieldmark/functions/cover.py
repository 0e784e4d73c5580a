"""Covers of polygons by cells of a quad-tree: inner cells need no test, border cells have the few sides that theirs needs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Cells of level n have sides of 2 ** (10 - n) degrees. Covers use every second level up to the last: a cell has 16 in the next one.
LAST_LEVEL, STEP = 21, 2
#: Coordinates beyond these are in no cell.
REACH = 512.0
COVER = "zone_ {kind}, level int, cell long, inner boolean, odd boolean, sides array<struct<ax: double, ay: double, bx: double, by: double>>"


class Sides(NamedTuple):
    """Sides of a polygon's rings from (ax, ay) to (bx, by), one an array place."""

    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray

    def at(self, which: np.ndarray) -> Sides:
        return Sides(*[c[which] for c in self])


def sides_of(rings: list[list[tuple[float, float]]]) -> Sides:
    """Each ring's sides, the last one back to its start."""
    parts = [np.array([[p[0], p[1]] for p in ring], float).reshape(-1, 2) for ring in rings]
    a = np.concatenate([np.zeros((0, 2)), *parts])
    b = np.concatenate([np.zeros((0, 2)), *[np.roll(p, -1, axis=0) for p in parts]])
    return Sides(a[:, 0], a[:, 1], b[:, 0], b[:, 1])


def crossed(s: Sides, x: float, y: float) -> int:
    """Sides that a ray from the point to the east crosses."""
    upright = (s.ay > y) != (s.by > y)
    s = s.at(upright)
    return int(np.count_nonzero(x < s.ax + (y - s.ay) * (s.bx - s.ax) / (s.by - s.ay)))


def touching(s: Sides, west: float, south: float, east: float, north: float, pad: float) -> np.ndarray:
    """Sides that may meet the closed cell; one that barely misses it may count."""
    near = (np.minimum(s.ax, s.bx) <= east + pad) & (np.maximum(s.ax, s.bx) >= west - pad) & (np.minimum(s.ay, s.by) <= north + pad) & (np.maximum(s.ay, s.by) >= south - pad)
    dx, dy = s.bx - s.ax, s.by - s.ay
    turns = [dx * (y - s.ay) - dy * (x - s.ax) for x in (west - pad, east + pad) for y in (south - pad, north + pad)]
    return near & (np.minimum.reduce(turns) <= 0) & (np.maximum.reduce(turns) >= 0)


def cells_of(rings: list[list[tuple[float, float]]], few_sides: int = 8, fine: int = 2, deep: int = 5, most: int = 2048) -> Iterator[tuple[int, int, int, bool, bool, Sides | None]]:
    """(level, x, y, inner, odd, sides) of the cells that cover a polygon.

    A cell that no side touches is inner or left out. A border cell is divided until it is ``fine`` steps below the first ones, and on, up to
    ``deep``, while its test needs over ``few_sides`` sides; once there are ``most`` cells, none is divided any more. A border cell has the
    sides that the ray of a point in it may or may not cross, and those it may lie on; ``odd`` says whether those that every ray
    crosses are odd in number. So tests by the cell and by all rings agree for every point, and only the cost depends on the limits.
    """
    s = sides_of(rings)
    if not len(s.ax) or not np.isfinite(np.concatenate(s)).all() or np.abs(np.concatenate(s)).max() > REACH:
        if len(s.ax):
            raise ValueError(f"a polygon has coordinates that are not within {REACH} degrees")
        return
    low, high = np.array([min(s.ax), min(s.ay)]), np.array([max(s.ax), max(s.ay)])
    root = LAST_LEVEL
    while root > 1 and 2.0 ** (10 - root) < (high - low).max():
        root -= STEP
    scale = 2.0 ** (root - 10)
    (x0, y0), (x1, y1) = np.floor(low * scale).astype(int).tolist(), np.floor(high * scale).astype(int).tolist()
    todo = deque((root, x, y, s) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    made = 0
    while todo:
        level, x, y, sides = todo.popleft()
        side = 2.0 ** (10 - level)
        west, south, east, north = x * side, y * side, (x + 1) * side, (y + 1) * side
        pad = 1e-9 * side + 1e-12 * max(abs(west), abs(east), abs(south), abs(north))
        sides = sides.at((np.maximum(sides.ay, sides.by) >= south - pad) & (np.minimum(sides.ay, sides.by) <= north + pad) & (np.maximum(sides.ax, sides.bx) >= west - pad))
        if not touching(sides, west, south, east, north, pad).any():
            if crossed(sides, west + side / 2, south + side / 2) % 2:
                made += 1
                yield level, x, y, True, False, None
            continue
        beyond = np.minimum(sides.ax, sides.bx) > east + pad
        low_end, high_end = np.minimum(sides.ay, sides.by), np.maximum(sides.ay, sides.by)
        always, never = beyond & (low_end <= south) & (high_end > north), beyond & (low_end == high_end)
        needed = ~always & ~never
        steps = (level - root) // STEP
        if level + STEP <= LAST_LEVEL and made + len(todo) < most and (steps < fine or steps < deep and np.count_nonzero(needed) > few_sides):
            n = 1 << STEP
            todo.extend((level + STEP, x * n + i, y * n + j, sides) for i in range(n) for j in range(n))
        else:
            made += 1
            yield level, x, y, False, bool(np.count_nonzero(always) % 2), sides.at(needed)


def cell_key(level: Column | int, x: Column, y: Column) -> Column:
    """One number for a cell."""
    level = F.lit(level) if isinstance(level, int) else level
    half = 1 << (LAST_LEVEL - 1)
    return (level.cast("long") * (1 << 48)) + (x + half) * (1 << 24) + (y + half)


def covered(polygons: DataFrame) -> DataFrame:
    """The cells of all polygons (id, rings), as rows of ``COVER``; a polygon is looked at by itself, in one task."""
    kind = polygons.schema["id"].dataType.simpleString()
    half = 1 << (LAST_LEVEL - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, rings in zip(batch.column("id").to_pylist(), batch.column("rings").to_pylist(), strict=True):
                rows = [
                    {"zone_": ident, "level": level, "cell": (level << 48) + ((x + half) << 24) + (y + half), "inner": inner, "odd": odd, "sides": None if sides is None else [dict(zip(Sides._fields, side)) for side in zip(*[c.tolist() for c in sides])]}
                    for level, x, y, inner, odd, sides in cells_of([[(p["x"], p["y"]) for p in ring] for ring in rings or []])
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = to_arrow_schema(StructType.fromDDL(COVER.format(kind=kind)))
    return polygons.select("id", "rings").mapInArrow(run, COVER.format(kind=kind))


def point_cells(x: Column, y: Column, levels: list[int]) -> Column:
    """The point's cell at each of these levels; none for a point that is nowhere. Scaling by powers of two is exact."""
    at = lambda v, n: F.floor(v * F.lit(2.0 ** (n - 10)))
    somewhere = x.between(-REACH, REACH) & y.between(-REACH, REACH)
    return F.when(somewhere, F.array(*[cell_key(n, at(x, n), at(y, n)) for n in levels]))


def holds(x: Column, y: Column) -> Column:
    """Whether a point lies inside the polygon of a cover's row whose cell it is in; sides are outside."""

    def crosses(e: Column) -> Column:
        at = e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    def on(e: Column) -> Column:
        flat = (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
        return flat & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    many = F.size(F.filter("sides", crosses)) + F.col("odd").cast("int")
    return F.col("inner") | ((many % 2 == 1) & ~F.exists("sides", on))
