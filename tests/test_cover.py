"""Covers of polygons by cells against the ray test over all rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import cover, geo
from fieldmark.operators import ingest

ZONES = "id int, rings array<array<struct<x: double, y: double>>>"


def star(rng, x, y, size, corners):
    """A ring around a point with odd corners."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [(x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def box(west, south, east, north):
    return [(float(west), float(south)), (float(east), float(south)), (float(east), float(north)), (float(west), float(north))]


def inside(rings, x, y):
    """Crossings of a ray to the east are odd, and the point is on no side; with fractions where a side is met exactly."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def shapes():
    rng = random.Random(7)
    large = star(rng, 10, 5, 42, 900)
    return [
        [box(-30, -30, 30, 30), box(-1, -1, 1, 1), box(-20, 0, -16, 4)],  # 60 by 60 degrees with two holes, sides on borders of cells
        [large],
        [star(rng, -100, 30, 3, 40), star(rng, -100, 30, 0.3, 12)],
        [box(0.125, 0.125, 0.25, 0.5)],  # its corners are corners of cells
        [box(5, 5, 5, 9)],  # no area
        [[*box(40, 40, 41, 41), (40.0, 40.0)]],  # closed
        [box(-180, -90, 180, 90)],
        [star(rng, 77.1, 11.3, 0.02, 7)],
    ]


def around(rings, rng, n):
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    w, h = max(xs) - min(xs) + 0.1, max(ys) - min(ys) + 0.1
    points = [(rng.uniform(min(xs) - w / 10, max(xs) + w / 10), rng.uniform(min(ys) - h / 10, max(ys) + h / 10)) for _ in range(n)]
    points += [p for r in rings for p in r][:50]  # corners
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for r in rings for a, b in zip(r, r[1:])][:50]  # on sides
    points += [(rng.choice(xs), rng.uniform(min(ys), max(ys))) for _ in range(30)] + [(rng.uniform(min(xs), max(xs)), rng.choice(ys)) for _ in range(30)]  # level with corners
    return points + [(round(x * 8) / 8, round(y * 8) / 8) for x, y in points[:100]]  # on borders of cells


@pytest.mark.parametrize("limits", [{}, {"few_sides": 0, "fine": 3}, {"fine": 0, "deep": 0}, {"most": 5}])
def test_cells_agree_with_all_rings(limits):
    rng = random.Random(1)
    for rings in shapes():
        cells = {}
        for level, x, y, inner, odd, sides in cover.cells_of(rings, **limits):
            assert (level, x, y) not in cells
            cells[level, x, y] = inner, odd, sides
        levels = {k[0] for k in cells}
        for x, y in around(rings, rng, 400):
            found = [c for n in levels if (c := cells.get((n, math.floor(x * 2.0 ** (n - 10)), math.floor(y * 2.0 ** (n - 10)))))]
            assert len(found) <= 1  # cells don't overlap
            got = False
            for inner, odd, s in found:
                ring_free = [[(a, b), (c, d)] for a, b, c, d in zip(*s)] if s is not None else []
                got = inner or (sum(inside_parity(r, x, y) for r in ring_free) + odd) % 2 == 1 and not any(on(r, x, y) for r in ring_free)
            assert got == inside(rings, x, y), (rings[0][:4], x, y)


def inside_parity(side, x, y):
    (ax, ay), (bx, by) = side
    return (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)


def on(side, x, y):
    (ax, ay), (bx, by) = side
    return (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)


def test_large_polygons_are_not_copied_to_their_cells():
    for rings in shapes():
        cells = list(cover.cells_of(rings))
        corners = sum(map(len, rings))
        assert len(cells) <= 2048 + 16
        assert sum(len(c[5].ax) for c in cells if c[5] is not None) <= 30 * corners + 16 * len(cells)
    wide = list(cover.cells_of(shapes()[0]))
    assert sum(c[3] for c in wide) > 20 and len(wide) < 400  # inner cells of 60 by 60 degrees are few and large


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_points_get_their_lowest_zone(spark, most):
    rng = random.Random(3)
    rings = shapes()
    zones = list(zip((30, 20, 10, 5, 4, 6, 50, 7), rings, strict=True)) + [(99, None), (98, [])]
    points = [p for r in rings for p in around(r, rng, 100)] + [(300.0, 0.0), (float("nan"), 0.0), (0.0, None), (float("inf"), 1.0)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id long, lon double, lat double")
    got = {r["id"]: r["assigned_zone"] for r in ingest.assign_zones(df, spark.createDataFrame(zones, ZONES), ["id"], most).collect()}
    nowhere = lambda v: v is None or not math.isfinite(v)
    want = {i: min((z for z, r in zones if r and not nowhere(x) and not nowhere(y) and inside(r, x, y)), default=None) for i, (x, y) in enumerate(points)}
    assert got == want and len(set(want.values())) >= 6


def test_no_zones_and_no_points(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lon double, lat double")
    assert [r["assigned_zone"] for r in ingest.assign_zones(points, spark.createDataFrame([], ZONES), ["id"]).collect()] == [None]
    assert ingest.assign_zones(points.limit(0), spark.createDataFrame([(1, [box(0, 0, 1, 1)])], ZONES), ["id"]).collect() == []


def test_cells_agree_with_the_column_test(spark):
    rings = [box(-30, -30, 30, 30), box(-1, -1, 1, 1)]
    df = spark.createDataFrame([(float(x), float(y)) for x in range(-33, 34, 3) for y in range(-31, 32, 2)], "lon double, lat double")
    zone = spark.createDataFrame([(1, rings)], ZONES)
    plain = {(r.lon, r.lat) for r in df.crossJoin(zone).filter(geo.contains(F.col("rings"), F.col("lon"), F.col("lat"))).collect()}
    assert {(r.lon, r.lat) for r in ingest.assign_zones(df, zone, ["lon", "lat"]).collect() if r.assigned_zone == 1} == plain


def test_simplified_rings(spark):
    rng = random.Random(5)
    ring = [(math.cos(t / 50) * 3 + rng.uniform(-1e-3, 1e-3), math.sin(t / 50) * 3) for t in range(314)]
    df = spark.createDataFrame([(1, [ring, box(0, 0, 1, 1)]), (2, [box(0, 0, 1, 1)[:3]]), (3, [])], ZONES)
    got = {r.id: [[(p.x, p.y) for p in x] for x in r.rings] for r in geo.simplify(df, 0.01).collect()}
    assert got[1][0][0] == got[1][0][-1] == ring[0] and 10 < len(got[1][0]) < 80 and set(got[1][0]) <= set(ring)
    gap = lambda p, a, b: abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / math.dist(a, b)
    kept = [ring.index(p) for p in got[1][0][:-1]] + [len(ring)]
    assert all(gap(ring[i], ring[a], ring[b % len(ring)]) <= 0.01 + 1e-12 for a, b in zip(kept, kept[1:]) for i in range(a + 1, b))
    assert [len(x) for x in got[1][1:]] == [5] and [len(x) for x in got[2]] == [4] and got[3] == []
