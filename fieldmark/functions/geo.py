"""Polygons, boxes and grids as column expressions. A polygon is an array of rings, a ring an array of struct(x, y), closed or not."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres of a degree of latitude, and of longitude at the equator.
KM_LAT, KM_LON = 110.574, 111.320


def point(x: float | Column, y: float | Column) -> Column:
    return F.struct((x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(float(y))).cast("double").alias("y"))


def from_geojson(text: Column) -> Column:
    """Rings of all polygons of a Polygon or MultiPolygon."""
    poly = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    multi = F.from_json(text, "type string, coordinates array<array<array<array<double>>>>")
    rings = F.when(F.get_json_object(text, "$.type") == "MultiPolygon", F.flatten(multi["coordinates"])).otherwise(poly["coordinates"])
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def bounds(rings: Column) -> Column:
    """struct(west, south, east, north)."""
    xs = F.transform(F.flatten(rings), lambda p: p["x"])
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def _edges(ring: Column) -> Column:
    """struct(a, b) of each side, the last one back to the start."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, (i + 1) % n + 1).alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside: a ray from it crosses the rings an odd number of times, so holes count as outside; edges are outside."""

    def crossings(ring: Column) -> Column:
        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
            return ((a["y"] > y) != (b["y"] > y)) & (x < at)

        return F.size(F.filter(_edges(ring), crosses))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    on_edge = F.exists(rings, lambda r: F.exists(_edges(r), on))
    return (F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, n: s + n) % 2 == 1) & ~on_edge


def _doubled(ring: Column) -> Column:
    """Twice the signed area, measured from the ring's first point to keep digits."""
    o = ring[0]
    return _sum(F.transform(_edges(ring), lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])))


def centroid_lat(rings: Column) -> Column:
    """Latitude of the area's centre; the rings after the first are holes."""

    def moment(ring: Column) -> Column:
        o = ring[0]
        part = F.transform(_edges(ring), lambda e: ((e["a"]["y"] - o["y"]) + (e["b"]["y"] - o["y"])) * ((e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])))
        return _sum(part) / 3 + o["y"] * _doubled(ring)

    sign = lambda ring, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(_doubled(ring))
    return F.try_divide(_sum(F.transform(rings, lambda r, i: sign(r, i) * moment(r))), _sum(F.transform(rings, lambda r, i: sign(r, i) * _doubled(r))))


def area_km2(rings: Column) -> Column:
    """Area on a plane scaled at each ring's mean latitude; the rings after the first are holes."""

    def of(ring: Column) -> Column:
        mean = _sum(F.transform(ring, lambda p: p["y"])) / F.size(ring)
        return F.abs(_doubled(ring)) / 2 * KM_LAT * KM_LON * F.cos(F.radians(mean))

    return _sum(F.transform(rings, lambda r, i: F.when(i == 0, of(r)).otherwise(-of(r))))


def grid_steps(km: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude of a square of that many kilometres."""
    return km / (F.lit(KM_LON) * F.cos(F.radians(lat))), km / F.lit(KM_LAT)


def extent_km(box: Column) -> Column:
    """The longer side of a box, at its middle latitude."""
    lat = (box["south"] + box["north"]) / 2
    return F.greatest((box["east"] - box["west"]) * KM_LON * F.cos(F.radians(lat)), (box["north"] - box["south"]) * KM_LAT)


def grid_size(extent: Column, records: Column, sizes: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0)) -> Column:
    """The size nearest to the extent divided into about 2.5 square roots of the records, 6 to 28 squares; the smaller of equals."""
    want = extent / F.greatest(F.lit(6.0), F.least(F.round(2.5 * F.sqrt(records)), F.lit(28.0)))
    return F.array_min(F.transform(F.array(*[F.lit(s) for s in sizes]), lambda s: F.struct(F.abs(s - want).alias("d"), s.alias("s"))))["s"]


def heat_level(records: Column, most: Column) -> Column:
    """0 to 4 by the square root of the share of the largest."""
    return F.when((records <= 0) | (most <= 0), 0).otherwise(F.least(F.lit(4), F.floor(5 * F.sqrt(records / most)))).cast("int")


#: Radius of the sphere that has the earth's area.
AUTHALIC_KM = 6371.0072


def geodesic_km2(rings: Column) -> Column:
    """Area on that sphere, sides taken along parallels and meridians in proportion; the rings after the first are holes."""

    def of(ring: Column) -> Column:
        part = F.transform(_edges(ring), lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"]))))
        return F.abs(_sum(part)) / 2 * AUTHALIC_KM**2

    return _sum(F.transform(rings, lambda r, i: F.when(i == 0, of(r)).otherwise(-of(r))))


# The ellipsoid's equatorial radius in kilometres and its flattening (WGS 84).
EQUATOR_KM, FLATTENING = 6378.137, 1 / 298.257223563
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Twice the area from the equator to a pole, for a radian of longitude and an equatorial radius of one.
POLE_ZONE = 1 + (1 - ECCENTRICITY**2) / ECCENTRICITY * math.atanh(ECCENTRICITY)


def authalic_sine(lat: Column) -> Column:
    """Sine of the latitude on the sphere of equal area that has as much area below it as the latitude has on the ellipsoid."""
    s = F.sin(F.radians(lat))
    x = ECCENTRICITY * s
    zone = (1 - ECCENTRICITY**2) * (s / (1 - x * x) + F.log((1 + x) / (1 - x)) / (2 * ECCENTRICITY))
    return F.greatest(F.lit(-1.0), F.least(zone / POLE_ZONE, F.lit(1.0)))


def ellipsoid_km2(rings: Column) -> Column:
    """Area on the ellipsoid, exact by latitude, with sides that are great circles of the sphere of equal area; later rings are holes.

    Such sides part from geodesics by less than a millionth of the area for sides of a degree; longer ones along parallels should be
    given with points between. Sides take the shorter way round. Rings may cross the date line, but must not hold a pole.
    """

    def side(e: Column) -> Column:
        turn = F.radians(F.pmod(e["b"]["x"] - e["a"]["x"] + 180, F.lit(360.0)) - 180)
        a, b = [F.tan(F.asin(authalic_sine(e[k]["y"])) / 2) for k in ("a", "b")]
        return 2 * F.atan2(F.tan(turn / 2) * (a + b), 1 + a * b)

    def of(ring: Column) -> Column:
        return F.abs(_sum(F.transform(_edges(ring), side))) * (EQUATOR_KM**2 * POLE_ZONE / 2)

    return _sum(F.transform(rings, lambda r, i: F.when(i == 0, of(r)).otherwise(-of(r))))


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A line (a point a row) with fewer points, none of those left out farther than the tolerance from it (Douglas and Peucker); ends stay."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along, off = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*along)
        far = np.abs(along[0] * off[:, 1] - along[1] * off[:, 0]) / length if length else np.hypot(*off.T)
        at = a + 1 + int(far.argmax())
        if far.max() > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return points[sorted(keep)]


def simplify(polygons: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """(id, rings) with fewer points for display; rings of four sides or fewer are left as they are, others are closed."""
    kind = "array<array<struct<x: double, y: double>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for shape in batch.column("rings").to_pylist():
                rings = []
                for ring in shape or []:
                    line = np.array([(p["x"], p["y"]) for p in ring]).reshape(-1, 2)
                    line = line if len(line) and np.array_equal(line[0], line[-1]) else np.concatenate([line, line[:1]])
                    rings.append([{"x": x, "y": y} for x, y in (simplified(line, tolerance) if len(line) > 5 else line).tolist()])
                shapes.append(rings)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shapes, batch.schema.field("rings").type)], names=["id", "rings"])

    return polygons.select("id", "rings").mapInArrow(run, f"id {polygons.schema['id'].dataType.simpleString()}, rings {kind}")
