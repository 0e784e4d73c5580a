import pytest
from pyspark.sql import functions as F

from fieldmark.functions import geo

SURFACE = 510_065_621.724  # of the whole ellipsoid, in square kilometres


def area(spark, *rings):
    df = spark.createDataFrame([([[{"x": float(x), "y": float(y)} for x, y in r] for r in rings],)], "rings array<array<struct<x: double, y: double>>>")
    return df.select(geo.ellipsoid_km2(F.col("rings"))).first()[0]


def test_known_areas(spark):
    assert area(spark, [(0, 0), (90, 0), (0, 90)]) == pytest.approx(SURFACE / 8, rel=1e-9)
    assert area(spark, [(0, 0), (120, 0), (60, -90)]) == pytest.approx(SURFACE / 6, rel=1e-9)
    assert area(spark, [(0, 0), (1, 0), (1, 1), (0, 1)]) == pytest.approx(12308.778361469, rel=1e-6)


def test_holes_date_line_and_order(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    assert area(spark, square(0, 40, 2), square(0.5, 40.5, 1)) == pytest.approx(area(spark, square(0, 40, 2)) - area(spark, square(0.5, 40.5, 1)))
    assert area(spark, [(179, 10), (-179, 10), (-179, 12), (179, 12)]) == pytest.approx(area(spark, square(5, 10, 2)))
    assert area(spark, square(3, -20, 1)[::-1]) == pytest.approx(area(spark, square(3, 19, 1)))
    assert area(spark, [(3, 4)]) == pytest.approx(0, abs=1e-9)
