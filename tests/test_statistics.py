"""Statistics against plain versions."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import analytics


def test_rarefied_richness(spark):
    rows = [[1] * 12, [10, 0, 3], [5], [9], [], [20, 1, 1]]
    df = spark.createDataFrame([(r, sum(r)) for r in rows], "c array<bigint>, t bigint").select(analytics.rarefied_richness(F.col("c"), F.col("t")))
    want = [sum(1 - math.comb(sum(r) - c, 10) / math.comb(sum(r), 10) for c in r if c) if sum(r) >= 10 else None for r in rows]
    assert [r[0] for r in df.collect()] == [w if w is None else pytest.approx(w) for w in want]


def test_rank_correlation(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 5), rng.random() if g else 1.0) for g in range(3) for _ in range(20)] + [(9, 1, 2.0), (9, 2, 3.0)]
    got = {r.g: r.rho for r in analytics.spearman(spark.createDataFrame(rows, "g int, x int, y double"), "x", "y", "g").collect()}

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    for g in range(3):
        x, y = ranks([r[1] for r in rows if r[0] == g]), ranks([r[2] for r in rows if r[0] == g])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        cov, var = sum((a - mx) * (b - my) for a, b in zip(x, y)), sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)
        assert got[g] == (pytest.approx(cov / math.sqrt(var)) if var else None)
    assert got[9] is None


def test_mann_kendall(spark):
    rng = random.Random(2)
    groups = {1: [rng.random() for _ in range(9)], 2: [1.0] * 6, 3: [1.0, 2.0, 2.0, 5.0, 4.0], 4: [1.0, 2.0, 3.0]}
    df = spark.createDataFrame([(g, 2000 + i, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g int, t int, y double")
    got = {r.g: r for r in analytics.mann_kendall(df, "t", "y", "g").collect()}
    assert set(got) == {1, 2, 3}
    for g in got:
        y = groups[g]
        n = len(y)
        s = sum((b > a) - (b < a) for a, b in combinations(y, 2))
        tied = sum(k * (k - 1) * (2 * k + 5) for k in (y.count(v) for v in set(y)))
        var = (n * (n - 1) * (2 * n + 5) - tied) / 18
        z = (s - (s > 0) + (s < 0)) / math.sqrt(var) if var > 0 else 0.0
        slopes = sorted((y[j] - y[i]) / (j - i) for i, j in combinations(range(n), 2))
        m = len(slopes)
        assert (got[g].s, got[g].n) == (s, n)
        assert got[g].z == pytest.approx(z) and got[g].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        assert got[g].slope == pytest.approx((slopes[m // 2] + slopes[(m - 1) // 2]) / 2)
        assert got[g].tau == pytest.approx(s / (n * (n - 1) / 2))


def test_points_on_edges_are_outside(spark):
    from fieldmark.functions import geo

    p = lambda x, y: geo.point(F.lit(float(x)), F.lit(float(y)))
    rings = F.array(F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4)), F.array(p(1, 1), p(3, 1), p(3, 3), p(1, 3)))
    points = {(2, 0): False, (0, 0): False, (4, 2): False, (1, 2): False, (3, 3): False, (0.5, 0.5): True, (2, 2): False, (3.5, 2): True, (5, 2): False, (2, 4): False}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    got = {(r.x, r.y): r.inside for r in df.select("x", "y", geo.contains(rings, F.col("x"), F.col("y")).alias("inside")).collect()}
    assert got == {(float(x), float(y)): v for (x, y), v in points.items()}


def test_simplified_lines():
    import numpy as np

    from fieldmark.functions import geo

    kept = lambda points, tolerance: [tuple(p) for p in geo.simplified(np.array(points, float), tolerance).tolist()]
    assert kept([(0, 0), (1, 0.0001), (2, 0), (2, 1), (2, 2)], 0.001) == [(0, 0), (2, 0), (2, 2)]
    assert kept([(0, 0), (1, 1), (0, 0)], 0.1) == [(0, 0), (1, 1), (0, 0)]


def test_squares_that_do_not_vary_are_insufficient(spark):
    from fieldmark.operators import reports

    cell = lambda zone, i, invasive, richness: (zone, i, 0, 20, invasive, float(richness))
    rows = [cell(1, i, 4, i % 7) for i in range(30)] + [cell(2, i, i % 9, 5) for i in range(30)] + [cell(3, i, i % 9, i % 7) for i in range(30)] + [cell(4, i, 4, i) for i in range(5)] + [cell(5, i, int(i == 0), i % 7) for i in range(30)]
    cells = spark.createDataFrame(rows, "zone_id int, cx int, cy int, all_records long, invasive_records int, richness double")
    for draws in (0, 20):
        got = {r.zone_id: r for r in reports.pairs_layer(cells, draws).collect()}
        assert {z: (r.status, r.reason, r.rho is None) for z, r in got.items()} == {1: ("insufficient", "constant", True), 2: ("insufficient", "constant", True), 3: ("ok", None, False), 4: ("insufficient", "cells", True), 5: ("insufficient", "invaded", True)}
    assert got[3].low <= got[3].rho <= got[3].high and got[1].low is None and got[2].needs and got[3].caution


def test_an_insufficient_layer_has_no_number(spark):
    from fieldmark.operators import reports

    years = spark.createDataFrame([(1, 2000 + i, 20, 9, 3) for i in range(8)] + [(2, 2000 + i, 20, 9, 3) for i in range(5)] + [(3, 2000 + i, 20, 1, 3) for i in range(8)], "zone_id int, year long, effort long, invasive long, native long")
    got = {r.zone_id: r for r in reports.trend_layer(years).collect()}
    assert got[1].status == "ok" and got[1].invasive_n == 8 and got[1].reason is None
    assert (got[2].reason, got[2].usable_years) == ("years", 5) and (got[3].reason, got[3].invasive_records) == ("records", 8)
    assert all(got[z][c] is None for z in (2, 3) for c in ("invasive_s", "invasive_tau", "native_slope", "caution", "first_year")) and got[2].needs


def test_zone_documents(spark):
    import json

    from fieldmark.plans.reports import QUERIES

    features = [json.loads(r.feature) for r in QUERIES["zone_features"](spark, "/root/testdata/sf0.001").collect()]
    assert len(features) == 25 and all(f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] and f["properties"]["media"] >= 0 for f in features)
    collection = json.loads(QUERIES["zone_collection"](spark, "/root/testdata/sf0.001").first().collection)
    assert sorted(map(str, collection["features"])) == sorted(map(str, features))


def test_trends_and_reports_compute_their_years_once(spark):
    """Years of records are the costly part: a plan that names them several times made them anew each time."""
    from fieldmark.plans.catalogue import World
    from fieldmark.operators import reports

    w = World(spark, "/root/testdata/sf0.001")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#") and sum("Relation" in x and "l_orderkey" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert scans(w.trend_years) == 1 == scans(reports.trend_layer(w.trend_years)) == scans(analytics.trend(w.trend_years))
    layer = reports.trend_layer(w.trend_years)
    assert layer.filter("invasive_p IS NOT NULL").count() == layer.filter("status = 'ok'").count()
    none = [w.zones, w.zones.selectExpr("id AS zone_id", "0L AS media_id", "0L AS species_id"), w.zones.selectExpr("id AS zone_id", "0L AS species_id", "0L AS records", "date'2020-01-01' AS first_record", "date'2020-01-01' AS last_record", "1L AS sources")]
    pairs = w.zones.selectExpr("id AS zone_id", "'ok' AS status", "CAST(NULL AS string) AS reason", "1L AS cells", "1L AS invaded", "0.5D AS rho")
    assert scans(reports.report_lines(none[0], none[1], none[2], w.species, w.findings, pairs, layer)) == 1


def test_pairs_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, 2, None), (1, 3, 2.0), (1, None, 5.0), (2, 1, 1.0), (2, 1, 2.0), (2, 1, 3.0), (2, 1, 3.0)], "g int, t int, y double")
    got = {r.g: r for r in analytics.mann_kendall(df, "t", "y", "g").collect()}
    assert (got[1].n, got[1].s, got[1].slope) == (5, 1, 0.25) and (got[2].n, got[2].s, got[2].slope, got[2].z) == (4, None, None, None)
