"""Folds over boxes against plain loops."""

import random
import time

from pyspark.sql import functions as F

from fieldmark.operators import metrics

BOXES = "image long, box long, label int, x1 double, y1 double, x2 double, y2 double, score double"


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for box in range(n):
        x, y = rng.randrange(8) / 10, rng.randrange(8) / 10
        rows.append((rng.randrange(6), box, rng.randrange(2), x, y, x + rng.choice([0.0, 0.2, 0.3]), y + rng.choice([0.2, 0.3]), rng.choice([0.5, 0.6, 0.7, None])))
    return rows


def overlap(a, b):
    w, h = max(0.0, min(a[5], b[5]) - max(a[3], b[3])), max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
    area = lambda c: (c[5] - c[3]) * (c[6] - c[4])
    return w * h / max(area(a) + area(b) - w * h, 1e-12)


def by_score(rows):
    return sorted(rows, key=lambda r: (r[7] is None, -(r[7] or 0), r[1]))


def test_suppression(spark):
    rows, kept = made(500, 1), []
    for r in by_score(rows):
        if not any(k[0] == r[0] and k[2] == r[2] and overlap(k, r) > 0.45 for k in kept):
            kept.append(r)
    got = metrics.suppress(spark.createDataFrame(rows, BOXES).repartition(5))
    assert got.columns == [c.split()[0] for c in BOXES.split(", ")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, kept)) and 20 < len(kept) < 450


def test_matching(spark):
    found, truth = [r for r in made(120, 2) if r[0] != 1], [r for r in made(90, 3) if r[0] != 4]
    want = {}
    for image in {r[0] for r in found + truth}:
        free, hits = sorted(r for r in truth if r[0] == image), 0
        mine = by_score([r for r in found if r[0] == image])
        for r in mine:
            best = max(free, key=lambda t: (overlap(r, t), -t[1]), default=None)
            if best is not None and overlap(r, best) >= 0.5:
                hits += 1
                free.remove(best)
        want[image] = hits, len(mine) - hits, len(free)
    got = metrics.match_boxes(spark.createDataFrame(found, BOXES).repartition(3), spark.createDataFrame(truth, BOXES).repartition(3))
    assert {r.image: (r.hits, r.extra, r.missed) for r in got.collect()} == want and sum(w[0] for w in want.values()) > 10
    assert [n for n, _ in got.dtypes] == ["image", "hits", "extra", "missed"] and {k for _, k in got.dtypes} == {"bigint"}


def test_no_boxes(spark):
    none = spark.createDataFrame([], BOXES)
    one = spark.createDataFrame(made(1, 1), BOXES)
    assert metrics.suppress(none).collect() == [] and metrics.match_boxes(none, none).collect() == []
    assert [tuple(r)[1:] for r in metrics.match_boxes(one, none).collect()] == [(0, 1, 0)]
    assert [tuple(r)[1:] for r in metrics.match_boxes(none, one).collect()] == [(0, 0, 1)]


def folded(found, truth, least=0.5):
    """Counts by the rule itself: a fold over the boxes of each image with column expressions, null and NaN sides as Spark compares them."""
    sides = ("box", "x1", "y1", "x2", "y2")
    a = found.groupBy("image").agg(metrics._best_first(found).alias("f"))
    b = truth.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(*sides))).alias("t"))

    def taken(free, box):
        most = F.array_max(F.transform(free, lambda t, i: F.struct(metrics.overlap(box, t).alias("v"), (-i).alias("i"))))
        return F.coalesce(F.transform(F.array(most), lambda m: F.when(m["v"] >= least, F.filter(free, lambda t, i: i != -m["i"])).otherwise(free))[0], free)

    df = a.join(b, "image", "full").select("image", F.coalesce("f", F.array()).alias("f"), F.coalesce("t", F.array()).alias("t")).withColumn("left", F.size(F.aggregate("f", F.col("t"), taken)))
    return df.select("image", (F.size("t") - F.col("left")).alias("hits"), (F.size("f") - F.size("t") + F.col("left")).alias("extra"), F.col("left").alias("missed"))


def test_odd_boxes_match_as_by_the_fold(spark, monkeypatch):
    rng = random.Random(7)
    odd = lambda x: rng.choice([None, float("nan"), float("inf"), -float("inf")]) if rng.random() < 0.04 else x
    boxes = lambda n, seed: [(None if r[0] == 5 else r[0], r[1] % 50, r[2], *map(odd, r[3:7]), r[7]) for r in made(n, seed)]
    found, truth = (spark.createDataFrame(boxes(n, seed), BOXES) for n, seed in ((400, 4), (300, 5)))
    counts = lambda df: sorted((str(r.image), r.hits, r.extra, r.missed) for r in df.collect())
    want = counts(folded(found, truth))
    assert counts(metrics.match_boxes(found, truth)) == want and len(want) == 7
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")  # images reach over batches
        assert counts(metrics.match_boxes(found, truth)) == want
    finally:
        spark.conf.set(key, before)


def test_many_boxes_of_an_image_are_matched_in_blocks(spark):
    """The fold took the square of an image's boxes in the interpreter: minutes for these."""
    rows = [(1, i, 0, (i % 60) * 1.0, (i // 60) * 1.0, (i % 60) + 1.0, (i // 60) + 1.0, 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, BOXES)
    began = time.time()
    assert [tuple(r) for r in metrics.match_boxes(df, df).collect()] == [(1, 3000, 0, 0)]
    assert time.time() - began < 20
