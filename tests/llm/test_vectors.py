"""Hard negatives and vector codes against plain counts over all pairs."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import codes, negatives, queries
from fieldmark.llm.oracles import codes_sql, negatives_sql
from fieldmark.llm.vectors import Codebook

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return np.array([math.floor(256 * float(np.float32(x))) for x in v], np.int64)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def id_order(i):
    return (i is None, i or 0)


def plain_negatives(rows, rules=negatives.Rules(), every=100):
    rows, out = [(i, whole(v), label) for i, v, label in usable(rows) if label is not None], []
    for at, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = sorted((-int(v @ w), id_order(i), i, other == label) for k, (i, w, other) in enumerate(rows) if k != at)
        for p, _, positive, _ in [s for s in scored if s[3]][: rules.positives]:
            inside = [s for s in scored if not s[3] and rules.least * -p <= 100 * -s[0] <= rules.most * -p][: rules.negatives]
            out += [(anchor, positive, rank, s[2], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return out


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted([(i, whole(v), label) for i, v, label in usable(rows)], key=lambda r: (id_order(r[0]), r[1].tolist()))
    cut = [[tuple(map(int, x)) for x in np.split(v, parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(c):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        found = [nearest(c) for c in cut]
        for p in range(parts):
            members = {i: [c[p] for c, f in zip(cut, found) if f[p][1] == i] for i in range(len(books[p]))}
            books[p] = [tuple(sum(x) // len(m) for x in zip(*m)) if (m := members[i]) else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [nearest(c) for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(rows, error):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, label), f, e in zip(rows, found, error)]


def same(found, want):
    return sorted(map(str, map(tuple, found))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def odd_rows():
    """Ties, copies, nulls and shared ids, in few dimensions of few values."""
    rng = np.random.default_rng(5)
    rows = [(int(i) if i else None, [float(x) for x in rng.integers(-3, 4, 16) / 8 + rng.integers(0, 2, 16) / 4096], int(label) if label < 5 else None) for i, label in zip(rng.integers(0, 90, 400), rng.integers(0, 6, 400))]
    rows += [(100, rows[3][1], 1)] * 3 + [(200, [0.0] * 16, 2), (300, None, 1), (301, [0.5] * 15 + [None], 1), (302, [0.5] * 15 + [float("nan")], 1), (400, [0.5] * 15 + [float("inf")], 1), (500, [1.0] * 16, 2), (501, [-1.0] * 16, 2)]
    return rows


@pytest.mark.parametrize("pairs, at_once, anchors, width", [(1 << 15, 1024, 2048, 2), (50, 40, 2, 3)])
def test_negatives(spark, odd_rows, monkeypatch, pairs, at_once, anchors, width):
    for name, value in (("PAIRS", pairs), ("ROWS", at_once), ("ANCHORS", anchors), ("WIDTH", width)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    found = negatives.mine(df, lambda i: i % 20 == 0, negatives.Rules(3, 4, 20, 95))
    assert found.dtypes == [tuple(c.split()) for c in negatives.RESULT.replace("long", "bigint").split(", ")]
    want = plain_negatives(odd_rows, negatives.Rules(3, 4, 20, 95), 20)
    assert len(want) > 100 and same(found.collect(), want)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    data = rng.integers(-200, 200, (3000, 32)) + rng.integers(-300, 300, (10, 32))[np.arange(3000) % 10]
    books = negatives.fit_books(data[:1000])
    at = np.cumsum([0, *[b.shape[1] for b in books]])
    code, left = np.zeros((3000, len(books)), np.uint8), np.zeros(3000, np.int64)
    for p, b in enumerate(books):
        points = np.ascontiguousarray(data[:, at[p] : at[p + 1]].T)
        book = Codebook(b)
        code[:, p], gap = book.nearest(points, book.first_guess(points))
        left += gap
    label = np.arange(3000) % 10
    block = negatives.Block(np.arange(3000), np.arange(3000), label, data, code, negatives.rounded_up(left))
    by_label = np.argsort(label[:20], kind="stable")
    anchors = negatives.Anchors(block.at(by_label), books).build()
    near, slack, true = anchors.looked_up(code, 0, 20), block.residual[:, None] * anchors.norm + 1, data @ data[by_label].T
    assert np.all(true <= near + slack) and np.all(true >= near - slack)
    scored = []
    exact = anchors.exact
    anchors.exact = lambda rows, r, q: (scored.append(len(r)), exact(rows, r, q))[1]
    anchors.same_label(block, lists := negatives.Lists(20, 5, np.full(20, -negatives.NO_ID)))
    anchors.same_label(block, negatives.Lists(20, 5, lists.bound))
    assert sum(scored[len(scored) // 2 :]) < 0.2 * 20 * 300  # of all pairs of a label, once bounds are known


@pytest.mark.parametrize("entries, parts", [(64, 16), (7, 4), (256, 8)])
def test_codes(spark, odd_rows, entries, parts):
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    found = codes.compress(df, parts, entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert same(found, plain_codes(odd_rows, parts, entries))


def test_exponion_search_is_exact_from_any_start():
    rng = np.random.default_rng(2)
    entries, points = rng.integers(-5, 6, (40, 3)), rng.integers(-6, 7, (500, 3))
    gaps = ((points[:, None] - entries[None]) ** 2).sum(-1)
    for start in (np.zeros(500, np.int64), rng.integers(0, 40, 500)):
        index, gap = Codebook(entries).nearest(np.ascontiguousarray(points.T), start)
        assert np.array_equal(index, gaps.argmin(1)) and np.array_equal(gap, gaps.min(1))


def test_codes_round_trip(spark):
    rows = [(i, [float(i % 3), 0.5, -0.25, i % 2 / 2], i % 2) for i in range(50)]
    found = codes.fit(spark.createDataFrame(rows, SCHEMA), parts=2, entries=6)
    for r in found.rows.collect():
        assert int(((codes.decode(r["code_"].hex(), found.books) - np.array(r["whole_"])) ** 2).sum()) == r["error"]


def test_no_rows_and_bad_vectors(spark):
    none, dropped = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)
    for df in (none, dropped):
        assert codes.compress(df).collect() == [] and negatives.mine(df, lambda i: i % 2 == 0).collect() == []
    alone = spark.createDataFrame([(0, [0.25, 0.5], 1)], SCHEMA)
    assert negatives.mine(alone, lambda i: i % 2 == 0).collect() == []
    assert len(codes.compress(alone, parts=2).collect()) == 1
    for rows in ([(0, [1e9, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0], 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        for run in (lambda d: codes.compress(d, parts=2), lambda d: negatives.mine(d, lambda i: i % 2 == 0)):
            with pytest.raises(Exception, match="component|length"):
                run(df).collect()


def test_clashing_columns(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    clashing = df.select("vec_id", F.lit("x").alias("Label"), F.lit(0).alias("row_"), "embedding", "label", F.lit(1).alias("whole_"), F.lit(2).alias("error"), F.lit(3).alias("EMBEDDING"))
    assert same(codes.compress(clashing).collect(), map(tuple, codes.compress(df).collect()))
    assert same(negatives.mine(clashing, lambda i: i % 20 == 0).collect(), map(tuple, negatives.mine(df, lambda i: i % 20 == 0).collect()))


@pytest.mark.parametrize("name, sql", [("op11_hard_negatives", negatives_sql()), ("op12_vector_codes", codes_sql())])
def test_sql(spark, name, sql):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = queries.QUERIES[name](spark, sf)
    cur = con.execute(sql)
    assert [d[0] for d in cur.description] == found.columns
    want = cur.fetchall()
    assert want and same(found.collect(), want)
