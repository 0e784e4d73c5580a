"""The trie against dictionaries, and the model against a plain one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from fieldmark.llm import lm

SCHEMA = "doc_id long, text string, score string"


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Water", "sea", "deep", "é", "a", "long", "word-with-signs", "x1"]
    rows = [(i, " ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "rare1 rare2 the of"), (None, "the sea"), (0, rows[0][1])]


def tokens(text):
    return [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def plain(rows, order):
    held = {i: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for i, r in enumerate(rows)}
    train = [tokens(r[1]) for i, r in enumerate(rows) if not held[i]]
    c = Counter(t for ts in train for t in ts)
    n, v = sum(c.values()), len(c)
    two, three = Counter(), Counter()
    for ts in train:
        ts = [None, *ts]
        two.update(zip(ts, ts[1:]))
        three.update(zip(ts, ts[1:], ts[2:]))
    d = lm.DISCOUNT

    def p1(w):
        return (c[w] + 1) / (n + v + 1)

    def p2(u, w):
        if u not in c:
            return p1(w)
        rest = 1 - sum(x - d for (a, _), x in two.items() if a == u) / c[u]
        return rest * p1(w) + (max(two.get((u, w), d), d) - d) / c[u]

    def p3(t, u, w):
        if (t, u) not in two:
            return p2(u, w)
        rest = 1 - sum(x - d for (a, b, _), x in three.items() if (a, b) == (t, u)) / two[t, u]
        return rest * p2(u, w) + (max(three.get((t, u, w), d), d) - d) / two[t, u]

    out = []
    for i, r in enumerate(rows):
        ts = tokens(r[1])
        base = sum(math.log10(p1(t)) for t in ts)
        s = 0.0
        for k, w in enumerate(ts):
            u = ts[k - 1] if k else None
            s += math.log10(p1(w) if order == 1 else p2(u, w) if order == 2 or k == 0 else p3(ts[k - 2] if k > 1 else None, u, w))
        out.append((held[i], len(ts), sum(c[t] > 0 for t in ts), n, base, s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = lm.score_documents(df, order=order, levels=None).collect()  # before quantising
    codes = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(df, order=order).collect()}
    assert len(got) == len(rows)
    want = {}
    for r, w in zip(rows, plain(rows, order)):
        want.setdefault(r[0], w)
    for g in got:
        w = want[g.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], abs=1e-9)
        assert g.score == pytest.approx(w[5], abs=1e-9)
        assert codes[g.doc_id, g.n_tokens] == pytest.approx(w[5], abs=0.01 * g.n_tokens)


def test_rare_words_have_ngrams(spark):
    rows = [*corpus(), *[(500 + i, f"once{i} seldom harbour lights {'twice' if i < 2 else 'thrice'} seen") for i in range(5)]]
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect()}
    for r, w in list(zip(rows, plain(rows, 3)))[-5:]:
        assert got[r[0]].score == pytest.approx(w[5], abs=0.01 * w[1])


def test_many_shards(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x") for r in corpus(60)], SCHEMA)
    one = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(df, levels=None).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    monkeypatch.setattr(lm, "HELD", 50)
    many = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(df.repartition(5), levels=None).collect()}
    assert many.keys() == one.keys()
    assert not {k: (one[k], many[k]) for k in one if many[k] != pytest.approx(one[k], abs=1e-9)}


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = lm.score_documents(spark.createDataFrame([Row(doc_id=i, text="a b", score="x") for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2], SCHEMA)).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in only} == {(True, 0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 1, 7, 7, 7, 900], list(range(1000)), [0] * 200, [1 << 50, (1 << 50) + 1]])
def test_elias_fano(values, tmp_path):
    lm.save(str(tmp_path / "x"), **lm.EliasFano.build(np.array(values, np.uint64), "p_"), other=np.arange(3))
    ef = lm.EliasFano(lm.load(str(tmp_path / "x")), "p_")
    assert ef.access(np.arange(len(values))).tolist() == values
    asked = np.array(sorted({0, 3, 1 << 60, *values, *[v + 1 for v in values]}), np.uint64)
    found = ef.find(asked)
    for v, i in zip(asked.tolist(), found.tolist()):
        assert (values[i] == v) if i >= 0 else v not in values


def test_elias_fano_random():
    rng = np.random.default_rng(0)
    for top in (10, 1000, 1 << 20, 1 << 45):
        values = np.unique(rng.integers(0, top, 5000, dtype=np.uint64))
        ef = lm.EliasFano(lm.EliasFano.build(values, ""), "")
        assert (ef.access(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        others = np.setdiff1d(rng.integers(0, top + 50, 5000, dtype=np.uint64), values)
        assert (ef.find(others) == -1).all()


def test_elias_fano_ranges():
    """Search between pointers in sequences that rise inside each range only."""
    rng = np.random.default_rng(1)
    for top, sizes in ((5, (0, 9)), (1000, (0, 40)), (1 << 30, (0, 3)), (1 << 20, (100, 900))):
        base, values, pointers = 0, [], [0]
        for _ in range(60):
            own = np.unique(rng.integers(0, top, rng.integers(*sizes))) + base
            values += own.tolist()
            pointers.append(len(values))
            base = values[-1] if values else 0
        ef, at = lm.EliasFano(lm.EliasFano.build(np.array(values, np.uint64), ""), ""), lm.EliasFano(lm.EliasFano.build(np.array(pointers), ""), "")
        begin, end = (x.astype(np.int64) for x in at.pairs(np.arange(60)))
        assert begin.tolist() == pointers[:-1] and end.tolist() == pointers[1:]
        which = rng.integers(0, 60, 4000)
        asked = np.array([int(rng.choice(values[a:b])) if a < b and rng.random() < 0.7 else int(rng.integers(0, base + top)) for a, b in zip(begin[which], end[which])], np.uint64)
        found = ef.find_in(asked, begin[which], end[which])
        for v, k, i in zip(asked.tolist(), which.tolist(), found.tolist()):
            own = values[pointers[k] : pointers[k + 1]]
            assert (values[i] == v and pointers[k] <= i < pointers[k + 1]) if i >= 0 else v not in own
