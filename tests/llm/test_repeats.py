"""Repeated strings against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldmark.llm import repeats, shards

SCHEMA = "doc_id long, text string, n_spans string"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, length):
    """Words in runs of that many words which also start at another place."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    data = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(fold)) if w] for t in texts]
    seen = Counter(tuple(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    return [len({j for i in range(len(d) - length + 1) if seen[tuple(d[i : i + length])] > 1 for j in range(i, i + length)}) for d in data]


def both(texts, length, words=51):
    return [(*a, b) for a, b in zip(plain(texts, length), passages(texts, words), strict=True)]


def corpus(seed):
    rng = random.Random(seed)
    words = ["sea", "Öl", "of", "deep", "water", "x", "long-ish", "的", "a1"]
    text = lambda k: " ".join(rng.choices(words, k=k)) + str(rng.random())
    shared = [text(60) for _ in range(4)]
    out = []
    for _ in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a, b = sorted(rng.sample(range(len(s)), 2))
            parts += [s[a:b], text(rng.randint(0, 30))]
        out.append("".join(parts))
    for _ in range(25):  # near copies
        t = list(out[0])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abc")
        out.append("".join(t))
    return [*out, out[1], out[1], None, "", "a" * 400, "ab" * 150, "c", shared[0]]


@pytest.mark.parametrize("length", [8, 31, 33, 64, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_removal(spark, length, seed, monkeypatch):
    texts = corpus(seed)
    df = spark.createDataFrame([(i % 50, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    words = 8 + length % 5
    want = Counter((i % 50, *w) for i, w in enumerate(both(texts, length, words)))
    assert Counter(map(tuple, repeats.remove_repeats(df, length, words).collect())) == want


def test_full_length(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=3000))
    texts = [base, base[500:1100] + "x" * 20, base[:399], base[:400], base[1000:1399] + "Q" + base[1400:2300], "".join(rng.choices("ab", k=2000))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}
    assert got == dict(enumerate(both(texts, 400)))


def test_crowded_cores_long_texts_and_many_shards(spark, monkeypatch):
    import pyspark.cloudpickle as cp
    monkeypatch.setattr(repeats, "CROWD", 3)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", 5)
    cp.register_pickle_by_value(repeats)
    try:
        texts = corpus(7)
        df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA).repartition(2)
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, 64, 9).collect()}
    finally:
        cp.unregister_pickle_by_value(repeats)
    assert got == dict(enumerate(both(texts, 64, 9)))


def test_near_copy_of_exact_copies_in_a_crowded_core(spark, monkeypatch):
    import pyspark.cloudpickle as cp

    monkeypatch.setattr(repeats, "CROWD", 3)
    cp.register_pickle_by_value(repeats)
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcdefghij", k=k))
    base = text(300)
    near = [base[:k] + "#" + base[k + 1 :] for k in (170, 172)]
    texts = [base, base, near[rng.randint(0, 1)], *[text(50) + base[100:163] + text(50) for _ in range(8)]]
    try:
        df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(df, 64, 9).collect()}
    finally:
        cp.unregister_pickle_by_value(repeats)
    assert got == dict(enumerate(both(texts, 64, 9)))


def test_a_line_in_more_contexts_than_are_sorted_together(spark):
    """The real limits: a line of 380 bytes stands in over 10,000 different contexts, and some share more of them."""
    rng = random.Random(3)
    text = lambda k: "".join(rng.choices("abcdefghij klmnop", k=k))
    line, tails = text(380), [text(40) for _ in range(200)]
    texts = [text(60) + line + rng.choice(tails) + text(30) for _ in range(repeats.CROWD + 500)]
    got = {r[0]: tuple(r)[1:5] for r in repeats.remove_repeats(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == dict(enumerate(plain(texts, 400)))
    assert sum(x[1] > 0 for x in got.values()) > repeats.CROWD


def test_copies_need_no_sorting(spark, monkeypatch):
    """Cores all of whose contexts stand twice are known without the transform."""
    import pyspark.cloudpickle as cp

    def solve(contexts, core, block):
        assert not contexts
        return []

    monkeypatch.setattr(repeats, "solve", solve)
    cp.register_pickle_by_value(repeats)
    rng = random.Random(4)
    texts = [" ".join(str(rng.random()) for _ in range(40)) for _ in range(5)] * 2
    try:
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA), 64, 9).collect()}
    finally:
        cp.unregister_pickle_by_value(repeats)
    assert got == dict(enumerate(both(texts, 64, 9)))


@pytest.mark.parametrize("words", [False, True])
def test_runs_do_not_depend_on_tiles(monkeypatch, words):
    texts = [(t or "").encode() for t in corpus(3)]
    w = repeats.Windows(9 if words else 64, words)
    runs = lambda: [repeats.runs_of(p.text, p.ends, w) for p in repeats.pieces_of(texts, w)]
    whole = runs()
    monkeypatch.setattr(repeats, "TILE", 50)
    monkeypatch.setattr(shards, "TILE", 7)
    assert all(np.array_equal(x, y) for a, b in zip(whole, runs(), strict=True) for x, y in zip(a, b, strict=True))
    assert sum(len(r.first) for r in whole) > 100
    for r in whole:  # a core starts in its windows' first block and lies in all of them
        assert (r.first <= r.last).all() and (r.core_at - r.first < w.block).all() and (r.last <= r.core_at).all() and (r.first[1:] > r.last[:-1]).all()


def test_a_lost_file_is_an_error(spark):
    df = repeats.materialise(spark.createDataFrame([(1, "0123456789abc" * 3, 0)], "doc_id long, text string, part_ int"), "texts").df
    found = repeats.find_repeats(df, repeats.Windows(8))
    found.folder += "-gone"
    with pytest.raises(FileNotFoundError):
        found.of(0)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "0123456789abc", None), (2, "x0123456789y", None)], SCHEMA)
    assert {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df, 8, keep_text=True).collect()} == {1: b"abc", 2: b"xy"}


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    codes = np.concatenate([np.append(rng.integers(1, 3 + seed, rng.integers(1, 60)), 0) for _ in range(30)])
    for length in (1, 2, 5, 9):
        got = repeats.repeated_places(codes, length)
        whole = [i for i in range(len(codes) - length + 1) if 0 not in codes[i : i + length]]
        seen = Counter(tuple(codes[i : i + length]) for i in whole)
        assert all(got[i] == (seen[tuple(codes[i : i + length])] > 1) for i in whole)
