"""Packing as a round trip, sharding by its laws."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldmark.llm import packing, sharding

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, shard string, length int"


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeiounsrtéÉXY漢", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "...", "'s", "%", "<|endoftext|>"])
    out = [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(120)]
    return [*out, None, "", " \n", "a\x1cb c", out[0], out[0], "İ ß. x", " ".join(word() for _ in range(3000)), "x " * 5000]


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    docs = texts()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(docs)], SCHEMA).repartition(3)
    rows = packing.pack_documents(df, path, capacity=512, bins=32).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(docs)))
    for i, t in enumerate(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(c := ids[a : a + 512]), zlib.crc32(np.array(c, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(sequences) <= -(-sum(r.length for r in rows) // 512) * 1.03 + 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_length_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 300
    counts = np.bincount(np.minimum(rng.geometric(0.02 if seed % 2 else 0.005, 3000), capacity), minlength=capacity + 1)
    recipes = packing.plan(counts, bins=24)
    used = np.zeros(capacity + 1, np.int64)
    for r in recipes:
        assert r.repeats > 0 and sum(length * n for length, n in r.parts) <= capacity
        for length, n in r.parts:
            used[length] += n * r.repeats
    assert (used == counts).all()
    total = int((counts * np.arange(capacity + 1)).sum())
    assert sum(r.repeats for r in recipes) <= -(-total // capacity) * 1.02 + 2


def test_least_squares():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    b = rng.random(12) * 10
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-3).all() and np.abs(gradient * x).max() < 1e-2


def test_packing_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0


def test_shards(spark):
    docs = [*texts(2), None, "é"]
    rows = [(i % 100, t, "clash", 0) for i, t in enumerate(docs)] + [(None, "x", "", 0), (None, "x", "", 0)]
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((False, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_have_the_highest_score(spark):
    """Every key against all shards, one by one, with hashes from another library."""
    import math
    import struct

    import xxhash

    def score(key, shard, weight):
        name = "" if key is None else str(key)
        h = xxhash.xxh64_intdigest(struct.pack("<q", shard), xxhash.xxh64_intdigest(name.encode(), 42))
        return -weight / math.log(((h >> 11) + 0.5) / 2**53)

    keys = [None, -5, 2**62, *range(3000)]
    df = spark.createDataFrame([(k, "x", "", 0) for k in keys], SCHEMA)
    for weights, grown in ((None, 1.0), ([1.0 + i % 5 for i in range(24)], 3.0)):
        w = weights or [1.0] * 24
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(df, weights=weights, grown_weight=grown).collect()}
        for k in keys:
            scores = [score(k, s, w[s]) for s in range(24)]
            best = max(range(24), key=scores.__getitem__)
            assert got[k] == (best, 24 if score(k, 24, grown) > scores[best] else best)


def test_weights_and_growth(spark):
    from pyspark.sql import functions as F

    keys = spark.range(40_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0])["shard"].alias("s"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0, 4.0])["shard"].alias("g"))
    n = {r.s: r["count"] for r in keys.groupBy("s").count().collect()}
    assert n[1] == pytest.approx(20_000, rel=0.05) and n[0] == pytest.approx(10_000, rel=0.07)
    assert keys.filter("s != g and g != 3").count() == 0
    assert keys.filter("s != g").count() == pytest.approx(20_000, rel=0.05)
