"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from fieldmark.llm import simhash
from fieldmark.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \t", "One", "ÉCOLE b", "a b c", "A\x0bb\x0cc d", "x\x1cy z", "a " * 700, *[" ".join(rng.choices("abcdeÖ漢", k=rng.randint(1, 400))) for _ in range(40)]]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_groups(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.randint(80, 200)) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 15)):
            t = list(b)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), None, "", "  ", "one", "two words"]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    near = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = {(i, f"{fps[i]:016x}", c) for i, c in components(near, fps).items()}
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    near = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3]
    assert components(links, fps) == components(near, fps)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d", None), (5, "a b c d", None), (None, "a b c d", 1), (None, "lonely words here now", 1)]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert sorted(((r[0], r[2]) for r in got), key=str) == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 700)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert got == components(real, {x for p in real for x in p})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
