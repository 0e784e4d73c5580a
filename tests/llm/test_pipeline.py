"""Each stage against a plain version on its own input."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from fieldmark.llm.quality import COMMON_WORDS
from tests.llm.test_simhash import components, plain_fingerprint

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ int"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(COMMON_WORDS["en"][:20]) if rng.random() < 0.45 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n))
    item = prose(40)
    good = [prose(rng.randint(60, 200)) for _ in range(40)]
    secret = prose(60) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + prose(20)
    leaked = prose(60) + " " + item + " " + prose(30)
    junk = [None, "", "too short", "spam " * 300, " ".join(w + "%%%" for w in prose(150).split())]
    texts = [*good, secret, leaked, *junk, good[0], good[0] + " end", good[1].upper()]
    rows = [(i, t, "en", "s", len(t or ""), 0) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(90), None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        stages[name] = (docs.collect(), spark.read.parquet(f"{folder}/{name}").collect())
        docs = spark.read.parquet(f"{folder}/{name}")
    return {"folder": folder, "stages": stages, "good": good, "secret": secret, "leaked": leaked, "item": item}


def texts(rows):
    return [r.text for r in rows]


def test_stages_and_columns(world):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact_secrets", "pack"]
    for name in ("quality", "near_dedup", "decontaminate", "redact_secrets"):
        assert all(r.asDict().keys() == set(pipeline.COLUMNS) for r in world["stages"][name][1])


def test_quality(world):
    before, after = world["stages"]["quality"]
    kept = texts(after)
    assert all(t is not None and len(t.split()) >= 50 for t in kept)
    assert not any("%%%" in t or t.startswith("spam") for t in kept)
    assert all(kept.count(t) == texts(before).count(t) for t in [*world["good"], world["secret"], world["leaked"]])


def test_near_dedup(world):
    before, after = world["stages"]["near_dedup"]
    fps = [plain_fingerprint(r.text) for r in before]
    group = components([(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3], range(len(fps)))
    members = defaultdict(list)
    for i, r in enumerate(before):
        members[group[i]].append((r.doc_id, r.text))
    assert len(after) == len(members)
    left = [(r.doc_id, r.text) for r in after]
    assert all(sum(m in left for m in set(own)) == 1 for own in members.values())


def test_decontaminate(world):
    before, after = world["stages"]["decontaminate"]
    assert sorted(texts(after)) == sorted(t for t in texts(before) if world["item"] not in t)
    assert len(after) == len(before) - 1


def test_redact(world):
    before, after = world["stages"]["redact_secrets"]
    assert len(after) == len(before)
    assert not any("0123456789abcdef" in t for t in texts(after))
    changed = set(texts(after)) - set(texts(before))
    assert len(changed) == 1 and "[secret]" in next(iter(changed))
    assert all(r.n_chars == len(r.text) for r in after)


def test_pack(world):
    before, after = world["stages"]["pack"]
    assert sum(r.piece == 0 for r in after) == len(before)
    sums = defaultdict(int)
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sums[r.sequence_id]
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 4096


def test_clashing_columns(spark, world):
    """Columns whose names differ in case, or repeat, change nothing."""
    from pyspark.sql import functions as F

    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(world["stages"][name][0], SCHEMA if name == "quality" else SCHEMA.removesuffix(", row_ int"))
        odd = docs.select("doc_id", F.lit("x").alias("TEXT"), "text", F.lit("y").alias("Lang"), "lang", "source", "n_chars", F.lit(7).alias("gone_"), F.lit("z").alias("text"))
        order = lambda rows: sorted(map(str, rows))
        assert order(stage(spark, odd, world["folder"]).collect()) == order(stage(spark, docs, world["folder"]).collect()), name


def test_the_same_rows_go_whatever_the_splits(spark, world, monkeypatch):
    """The table is split differently each time that it is read."""
    path, sizes = f"{world['folder']}/quality", iter(range(1, 1000))
    wanted = {name: sorted(map(str, stage(spark, spark.read.parquet(path), world["folder"]).select("text").collect())) for name, stage in pipeline.STAGES[:3]}
    plain = pipeline.materialise

    def another_split(df, tag):
        out = plain(df, tag)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1000 * next(sizes)))
        return out

    monkeypatch.setattr(pipeline, "materialise", another_split)
    try:
        for name, stage in pipeline.STAGES[:3]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
            out = stage(spark, spark.read.parquet(path), world["folder"])
            spark.conf.set("spark.sql.files.maxPartitionBytes", "77777")
            assert sorted(map(str, out.select("text").collect())) == wanted[name], name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_gives_the_last_stage(spark, world):
    got = sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in pipeline.run(spark, world["folder"]).collect())
    assert got == sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in world["stages"]["pack"][1])


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
