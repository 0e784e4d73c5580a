"""Token ids in ORC files: round trips, order, stripes, pruning."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import packing, queries, tokens

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def plain(rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(text)
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    df = queries.QUERIES["op13_token_files"](spark, sf)
    assert df.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert found(df) == plain(rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_texts(spark, partitions):
    rows = [(5, None), (3, ""), (-4, "<|endoftext|> is text"), (9, "  \n "), (2**40, "Ünïcödé 中文 🙂 word"), (None, "no id"), (7, "one two " * 50_000), (8, "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert found(tokens.token_files(df, TOKENIZER)) == plain(rows)


def test_shared_ids_and_repeated_rows(spark):
    rows = [(1, f"text {i % 3} of id one") for i in range(40)] + [(0, "before"), (2, "after")]
    got = found(tokens.token_files(spark.createDataFrame(rows, SCHEMA).repartition(5), TOKENIZER))
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((i, n, c) for i, _, n, c in plain(rows))
    assert [r[0] for r in got] == [0, *[1] * 40, 2]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_no_rows_and_clashing_columns(spark):
    assert tokens.token_files(spark.createDataFrame([], SCHEMA), TOKENIZER).collect() == []
    rows = [(i, f"some text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("doc_id", F.lit("x").alias("Text"), F.lit(1).alias("row_"), "text", F.lit(2).alias("part"), F.lit(3).alias("DOC_ID"))
    assert found(tokens.token_files(odd, TOKENIZER)) == found(tokens.token_files(df, TOKENIZER)) == plain(rows)


def test_starts_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 3)
    sizes = [(p, at, 10 * p + at) for p in range(11) if p != 4 for at in range(0, 30, 10)]
    rows = spark.createDataFrame([(p, at, n) for p, at, n in sizes], "part int, at long, n_tokens int")
    last = {p: at + n for p, at, n in sizes}
    assert {r["part_"]: r["before_"] for r in tokens.starts_of_parts(rows).collect()} == {p: sum(x for q, x in last.items() if q < p) for p in last}


def test_words_are_asked_once(monkeypatch):
    """Words that come again stay known past the limit, with any punctuation behind them, and all ids are the tokenizer's."""
    asked, ask = [], packing.WordIds.ask
    monkeypatch.setattr(packing, "KNOWN_WORDS", 1000)
    monkeypatch.setattr(packing.WordIds, "ask", lambda self, words: asked.extend(words.to_pylist()) or ask(self, words))
    known = packing.WordIds(TOKENIZER, 1)
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    common = [*map(name, range(200)), "don't", "3.14", "éß", "É", "漢字", "=\u0338"]
    for turn in range(30):
        rare = [name(1000 + 100 * turn + i) for i in range(100)]
        texts = [None, "", " ".join(f"{w}{'.,;!***'[turn % 7]}" for w in common), f"  {' '.join(rare)}\n{common[turn].upper()}?!"]
        assert known.of_all(pa.array(texts)).to_pylist() == [ids_of(t).tolist() for t in texts]
        assert len(known.hash) <= 1000 == packing.KNOWN_WORDS
    assert len(asked) <= 30 * 100 + 200 + 100
    assert max(map(asked.count, common[:200])) == 1


def test_stripes_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.permutation(100_000)[:20_000] * 1_000
    df = spark.createDataFrame([(int(i), f"w{i} " + "some words " * 40) for i in ids], SCHEMA)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(df.repartition(3), TOKENIZER, path, stripe_bytes=64 << 10, index_rows=1000)
    files = sorted((tmp_path / "tokens").glob("*.orc"), key=lambda f: int(f.name.split("-")[1]))
    stored, stripes = [], 0
    for f in files:
        file = orc.ORCFile(f)
        stripes += file.nstripes
        assert file.row_index_stride == 1000
        stored += file.read(columns=["doc_id"]).column(0).to_pylist()
    assert stored == sorted(ids.tolist()) and stripes > len(files)

    def read(wanted):
        got = tokens.read_tokens(spark, path, wanted)
        rows = got.select("doc_id", "ids").collect()
        plan = got._jdf.queryExecution().executedPlan()
        got._jdf.queryExecution().toRdd().count()
        scans = [plan]
        while not scans[-1].nodeName().startswith("Scan"):
            scans.append(scans[-1].children().head())
        return rows, scans[-1].metrics().apply("numOutputRows").value()

    wanted = int(sorted(ids.tolist())[4_321])
    rows, seen = read([wanted])
    assert [(r["doc_id"], r["ids"]) for r in rows] == [(wanted, ids_of(f"w{wanted} " + "some words " * 40).tolist())]
    assert seen <= 1000  # the one index entry that can hold it
    inside = next(i for i in range(4_000_000, 10**8, 1000) if i not in set(ids.tolist()))
    _, absent = read([inside])
    assert absent == 0  # within an entry's bounds: the Bloom filter tells
    whole = {r["doc_id"] for r in tokens.read_tokens(spark, path).select("doc_id").collect()}
    assert whole == set(ids.tolist())


def test_files_are_split_by_stripes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{i} " + "many different words " * 100) for i in range(3_000)], SCHEMA).coalesce(1)
    path = str(tmp_path / "tokens")
    tokens.write_tokens(df, TOKENIZER, path, stripe_bytes=16 << 10)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "8192")
        rows = tokens.read_tokens(spark, path)
        assert rows.rdd.getNumPartitions() > len(list((tmp_path / "tokens").glob("*.orc")))
        assert found(tokens.checksums(rows).select("doc_id", "at", "n_tokens", "ids_crc32")) and rows.count() == 3_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
