"""Other columns may have any name, that of a needed column in another case included."""

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import decontaminate, html, licenses, lm, packing, quality, repeats, secrets, sharding, simhash

P = pytest.importorskip("public_tokenizers")


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more", "en") for i in range(20)], "doc_id long, text string, lang string")
    odd = docs.select("doc_id", F.lit("x").alias("TEXT"), F.lit(1).alias("Doc_Id"), "text", "lang", F.lit("y").alias("text"), F.lit(0).alias("fp"), F.lit(0).alias("chunk_"))
    items = spark.createDataFrame([(1, "some words of text number 3 and more")], "item_id long, text string")
    runs = {
        "simhash": simhash.near_duplicates, "repeats": lambda d: repeats.remove_repeats(d, 16), "quality": quality.judge, "leaks": lambda d: decontaminate.find_leaks(d, items), "licenses": licenses.scan_licenses,
        "secrets": lambda d: secrets.find_secrets(d, carry=["lang"]), "packing": lambda d: packing.pack_documents(d, P.path("word_bpe_49k.json")), "sharding": sharding.shard_documents, "lm": lambda d: lm.score_documents(d),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(docs).collect())), name


def test_clashing_page_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x</p>")], "page_id long, url string, html string")
    odd = pages.select(F.lit("q").alias("URL"), "*", F.lit("z").alias("Html"), F.lit(0).alias("row_"))
    assert html.extract_text(odd).collect() == html.extract_text(pages).collect()
