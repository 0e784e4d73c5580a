"""A corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and returns the columns of ``documents``; the
last returns packed pieces. Stages that drop rows number them first and write the numbers with the rows, once, so that what is judged
and what is dropped are the same rows however often and in whatever splits the table is read. Columns are taken by their exact names,
whatever others there are. No stage has SQL: fingerprints, entropies and tokens can't be written in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only
from fieldmark.llm.decontaminate import TemplateRules, find_leaks
from fieldmark.llm.packing import pack_documents
from fieldmark.llm.quality import judge
from fieldmark.llm.secrets import find_secrets
from fieldmark.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Row numbers to remove are broadcast up to so many (8 bytes each) and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def _numbered(docs: DataFrame, stage: str) -> DataFrame:
    """The columns of ``documents`` and row_, a number for each row, as a written table."""
    return materialise(only(docs, *COLUMNS).withColumn("row_", F.monotonically_increasing_id()), f"{stage}-rows").df


def _by_row(rows: DataFrame) -> DataFrame:
    """The rows with their numbers in place of doc_id, for the operators: repeated rows and null ids need no care there."""
    return rows.select(F.col("row_").alias("doc_id"), "text", "lang")


def _without(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows but for those of these numbers (column doc_id)."""
    gone = materialise(numbers.select(F.col("doc_id").alias("gone_")).distinct(), "gone").df
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, F.col("row_") == F.col("gone_"), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has too few words and goes; a null language is judged with all others that are unknown. Repeated rows are
    judged each for itself, alike. No rows: no rows.
    """
    rows = _numbered(docs, "quality")
    return _without(rows, judge(_by_row(rows)).filter(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, nulls last.

    Rows of one doc_id are put in order by a hash of their texts. Of repeated rows one stays. Null, empty and wordless texts are one group, of which one stays. No rows: no rows.
    """
    rows = _numbered(docs, "near_dedup")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "row_")
    found = near_duplicates(rows.select(order.alias("doc_id"), "text")).filter(F.col("doc_id") != F.col("component_id"))
    return _without(rows, found.select(F.col("doc_id.row_").alias("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    A null or empty text holds none and stays; repeated rows go or stay together. Without items, all rows stay. No rows: no rows.
    """
    rows = _numbered(docs, "decontaminate")
    return _without(rows, find_leaks(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), TemplateRules(inside=True)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew.

    A null text stays null and has no n_chars. Repeated rows are changed alike. No rows: no rows.
    """
    found = find_secrets(docs, redact="[secret]", carry=["lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences.

    A null or empty text is one piece, of its end alone. Repeated rows have pieces of their own. No rows: no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
