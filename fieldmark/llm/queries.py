"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.decontaminate import TemplateRules
from fieldmark.llm.oracles import codes_sql, leaks_sql, licenses_sql, negatives_sql, quality_sql, repeats_sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.quality import judge

    rows = judge(documents(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.decontaminate import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), TemplateRules(inside=True))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir)).drop("blocks")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.secrets import find_secrets

    return find_secrets(documents(spark, sf_dir)).drop("found")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldmark.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.html import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.lm import score_documents

    return score_documents(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.negatives import mine

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", wrong), lambda vec_id: vec_id % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldmark.llm.codes import compress

    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldmark.llm.tokens import token_files

    return token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_html": op9_html,
    "op10_lm": op10_lm,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op2_repeats": repeats_sql(),
    "op3_quality": quality_sql(),
    "op4_decontamination": leaks_sql(TemplateRules(inside=True)),
    "op5_licenses": licenses_sql(),
    "op11_hard_negatives": negatives_sql(),
    "op12_vector_codes": codes_sql(),
}
