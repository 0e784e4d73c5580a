"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, numbered, only, with_chunk


def score(key: Column, shard: Column, weight: Column) -> Column:
    """``-weight / ln(u)``, u in (0, 1) from a hash of the key's text and the shard's number; a null key counts as ""."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    u = (F.shiftrightunsigned(F.xxhash64(name, shard.cast("long")), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -weight / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the shard with the highest score; only the key and the shards' weights decide.

    One shard more takes a key only if its own score is the highest: about ``w_new / sum(w)`` of the keys move, all into it.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    w = F.array(*[F.lit(float(x)) for x in weights])
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_max(F.transform(shards, lambda s: F.struct(score(key, s, F.element_at(w, s + 1)).alias("score"), s.alias("shard"))))


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Put every document into a shard by its doc_id, with its place there and the shard it would have with one shard more.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ("key"), shard, slot (gapless from 0 in each shard) and
    grown_shard. A null text has size 8 and the checksum of no bytes; a null doc_id is the key ""; repeated rows get slots of
    their own. Equal texts stay together only where they share a doc_id, for only the key decides. Other columns are ignored.
    No rows: no rows.
    """
    now = [1.0] * n_shards if weights is None else list(weights)
    if len(now) != n_shards:
        raise ValueError("one weight for each shard is needed")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), now).alias("best_"),
        score(F.col("doc_id"), F.lit(n_shards), F.lit(float(grown_weight))).alias("grown_"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("best_.shard").alias("shard"),
        F.when(F.col("grown_") > F.col("best_.score"), F.lit(n_shards)).otherwise(F.col("best_.shard")).alias("grown_shard"),
    )
    written = materialise(with_chunk(rows), "shards").df
    return numbered(written, "shard", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
