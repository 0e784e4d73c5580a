"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import discard, materialise


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node that a link of (a, b) names; root is the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest one, then every node and its smaller neighbours on the
    smallest of these. It ends when no link changes: links are then stars around the roots. Smallest neighbours are taken with
    map-side aggregation, and joins against them can be split where a node has many links. Each round is written to the
    shared folder and the one before it deleted. Links with a null end are left out.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    now = materialise(links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    seen = _mark(now.df)
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(lower, F.col("u") == F.col("x")).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(lower.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), tag)
        mark = _mark(new.df)
        discard(spark, now.path)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """The number of links and a checksum that doesn't depend on their order."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h)).first())
