"""Summaries: records by place, source and time, refusals, concentration, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First years of the periods after the first one.
PERIODS = (2010, 2020)


def records_by_park_source(detections: DataFrame) -> DataFrame:
    return detections.groupBy("zone_id", "source_id").agg(F.count(F.lit(1)).alias("records"), F.to_date(F.min("captured_at")).alias("earliest"), F.to_date(F.max("captured_at")).alias("latest"))


def records_by_year(detections: DataFrame) -> DataFrame:
    return detections.groupBy("zone_id", F.year("captured_at").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("records"))


def period(ts: Column, starts: tuple[int, ...] = PERIODS) -> Column:
    """The name of a date's period: "to 2009", "2010-2019", "2020 on" for the starts 2010 and 2020."""
    out = F.lit(f"{starts[-1]} on")
    for i in range(len(starts) - 1, -1, -1):
        out = F.when(F.year(ts) < starts[i], f"{starts[i - 1]}-{starts[i] - 1}" if i else f"to {starts[0] - 1}").otherwise(out)
    return out


def period_source_matrix(records: DataFrame, source_ids: list[int], starts: tuple[int, ...] = PERIODS) -> DataFrame:
    """Records by period, a column for each source; the sources are named, so no extra pass finds them."""
    out = records.groupBy(period(F.col("captured_at"), starts).alias("period")).pivot("source_id", source_ids).count()
    return out.select("period", *[F.coalesce(F.col(str(s)), F.lit(0)).alias(f"source_{s}") for s in source_ids])


def records_with_total(detections: DataFrame) -> DataFrame:
    """Records by zone and source with totals, by rollup; null stands for all."""
    return detections.rollup("zone_id", "source_id").agg(F.count(F.lit(1)).alias("records"), F.grouping_id().cast("long").alias("level"))


def refused_by_reason(runs: DataFrame, scanned_whole: list[int]) -> DataFrame:
    """Refusals by source and reason: of sources that are scanned whole only the largest run of each scope counts, of others all runs."""
    whole = F.col("source_id").isin(*scanned_whole)
    w = Window.partitionBy("source_id", "scope").orderBy(F.desc("fetched"), "id")
    largest = runs.filter(whole).withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
    return runs.filter(~whole).unionByName(largest).groupBy("source_id", "reason").agg(F.sum("refused").alias("refused"))


def hotspot_concentration(cells: DataFrame) -> DataFrame:
    """Per zone: squares, the busiest one, those with one record, and the share of records in the busiest tenth (one at least)."""
    w = Window.partitionBy("zone_id")
    ranked = cells.withColumn("place", F.row_number().over(w.orderBy(F.desc("records"), "cx", "cy"))).withColumn("cells", F.count(F.lit(1)).over(w))
    top = F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("cells") * F.lit(0.1)))
    return ranked.groupBy("zone_id").agg(
        F.max("cells").alias("cells"), F.max("records").alias("busiest"), F.count_if(F.col("records") == 1).alias("singletons"), F.sum("records").alias("records"),
        (F.sum(F.when(top, F.col("records"))) / F.sum("records").cast("double")).alias("top_share"),
    )


def evidence_coverage(summary: DataFrame, findings: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Per zone: recorded invasive species, and those with a verified finding, with one for the zone, with management rows."""
    any_ = findings.filter("verified").select("species_id").distinct().withColumn("any_finding", F.lit(True))
    here = findings.filter("verified AND zone_id IS NOT NULL").select("species_id", "zone_id").distinct().withColumn("here", F.lit(True))
    managed = playbooks.filter("verified").select("species_id").distinct().withColumn("managed", F.lit(True))
    df = summary.join(any_, "species_id", "left").join(here, ["species_id", "zone_id"], "left").join(managed, "species_id", "left")
    return df.groupBy("zone_id").agg(F.count(F.lit(1)).alias("species"), F.count_if("any_finding").alias("with_finding"), F.count_if("here").alias("documented_here"), F.count_if("managed").alias("with_management"), F.sum("records").alias("records"))


def evidence_table(findings: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Per species: distinct papers, findings and management rows."""
    a = findings.filter("verified").select("species_id", "doi", F.lit(1).alias("finding"), F.lit(0).alias("management"))
    b = playbooks.filter("verified").select("species_id", "doi", F.lit(0).alias("finding"), F.lit(1).alias("management"))
    return a.unionByName(b).groupBy("species_id").agg(F.countDistinct("doi").alias("papers"), F.sum("finding").alias("findings"), F.sum("management").alias("management"))


def knowledge_counts(findings: DataFrame, playbooks: DataFrame) -> DataFrame:
    a = findings.groupBy(F.lit("certainty").alias("kind"), F.col("certainty").alias("value"))
    b = playbooks.groupBy(F.lit("method").alias("kind"), F.col("method").alias("value"))
    n = (F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("verified"))
    return a.agg(*n).unionByName(b.agg(*n))


def distinct_papers(findings: DataFrame, playbooks: DataFrame) -> DataFrame:
    return findings.filter("verified").select("doi").unionByName(playbooks.filter("verified").select("doi")).agg(F.countDistinct("doi").alias("papers"))


def species_entries(species: DataFrame, findings: DataFrame, playbooks: DataFrame, summary: DataFrame) -> DataFrame:
    """Species with evidence or records: rows of evidence and records, a name for display."""
    rows = findings.filter("verified").select("species_id").unionAll(playbooks.filter("verified").select("species_id")).groupBy("species_id").agg(F.count(F.lit(1)).alias("evidence"))
    seen = summary.groupBy("species_id").agg(F.sum("records").alias("records"))
    df = rows.join(seen, "species_id", "full").join(species.select(F.col("id").alias("species_id"), "scientific_name", "common_name"), "species_id")
    return df.select("species_id", F.coalesce("common_name", "scientific_name").alias("name"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("records", F.lit(0)).alias("records"))


def not_recorded(researched: DataFrame, summary: DataFrame) -> DataFrame:
    """Researched species without a record."""
    return researched.join(summary, "species_id", "left_anti")


def bin_years(years: DataFrame, most: int = 4) -> DataFrame:
    """Records in bins of 1, 5 or 10 years, the first width of which ``most`` cover the span (10 if none), bins without records included."""
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).filter("a IS NOT NULL")
    years_ = F.col("b") - F.col("a") + 1
    width = F.when(years_ <= most, 1).when(years_ <= 5 * most, 5).otherwise(10)
    span = span.withColumn("width", width)
    bins = span.select("width", F.explode(F.sequence((F.floor(F.col("a") / F.col("width")) * F.col("width")).cast("long"), (F.floor(F.col("b") / F.col("width")) * F.col("width")).cast("long"), F.col("width").cast("long"))).alias("start"))
    n = years.crossJoin(F.broadcast(span.select("width"))).groupBy((F.floor(F.col("year") / F.col("width")) * F.col("width")).cast("long").alias("start")).agg(F.sum("records").alias("records"))
    return bins.join(n, "start", "left").select("start", F.col("width").cast("long").alias("width"), F.coalesce("records", F.lit(0)).alias("records"))


def period_shares(records: DataFrame, detections: DataFrame, starts: tuple[int, ...] = PERIODS) -> DataFrame:
    """Invasive records as a share of all by period."""
    a = records.groupBy(period(F.col("captured_at"), starts).alias("period")).agg(F.count(F.lit(1)).alias("invasive"))
    b = detections.groupBy(period(F.col("captured_at"), starts).alias("period")).agg(F.count(F.lit(1)).alias("records"))
    return b.join(a, "period", "left").select("period", "records", F.coalesce("invasive", F.lit(0)).alias("invasive"), (F.coalesce("invasive", F.lit(0)) / F.col("records").cast("double")).alias("share"))


def zones_needing_records(zones: DataFrame, media: DataFrame, most: int = 1000) -> DataFrame:
    """The zones with the fewest stored media, and their places; zones are few, so they fit in one task after the limit."""
    n = media.groupBy("zone_id").agg(F.count(F.lit(1)).alias("media"))
    df = zones.select(F.col("id").alias("zone_id")).join(n, "zone_id", "left").na.fill(0, ["media"]).orderBy("media", "zone_id").limit(most)
    return df.withColumn("place", F.row_number().over(Window.orderBy("media", "zone_id")).cast("long"))


def group_squares(cells: DataFrame) -> DataFrame:
    """Per zone: squares without invasive records, and those with some in one to three groups of like size by their share.

    Twelve squares make three groups and six make two; equal shares stay together, in the lower group.
    """
    some = cells.filter("invasive_records > 0")
    by = Window.partitionBy("zone_id")
    ranked = some.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("first", F.rank().over(by.orderBy("share")))
    parts = F.when(F.col("n") >= 12, 3).when(F.col("n") >= 6, 2).otherwise(1)
    ranked = ranked.withColumn("parts", parts)
    cut = lambda k: F.floor(F.col("n") * k / F.col("parts"))
    part = F.when(F.col("first") <= cut(1), 1).when((F.col("parts") <= 2) | (F.col("first") <= cut(2)), F.least(F.lit(2), F.col("parts"))).otherwise(3)
    groups = ranked.groupBy("zone_id", part.cast("long").alias("part"))
    none = cells.filter("invasive_records = 0").groupBy("zone_id", F.lit(0).cast("long").alias("part"))
    made = (F.count(F.lit(1)).alias("squares"), F.min("share").alias("low"), F.max("share").alias("high"), F.avg("richness").alias("richness"))
    return groups.agg(*made).unionByName(none.agg(*made))
