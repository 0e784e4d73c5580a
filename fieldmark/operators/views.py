"""Views that everything else reads, and monthly roll-ups. Dimensions are joined with plain joins, so their size decides the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import geo


def origin_class(means: Column) -> Column:
    """native, uncertain or alien by the checklist's wording; no wording means alien."""
    low = F.lower(means)
    return F.when(low.contains("native"), "native").when(low.contains("cryptogenic") | low.contains("uncertain"), "uncertain").otherwise("alien")


def with_origin(status: DataFrame) -> DataFrame:
    return status.withColumn("origin_class", origin_class(F.col("means")))


def zone_polygons(zones: DataFrame) -> DataFrame:
    """Zones with rings (a rectangle, or one without its north-east quarter), bounds and the latitude of the centre."""
    x, y = F.col("lon0"), F.col("lat0")
    p = lambda dx, dy: geo.point(x + dx, y + dy)
    box = F.array(p(0, 0), p(0.5, 0), p(0.5, 0.4), p(0, 0.4))
    corner = F.array(p(0, 0), p(0.5, 0), p(0.5, 0.2), p(0.25, 0.2), p(0.25, 0.4), p(0, 0.4))
    rings = F.array(F.when(F.col("is_corner"), corner).otherwise(box))
    return zones.withColumn("rings", rings).withColumn("bounds", geo.bounds(F.col("rings"))).withColumn("center_lat", geo.centroid_lat(F.col("rings")))


def researched_species(findings: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Species that a verified finding or management row backs."""
    return findings.filter("verified").select("species_id").union(playbooks.filter("verified").select("species_id")).distinct()


def alien_invasive(status: DataFrame) -> DataFrame:
    return with_origin(status).filter("is_invasive AND origin_class = 'alien'").select("species_id", "country")


def invasive_records(detections: DataFrame, zones: DataFrame, status: DataFrame, researched: DataFrame) -> DataFrame:
    """Detections of researched species that are alien and invasive in the zone's country."""
    dims = alien_invasive(status).join(researched, "species_id", "left_semi").join(zones.select(F.col("id").alias("zone_id"), "country"), "country")
    return detections.join(dims.select("zone_id", "species_id"), ["zone_id", "species_id"])


def zone_invasive_summary(records: DataFrame) -> DataFrame:
    """Per zone and species: records, first and last date, sources."""
    return records.groupBy("zone_id", "species_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.to_date(F.min("captured_at")).alias("first_record"),
        F.to_date(F.max("captured_at")).alias("last_record"),
        F.countDistinct("source_id").alias("sources"),
    )


def month(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", ts))


def effort_monthly(media: DataFrame) -> DataFrame:
    """Media per zone and month, with or without detections."""
    return media.filter("zone_id IS NOT NULL AND captured_at IS NOT NULL").groupBy("zone_id", month(F.col("captured_at")).alias("month")).agg(F.count(F.lit(1)).alias("effort"))


def _monthly(records: DataFrame, media: DataFrame) -> DataFrame:
    counts = records.groupBy("zone_id", "species_id", month(F.col("captured_at")).alias("month")).agg(F.count(F.lit(1)).alias("detections"))
    return counts.join(effort_monthly(media), ["zone_id", "month"]).withColumn("rate", F.try_divide(F.col("detections").cast("double"), F.col("effort")))


def invasion_index_monthly(detections: DataFrame, media: DataFrame, zones: DataFrame, status: DataFrame) -> DataFrame:
    """Detections of alien invasive species by month, researched or not, over the effort."""
    dims = alien_invasive(status).join(zones.select(F.col("id").alias("zone_id"), "country"), "country").select("zone_id", "species_id")
    return _monthly(detections.join(dims, ["zone_id", "species_id"]), media)


def native_trend_monthly(detections: DataFrame, media: DataFrame, zones: DataFrame, status: DataFrame) -> DataFrame:
    """The same for species without an alien or uncertain status in the country."""
    odd = with_origin(status).filter("origin_class IN ('alien', 'uncertain')").join(zones.select(F.col("id").alias("zone_id"), "country"), "country").select("zone_id", "species_id")
    return _monthly(detections.filter("species_id IS NOT NULL").join(odd, ["zone_id", "species_id"], "left_anti"), media)


def latest_run(runs: DataFrame) -> DataFrame:
    """The last finished run of each source, ties to the larger id; partial aggregation keeps one row of each source and task."""
    best = F.max_by(F.struct("id", "finished_at", "fetched"), F.struct("finished_at", "id")).alias("r")
    return runs.filter("finished_at IS NOT NULL").groupBy("source_id").agg(best).select("source_id", F.col("r.id").alias("run_id"), F.to_date("r.finished_at").alias("finished"), F.col("r.fetched").alias("fetched"))


def source_health(sources: DataFrame, media: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its stored media and last finished run, if any."""
    stored = media.groupBy("source_id").agg(F.count(F.lit(1)).alias("stored"))
    return (
        sources.select(F.col("id").alias("source_id"), "name")
        .join(stored, "source_id", "left")
        .join(latest_run(runs), "source_id", "left")
        .select("source_id", "name", F.coalesce("stored", F.lit(0)).alias("stored"), "run_id", "finished", "fetched")
    )


def record_classes(detections: DataFrame, zones: DataFrame, status: DataFrame) -> DataFrame:
    """Detections per zone by class: invasive, introduced (alien or uncertain) or native."""
    known = with_origin(status).select("species_id", "country", "is_invasive", "origin_class")
    kind = F.when(F.col("is_invasive") & (F.col("origin_class") == "alien"), "invasive").when(F.col("origin_class").isin("alien", "uncertain"), "introduced").otherwise("native")
    counts = detections.groupBy("zone_id", "species_id").agg(F.count(F.lit(1)).alias("n"))  # before the joins, which are by these keys
    return counts.join(zones.select(F.col("id").alias("zone_id"), "country"), "zone_id").join(known, ["species_id", "country"], "left").groupBy("zone_id", kind.alias("class")).agg(F.sum("n").alias("records"))
