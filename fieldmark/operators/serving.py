"""Queries with parameters: hotspot grids, counts by year, profiles, searches. A parameter left out adds no predicate to the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import geo

MAX_ROWS = 500


def _named(records: DataFrame, species: DataFrame, sources: DataFrame) -> DataFrame:
    sp = species.select(F.col("id").alias("species_id"), "scientific_name", "common_name", "kingdom")
    return records.join(sp, "species_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")


def grid_points(
    records: DataFrame, polygons: DataFrame, species: DataFrame, sources: DataFrame, *, zone: str | None = None, km: float | None = None,
    name: str | None = None, source_names: str | None = None, year_from: int | None = None, year_to: int | None = None, kingdom: str | None = None,
) -> DataFrame:
    """Records with their square: ``km`` (0.5 to 50, 2 if not given) is true at the latitude of the zone's centre."""
    size = max(0.5, min(2.0 if km is None else float(km), 50.0))
    z = polygons.select(F.col("id").alias("zone_id"), "slug", "center_lat")
    if zone is not None:
        z = z.filter(F.col("slug") == zone)
    df = _named(records, species, sources)
    for value, test in (
        (name, F.col("scientific_name") == name),
        (source_names, F.col("source").isin(*(source_names or "").split(","))),
        (year_from, F.col("captured_at") >= F.make_date(F.lit(year_from or 1), F.lit(1), F.lit(1))),
        (year_to, F.col("captured_at") < F.make_date(F.lit((year_to or 1) + 1), F.lit(1), F.lit(1))),
        (kingdom, F.col("kingdom") == kingdom),
    ):
        df = df.filter(test) if value is not None else df
    dlon, dlat = geo.grid_steps(F.lit(size), F.col("center_lat"))
    df = df.join(z, "zone_id").withColumn("dlon", dlon).withColumn("dlat", dlat).withColumn("year", F.year("captured_at"))
    return df.withColumn("cx", F.floor(F.col("lon") / F.col("dlon")).cast("int")).withColumn("cy", F.floor(F.col("lat") / F.col("dlat")).cast("int"))


CELL = ["zone_id", "cx", "cy"]


def hotspot_grid(points: DataFrame) -> DataFrame:
    """One row per square with its bounds, records and species, and arrays of species, years and sources.

    Points are first summed by square, species, year and source; the lists of a square are made from those few rows.
    """
    n = points.groupBy(*CELL, "dlon", "dlat", "species_id", "scientific_name", "common_name", "kingdom", "year", "source").agg(F.count(F.lit(1)).alias("n"))
    species = n.groupBy(*CELL, "dlon", "dlat", "species_id", "scientific_name", "common_name", "kingdom").agg(F.sum("n").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    item = F.struct((-F.col("records")).alias("order"), F.col("scientific_name").alias("name"), "common_name", "kingdom", "records", "first_year", "last_year")
    cells = species.groupBy(*CELL, "dlon", "dlat").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("species_count"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("order")).alias("species"))
    years = n.groupBy(*CELL, "year").agg(F.sum("n").alias("n")).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("by_year"))
    sources = n.groupBy(*CELL, "source").agg(F.sum("n").alias("n")).groupBy(*CELL).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    x, y = F.col("cx"), F.col("cy")
    edges = ((x * F.col("dlon")).alias("west"), (y * F.col("dlat")).alias("south"), ((x + 1) * F.col("dlon")).alias("east"), ((y + 1) * F.col("dlat")).alias("north"))
    return cells.join(years, CELL).join(sources, CELL).select(*CELL, *edges, "records", "species_count", "species", "by_year", "by_source")


def rank_species(cells: DataFrame) -> DataFrame:
    """The species of all squares of a zone together."""
    s = cells.select("zone_id", F.explode("species").alias("s")).select("zone_id", "s.*")
    return s.groupBy("zone_id", "name").agg(F.sum("records").alias("records"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))


def cells_in_view(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Squares whose middle lies in a rectangle, edges included."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return cells.filter(x.between(west, east) & y.between(south, north))


def invasive_by_year(records: DataFrame, zone_id: int | None = None, species_id: int | None = None) -> DataFrame:
    df = records
    if zone_id is not None:
        df = df.filter(F.col("zone_id") == zone_id)
    if species_id is not None:
        df = df.filter(F.col("species_id") == species_id)
    return df.groupBy(F.year("captured_at").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("records"))


def species_profile(records: DataFrame) -> DataFrame:
    """Per species its total and the counts by zone, by year and by source, in one pass with grouping sets."""
    df = records.withColumn("year", F.year("captured_at").cast("long"))
    sets = df.groupingSets([["species_id"], ["species_id", "zone_id"], ["species_id", "year"], ["species_id", "source_id"]], "species_id", "zone_id", "year", "source_id")
    out = sets.agg(F.count(F.lit(1)).alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 0b0111, "total").when(F.col("g") == 0b0011, "zone").when(F.col("g") == 0b0101, "year").otherwise("source")
    return out.select("species_id", kind.alias("part"), F.coalesce(F.col("zone_id").cast("long"), F.col("year"), F.col("source_id").cast("long")).alias("key"), "records", "first_year", "last_year")


def zones_overview(polygons: DataFrame, detections: DataFrame, records: DataFrame, media: DataFrame) -> DataFrame:
    """Every zone with its bounds and four counts, zeros where there is nothing."""
    parts = [
        media.groupBy("zone_id").agg(F.count(F.lit(1)).alias("media")),
        detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("species_id").alias("species")),
        records.groupBy("zone_id").agg(F.count(F.lit(1)).alias("invasive_records")),
    ]
    df = polygons.select(F.col("id").alias("zone_id"), "slug", "bounds.*", geo.area_km2(F.col("rings")).alias("area_km2"))
    for part in parts:
        df = df.join(part, "zone_id", "left")
    return df.na.fill(0, ["media", "detections", "species", "invasive_records"])


def clamp_limit(limit: int) -> int:
    return min(max(limit, 1), MAX_ROWS)


def search_records(detections: DataFrame, species: DataFrame, *, name: str | None = None, since: str | None = None, until: str | None = None, least: float | None = None, limit: int = 50) -> DataFrame:
    """Records of a species by either name in any case, in a half-open time span, newest first with a full order of ties."""
    df = detections.join(species.select(F.col("id").alias("species_id"), "scientific_name", "common_name"), "species_id")
    if name is not None:
        df = df.filter((F.lower("scientific_name") == name.lower()) | (F.lower("common_name") == name.lower()))
    if since is not None:
        df = df.filter(F.col("captured_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.filter(F.col("captured_at") < F.lit(until).cast("timestamp_ntz"))
    if least is not None:
        df = df.filter(F.col("confidence") >= least)
    order = [F.desc("captured_at"), "media_id", "species_id", "confidence", "origin"]
    return df.select("media_id", "species_id", "scientific_name", F.to_date("captured_at").alias("day"), "captured_at", "zone_id", "confidence", "origin").orderBy(*order).limit(clamp_limit(limit)).drop("captured_at")


def search_species(species: DataFrame, status: DataFrame, *, text: str | None = None, country: str = "IN", invasive_only: bool = False) -> DataFrame:
    """Species by part of a name; is_invasive is null where the country has no status for it."""
    flag = status.filter(F.col("country") == country).select(F.col("species_id").alias("id"), (F.col("is_invasive") & (F.col("origin_class") == "alien")).alias("is_invasive"))
    df = species.join(flag, "id", "left")
    if text is not None:
        df = df.filter(F.lower("scientific_name").contains(text.lower()) | F.lower("common_name").contains(text.lower()))
    if invasive_only:
        df = df.filter("is_invasive")
    return df.select("id", "scientific_name", "common_name", "kingdom", "is_invasive")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a full order: planned as a bounded heap for each task, not a sort of everything."""
    return df.orderBy(*order).limit(n)
