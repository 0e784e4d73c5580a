"""Readers that turn providers' records into one shape of observation, and checklists into species by country.

Each parser is a projection of typed JSON rows; rows without the essentials go. Timestamps are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.functions.text import canonical_name, short_licence
from fieldmark.operators.ingest import IMAGE_LICENCES

COMMUNITY = """id bigint, uri string, observed_on string, time_observed_at string, obscured boolean, captive boolean, license_code string, public_positional_accuracy double,
    geojson struct<type: string, coordinates: array<double>>,
    taxon struct<id: bigint, name: string, rank: string, iconic_taxon_name: string, preferred_common_name: string>,
    photos array<struct<license_code: string, url: string, original_dimensions: struct<width: int, height: int>>>"""
MUSEUM = """key bigint, datasetKey string, basisOfRecord string, scientificName string, species string, speciesKey bigint, taxonRank string, kingdom string, decimalLatitude double, decimalLongitude double,
    coordinateUncertaintyInMeters double, year int, month int, day int, license string, dataGeneralizations string, informationWithheld string, establishmentMeans string,
    media array<struct<type: string, identifier: string, license: string>>"""
AQUATIC = """key bigint, `group` string, genus string, species string, scientificName string, commonName string, decimalLatitude double, decimalLongitude double, latLongAccuracy string, status string,
    year int, month int, day int"""

# Kingdoms that a group's name may be, and metres for accuracy classes.
KINGDOMS = ("Plantae", "Fungi", "Protozoa", "Chromista")
ACCURACY_M = {"accurate": 100.0, "approximate": 10_000.0, "centroid": 50_000.0}

COLUMNS = "source external_id record_url taxon_name taxon_rank lat lon captured_at kingdom common_name image_url image_licence record_licence uncertainty_m obscured captive failed_introduction basis".split()


def _date(y: Column, m: Column, d: Column) -> Column:
    """Midnight of a whole, real date, else null."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd"))


def _image(url: Column, licence: Column) -> Column:
    """The address, if the licence lets the image be used."""
    return F.when(licence.isin(*IMAGE_LICENCES), url)


def _unified(df: DataFrame, source: str, essentials: Column, broken: bool, **columns: Column) -> DataFrame:
    """Rows in one shape; with ``broken`` those without the essentials too, with the column unparseable."""
    known = {"source": F.lit(source), "basis": F.lit("specimen"), "common_name": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string"), "image_licence": F.lit(None).cast("string"), "obscured": F.lit(False), "captive": F.lit(False), "failed_introduction": F.lit(False)} | columns
    good = F.coalesce(essentials, F.lit(False))
    if broken:
        return df.select(*[known[c].alias(c) for c in COLUMNS], (~good).alias("unparseable"))
    return df.filter(good).select(*[known[c].alias(c) for c in COLUMNS])


def community(raw: DataFrame, broken: bool = False) -> DataFrame:
    c = F.col
    photo = F.get(c("photos"), F.lit(0))
    licence = short_licence(photo["license_code"])
    iconic = c("taxon.iconic_taxon_name")
    return _unified(
        raw, "community", c("id").isNotNull() & (c("taxon.name") != "") & (F.size("geojson.coordinates") >= 2), broken,
        external_id=c("id").cast("string"), record_url=c("uri"), taxon_name=c("taxon.name"), taxon_rank=F.coalesce("taxon.rank", F.lit("")),
        lat=c("geojson.coordinates")[1], lon=c("geojson.coordinates")[0],
        captured_at=F.coalesce(F.try_to_timestamp("time_observed_at"), F.try_to_timestamp("observed_on", F.lit("yyyy-MM-dd"))),
        kingdom=F.when(iconic.isin(*KINGDOMS), iconic).when((iconic != "") & (iconic != "unknown"), "Animalia"),
        common_name=c("taxon.preferred_common_name"), image_url=_image(F.replace(photo["url"], F.lit("/square."), F.lit("/medium.")), licence), image_licence=licence,
        record_licence=short_licence(c("license_code")), uncertainty_m=c("public_positional_accuracy"), obscured=F.coalesce("obscured", F.lit(False)), captive=F.coalesce("captive", F.lit(False)),
    )


def museum(raw: DataFrame, mirrored_dataset: str | None = None, broken: bool = False) -> DataFrame:
    """``mirrored_dataset``: the key of a dataset that comes from another provider; its records have the basis "mirror"."""
    c = F.col
    photo = F.get(F.filter("media", lambda m: m["type"] == "StillImage"), F.lit(0))
    licence = short_licence(photo["license"])
    held = lambda n: F.coalesce(c(n), F.lit("")) != ""
    return _unified(
        raw, "museum", c("key").isNotNull() & c("decimalLatitude").isNotNull() & c("decimalLongitude").isNotNull(), broken,
        basis=F.when(c("datasetKey") == F.lit(mirrored_dataset), "mirror").when(c("basisOfRecord") == "PRESERVED_SPECIMEN", "specimen").otherwise(F.lower(F.coalesce("basisOfRecord", F.lit("unknown")))),
        external_id=c("key").cast("string"), record_url=F.concat(F.lit("occurrence/"), c("key")), taxon_name=F.coalesce(F.nullif("species", F.lit("")), "scientificName", F.lit("")),
        taxon_rank=F.when(c("speciesKey").isNotNull(), "species").otherwise(F.lower(F.coalesce("taxonRank", F.lit("")))), lat=c("decimalLatitude"), lon=c("decimalLongitude"),
        captured_at=_date(c("year"), c("month"), c("day")), kingdom=c("kingdom"), image_url=_image(photo["identifier"], licence), image_licence=licence, record_licence=short_licence(c("license")),
        uncertainty_m=c("coordinateUncertaintyInMeters"), obscured=held("dataGeneralizations") | held("informationWithheld"),
        captive=c("establishmentMeans").eqNullSafe(F.lit("MANAGED")) | c("basisOfRecord").eqNullSafe(F.lit("LIVING_SPECIMEN")),
    )


def aquatic(raw: DataFrame, broken: bool = False) -> DataFrame:
    c = F.col
    trimmed = lambda n: F.trim(F.coalesce(c(n), F.lit("")))
    metres = F.create_map(*[F.lit(x) for pair in ACCURACY_M.items() for x in pair])
    group = F.lower(F.coalesce("group", F.lit("")))
    return _unified(
        raw, "aquatic", c("key").isNotNull() & c("decimalLatitude").isNotNull() & c("decimalLongitude").isNotNull(), broken,
        external_id=c("key").cast("string"), record_url=F.concat(F.lit("specimen/"), c("key")),
        taxon_name=F.trim(F.coalesce(F.nullif("scientificName", F.lit("")), F.concat_ws(" ", trimmed("genus"), trimmed("species")))),
        taxon_rank=F.when((trimmed("genus") != "") & (trimmed("species") != ""), "species").otherwise(""), lat=c("decimalLatitude"), lon=c("decimalLongitude"),
        captured_at=_date(c("year"), c("month"), c("day")), kingdom=F.when(group.startswith("plant") | group.startswith("algae"), "Plantae").when(group != "", "Animalia"),
        common_name=F.nullif("commonName", F.lit("")), record_licence=F.lit("public domain"),
        uncertainty_m=F.coalesce(F.try_element_at(metres, F.lower(trimmed("latLongAccuracy"))), F.lit(ACCURACY_M["centroid"])), failed_introduction=F.lower(trimmed("status")) == "failed",
    )


def read_checklist(spark: SparkSession, folder: str) -> DataFrame:
    """A checklist of three tab-separated files without quotes: taxon, distribution, speciesprofile."""
    read = lambda name: spark.read.csv(f"{folder}/{name}.txt", sep="\t", header=True, quote="", escape="")
    return checklist(read("taxon"), read("distribution"), read("speciesprofile"))


def checklist(taxon: DataFrame, distribution: DataFrame, profile: DataFrame) -> DataFrame:
    """Name, kingdom, country, means and whether it is invasive (null: not said). Doubtful taxa go; countries have two letters.

    Of a taxon's rows for a country the first in the file counts, of its profiles the last.
    """
    place = lambda df: df.withColumn("line_", F.monotonically_increasing_id())
    d = place(distribution).withColumn("country", F.upper("countryCode")).filter(F.col("country").rlike("^[A-Z]{2}$"))
    first = Window.partitionBy("id", "country").orderBy("line_")
    d = d.withColumn("n_", F.row_number().over(first)).filter("n_ = 1")
    p = place(profile).groupBy("id").agg(F.max_by("isInvasive", "line_").alias("said"))
    said = F.lower(F.trim("said"))
    return (
        taxon.filter(F.upper(F.coalesce("taxonomicStatus", F.lit(""))) != "DOUBTFUL")
        .join(d.select("id", "country", "establishmentMeans", "occurrenceStatus"), "id")
        .join(p, "id", "left")
        .select(
            canonical_name(F.coalesce(F.nullif("acceptedNameUsage", F.lit("")), "scientificName")).alias("scientific_name"), "kingdom", "country", F.col("establishmentMeans").alias("means"),
            F.when(said == "invasive", True).when(said.startswith("not"), False).alias("is_invasive"),
        )
    )


def resolve_names(names: DataFrame, matches: DataFrame, least: int = 95) -> DataFrame:
    """Names with the accepted key of their match: exact ones, and fuzzy ones of enough confidence; others stay null."""
    good = (F.col("matchType") == "EXACT") | ((F.col("matchType") == "FUZZY") & (F.col("confidence") >= least))
    return names.join(matches.select("name", "kingdom", F.when(good, F.coalesce("acceptedUsageKey", "usageKey")).alias("taxon_key")), ["name", "kingdom"], "left")


def unresolved(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Names that were never asked for, so that none is asked for twice."""
    return names.distinct().join(matches.select("name", "kingdom"), ["name", "kingdom"], "left_anti")
