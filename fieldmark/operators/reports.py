"""Lists in their order, tables for reports, gates of the statistics, and the outcome of every observation of an ingest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import geo
from fieldmark.operators import analytics, ingest

MAX_POINTS, MAX_BOXES = 400, 300


def placed(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """Each row's place from 1 within its group, in a full order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_placed(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of a full order and their places; n is small, so only they meet in one task."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


# --- lists ------------------------------------------------------------------------------------------------------------------------


def alerts_list(alerts: DataFrame, zones: DataFrame, species: DataFrame, *, zone: str | None = None, severity: str | None = None, limit: int = 50) -> DataFrame:
    """Alerts newest first; ties by zone and species."""
    df = alerts.join(zones.select(F.col("id").alias("zone_id"), "slug"), "zone_id").join(species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id")
    for column, wanted in (("slug", zone), ("severity", severity)):
        df = df.filter(F.col(column) == wanted) if wanted is not None else df
    return top_placed(df.select("slug", "scientific_name", "first_record", "severity"), min(max(limit, 1), 500), F.desc("first_record"), "slug", "scientific_name")


def playbooks_in_order(playbooks: DataFrame, species: DataFrame) -> DataFrame:
    """Verified management rows; the place is that within the species, by method, and species follow by name."""
    df = playbooks.filter("verified").join(species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id")
    return placed(df.select("scientific_name", "method", "design", "doi"), ["scientific_name"], "method", "doi", "design").orderBy("scientific_name", "place")


def findings_in_order(findings: DataFrame, summary: DataFrame, species: DataFrame) -> DataFrame:
    """Findings of each zone: its own first, then general ones; by species and type."""
    parts = [analytics.documented_findings(findings.filter(test), summary).withColumn("general", F.lit(general)) for test, general in (("zone_id IS NOT NULL", False), ("zone_id IS NULL", True))]
    df = parts[0].unionByName(parts[1]).join(species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id")
    return placed(df.select("zone_id", "general", "scientific_name", "finding_type", "certainty", "doi", "records", "recorded"), ["zone_id"], "general", "scientific_name", "finding_type", "doi")


def invasive_in_order(summary: DataFrame, species: DataFrame) -> DataFrame:
    """Invasive species of each zone, most records first, then by name, with the years of their records."""
    df = summary.join(species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id")
    df = df.select("zone_id", "scientific_name", "records", F.year("first_record").cast("long").alias("first_year"), F.year("last_record").cast("long").alias("last_year"))
    return placed(df, ["zone_id"], F.desc("records"), "scientific_name")


def species_without_photo(species: DataFrame, summary: DataFrame, pictured: DataFrame, n: int) -> DataFrame:
    """The species with the most invasive records that no photo shows yet; ties by id."""
    counts = summary.groupBy("species_id").agg(F.sum("records").alias("records"))
    df = species.select(F.col("id").alias("species_id"), "scientific_name").join(pictured.select("species_id"), "species_id", "left_anti").join(counts, "species_id")
    return top_placed(df, n, F.desc("records"), "species_id")


def scatter_points(cells: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Squares of each zone for plotting, those with the most invasive records first; shares to 4 places, richness to 3."""
    usable = cells.filter("richness IS NOT NULL").withColumn("share", F.col("invasive_records") / F.col("all_records").cast("double"))
    df = placed(usable, ["zone_id"], F.desc("invasive_records"), "cx", "cy").filter(F.col("place") <= most)
    return df.select("zone_id", "place", F.round("share", 4).alias("share"), F.round("richness", 3).alias("richness"), "all_records")


def best_boxes(boxes: DataFrame, most: int = MAX_BOXES) -> DataFrame:
    """The most confident boxes of each image; ties by box."""
    return placed(boxes.select("image", "box", "label", "score"), ["image"], F.desc("score"), "box").filter(F.col("place") <= most)


def top_classes(rows: DataFrame, key: str, probabilities: str, k: int = 3) -> DataFrame:
    """The k most probable classes of each row, as rows; ties by class."""
    order = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("order"), i.cast("long").alias("label"))))
    return rows.select(key, F.posexplode(F.slice(order, 1, k)).alias("at", "x")).select(key, (F.col("at") + 1).cast("long").alias("place"), "x.label", (-F.col("x.order")).alias("probability"))


def evidence_ranking(findings: DataFrame, playbooks: DataFrame, species: DataFrame, n: int = 50) -> DataFrame:
    """Species by distinct papers, then by name, with findings, management rows and the designs of all rows."""
    a = findings.filter("verified").select("species_id", "doi", F.lit("finding").alias("kind"), F.col("certainty").alias("design"))
    b = playbooks.filter("verified").select("species_id", "doi", F.lit("management").alias("kind"), "design")
    designs = ("experimental", "observational", "review", "modelled")
    counts = a.unionByName(b).groupBy("species_id").agg(F.countDistinct("doi").alias("papers"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("finding", "management")], *[F.count_if(F.col("design") == d).alias(d) for d in designs])
    return top_placed(counts.join(species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id").drop("species_id"), n, F.desc("papers"), "scientific_name")


def busiest_park(records: DataFrame, zones: DataFrame) -> DataFrame:
    """The park with the most invasive records; the first by name of equals."""
    counts = records.groupBy("zone_id").agg(F.count(F.lit(1)).alias("records")).join(zones.select(F.col("id").alias("zone_id"), "slug"), "zone_id")
    return counts.orderBy(F.desc("records"), "slug").limit(1).select("slug", "records")


# --- tables -----------------------------------------------------------------------------------------------------------------------


def totals_of(cells: DataFrame, kind: str) -> DataFrame:
    """Records of all squares of a zone by year or by source, from the squares' own lists (by_year, by_source)."""
    if kind == "year":
        rows = cells.select("zone_id", F.explode("by_year").alias("y")).select("zone_id", F.col("y.year").cast("long").alias("year"), F.col("y.n").alias("n"))
    else:
        rows = cells.select("zone_id", F.explode("by_source").alias("source", "n"))
    return rows.groupBy("zone_id", kind).agg(F.sum("n").alias("records"))


def refused_table(refused: DataFrame, sources: list[int]) -> DataFrame:
    """Refusals, a row for each reason and a column for each source, with the order by their sum; reasons are few and fixed."""
    wide = refused.groupBy("reason").pivot("source_id", sources).agg(F.sum("refused"))
    wide = wide.select("reason", *[F.coalesce(F.col(str(s)), F.lit(0)).alias(f"source_{s}") for s in sources])
    total = F.lit(0).cast("long")
    for s in sources:
        total = total + F.col(f"source_{s}")
    return wide.withColumn("total", total).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "reason")))


def invasive_shares(zones: DataFrame, detections: DataFrame, records: DataFrame) -> DataFrame:
    """Per park: records, invasive ones, their percentage (null without records) and species."""
    a = detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("records"))
    b = records.groupBy("zone_id").agg(F.count(F.lit(1)).alias("invasive"), F.countDistinct("species_id").alias("species"))
    df = zones.select(F.col("id").alias("zone_id"), "slug").join(a, "zone_id", "left").join(b, "zone_id", "left").na.fill(0, ["records", "invasive", "species"])
    return df.select("slug", "records", "invasive", F.round(F.try_divide(100.0 * F.col("invasive"), F.col("records")), 1).alias("percent"), "species")


def covered_shares(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Per zone: invasive records of species with a verified finding, in percent of all invasive ones."""
    backed = findings.filter("verified").select("species_id").distinct().withColumn("backed", F.lit(True))
    df = summary.join(backed, "species_id", "left").groupBy("zone_id").agg(F.sum("records").alias("records"), F.coalesce(F.sum(F.when(F.col("backed"), F.col("records"))), F.lit(0)).alias("covered"))
    return df.withColumn("percent", F.round(F.try_divide(100.0 * F.col("covered"), F.col("records")), 0))


def capped_parks(detections: DataFrame, cap: int = 8000) -> DataFrame:
    """Parks and sources whose records reached the storage cap, with the date of the latest."""
    return detections.groupBy("zone_id", "source_id").agg(F.count(F.lit(1)).alias("records"), F.to_date(F.max("captured_at")).alias("latest")).filter(F.col("records") >= cap)


def unresearched(summary: DataFrame, researched: DataFrame) -> DataFrame:
    """How many recorded invasive species no paper backs; none if the recorded are a subset of the researched."""
    left = summary.select("species_id").distinct().join(researched, "species_id", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("missing")).withColumn("subset", F.col("missing") == 0)


def names_to_species(names: DataFrame, species: DataFrame) -> DataFrame:
    """For each name (column name) the species of that scientific name in any case, the lowest id of several, null if none."""
    known = species.groupBy(F.lower("scientific_name").alias("lower_")).agg(F.min("id").alias("species_id"))
    return names.select("name").distinct().join(known, F.lower("name") == F.col("lower_"), "left").select("name", "species_id")


# --- statistics -------------------------------------------------------------------------------------------------------------------


def gate(status: Column, reason: Column, needs: str, caution: str) -> list[Column]:
    """The columns of a layer: ok or insufficient, why not, what it would take, and a caution where it is ok."""
    ok = status == "ok"
    return [status.alias("status"), F.when(~ok, reason).alias("reason"), F.when(~ok, needs).alias("needs"), F.when(ok, caution).alias("caution")]


CAUTION_PAIRS = "A correlation doesn't show a cause: both measures may follow access or observers."
CAUTION_TREND = "A trend of records is no trend of abundance, which records don't measure."


def pairs_layer(cells: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Co-occurrence of each zone with its gate: rho and its interval only where there are squares enough, and where both measures vary.

    Reasons: "cells", "invaded" (too few squares, of all or with invasive records), "constant" (nothing to correlate).
    """
    found = analytics.cooccurrence(cells)
    steady = F.when(F.col("rho").isNull() | F.isnan("rho"), "constant")
    found = found.withColumns({"reason": F.coalesce("reason", steady), "rho": F.when(~F.isnan("rho"), F.col("rho"))})
    ok = F.when(F.col("reason").isNull(), "ok").otherwise("insufficient")
    needs = f"squares with {analytics.RAREFIED} native records: {analytics.MIN_CELLS}; of these with invasive records: {analytics.MIN_INVADED}"
    layer = found.select("zone_id", *gate(ok, F.col("reason"), needs, CAUTION_PAIRS), "cells", "invaded", "rho")
    if not draws:
        return layer
    interval = analytics.bootstrap_interval(cells.join(layer.filter("status = 'ok'").select("zone_id"), "zone_id", "left_semi"), draws, seed)
    return layer.join(interval, "zone_id", "left").select(*layer.columns, "low", "high")


def trend_layer(years: DataFrame) -> DataFrame:
    """Trends of invasive and of native records over effort for each zone, with their gate; nothing is computed where it is shut.

    Reasons: "years" (too few with effort enough), "records" (too few invasive ones).
    """
    usable = F.col("effort") >= analytics.MIN_EFFORT
    row = F.when(usable, F.struct(F.col("year").alias("t"), *[(F.col(c) / F.col("effort").cast("double")).alias(c) for c in ("invasive", "native")]))
    gates = years.groupBy("zone_id").agg(F.count(F.lit(1)).alias("years_with_data"), F.count_if(usable).alias("usable_years"), F.sum("invasive").alias("invasive_records"), F.min(F.when(usable, F.col("year"))).alias("first_year"), F.max(F.when(usable, F.col("year"))).alias("last_year"), F.collect_list(row).alias("rows_"))
    few_years, few_records = F.col("usable_years") < analytics.MIN_YEARS, F.col("invasive_records") < analytics.MIN_INVASIVE
    ok = F.when(few_years | few_records, "insufficient").otherwise("ok")
    why = F.when(few_years, "years").otherwise("records")
    needs = f"years of {analytics.MIN_EFFORT} observations or more: {analytics.MIN_YEARS}; invasive records: {analytics.MIN_INVASIVE}"
    columns = ["zone_id", *gate(ok, why, needs, CAUTION_TREND), "years_with_data", "usable_years", "invasive_records", F.when(ok == "ok", F.col("first_year")).alias("first_year"), F.when(ok == "ok", F.col("last_year")).alias("last_year")]
    rated = lambda name: F.when((ok == "ok") & (F.size("rows_") >= 4), F.transform("rows_", lambda x: F.struct(x["t"].alias("t"), x[name].alias("y"))))
    layer = gates.select(*columns, *[analytics.kendall(rated(c)).alias(f"{c}_k_") for c in ("invasive", "native")])
    p = analytics.p_value()
    for name in ("invasive", "native"):
        found = analytics.tested(F.col(f"{name}_k_"))
        layer = layer.withColumns({f"{name}_{c}": found[c] for c in ("n", "s", "tau", "slope")} | {f"{name}_p": p(found["z"])}).drop(f"{name}_k_")
    return layer


def theil_sen_line(rows: DataFrame, slopes: DataFrame, time: str, value: str, by: str) -> DataFrame:
    """Per group the median of value - slope * time, the line's height at time 0."""
    df = rows.join(slopes.select(by, "slope"), by)
    return df.groupBy(by).agg(F.median(F.col(value) - F.col("slope") * F.col(time)).alias("intercept"), F.max("slope").alias("slope"))


def bonferroni(tests: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """Each test beside the level divided by their number, and whether it passes that."""
    n = tests.agg(F.count(p).alias("tests"))
    return tests.crossJoin(F.broadcast(n)).withColumn("limit", F.try_divide(F.lit(level), F.col("tests"))).withColumn("significant", F.col(p) < F.col("limit"))


def report_lines(zones: DataFrame, detections: DataFrame, summary: DataFrame, species: DataFrame, findings: DataFrame, pairs: DataFrame, trends: DataFrame) -> DataFrame:
    """The whole report of every zone as lines of (zone_id, part, place, key, value): totals, species, findings, both layers.

    Computed for all zones in one plan. A layer that is insufficient has its reason and no number.
    """
    line = lambda place, key, value: F.struct(place.cast("long").alias("place"), key.alias("key"), value.cast("string").alias("value"))

    def lines(df: DataFrame, part: str, *of: Column) -> DataFrame:
        """A row has one line or several; those that are null are none."""
        return df.select("zone_id", F.lit(part).alias("part"), F.inline(F.filter(F.array(*of), lambda x: x.isNotNull())))

    totals = detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("species_id").alias("species"))
    totals = zones.select(F.col("id").alias("zone_id")).join(totals, "zone_id", "left").na.fill(0)
    out = lines(totals, "total", *[line(F.lit(i), F.lit(c), F.col(c)) for i, c in ((1, "observations"), (2, "species"))])
    out = out.unionByName(lines(invasive_in_order(summary, species), "invasive", line(F.col("place"), F.col("scientific_name"), F.col("records"))))
    told = findings_in_order(findings, summary, species)
    out = out.unionByName(lines(told, "finding", line(F.col("place"), F.col("scientific_name"), F.concat_ws(" ", "finding_type", "certainty", "doi", F.when(F.col("recorded"), "recorded").otherwise("not recorded")))))
    for layer, part, numbers in ((pairs, "cooccurrence", ("cells", "invaded", "rho")), (trends, "trend", ("usable_years", "invasive_records", "invasive_s", "native_s"))):
        of = [line(F.lit(0), F.lit("status"), F.coalesce(F.concat(F.lit("insufficient: "), F.col("reason")), F.col("status")))]
        for i, c in enumerate(numbers):
            double = dict(layer.dtypes)[c] == "double"
            row = line(F.lit(i + 1), F.lit(c), F.format_string("%.6f", F.round(c, 6)) if double else F.col(c))
            of.append(row if i < 2 else F.when(F.col("status") == "ok", row))
        out = out.unionByName(lines(layer, part, *of))
    return out


# --- maps -------------------------------------------------------------------------------------------------------------------------


def zone_features(polygons: DataFrame, overview: DataFrame) -> DataFrame:
    """Each zone as a GeoJSON feature with its counts; a collection is these in one array."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    df = polygons.select(F.col("id").alias("zone_id"), "slug", F.transform("rings", ring).alias("coordinates")).join(overview.drop("slug"), "zone_id")
    geometry = F.struct(F.lit("Polygon").alias("type"), "coordinates")
    properties = F.struct("slug", "media", "detections", "species", "invasive_records")
    return df.select("zone_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One document with all features in order of their zones; zones are few."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("zone_id", "feature"))), lambda x: x["feature"])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("collection"))


# --- ingest -----------------------------------------------------------------------------------------------------------------------


def outcomes(observations: DataFrame, polygons: DataFrame, stored: DataFrame, unbacked: DataFrame, as_of: str) -> DataFrame:
    """source_id, external_id, outcome of every observation: the first of its rules that it breaks, or "stored".

    unparseable (no coordinates or no name at all), the row rules, outside_zone (in no box, then in no polygon), skipped_dupe
    (source and id are stored already, or come earlier in this run), invasive_without_paper (``unbacked``: taxon_name, country).
    """
    rows = ingest.judged(observations, as_of)
    broken = F.col("lat").isNull() | F.col("lon").isNull() | F.col("taxon_name").isNull()
    first = F.when(F.col("reason").isin("duplicate_of_inaturalist", "not_a_specimen"), F.col("reason")).when(broken, "unparseable").otherwise(F.col("reason"))
    rows = rows.withColumn("reason", first)
    key = ["source_id", "external_id"]
    open_ = rows.filter("reason IS NULL").dropDuplicates(key)
    zoned = ingest.assign_zones(open_.select(*key, "lon", "lat"), polygons, key)
    known = stored.select(*key).distinct().withColumn("known_", F.lit(True))
    countries = polygons.select(F.col("id").alias("assigned_zone"), "country")
    bad = unbacked.select("taxon_name", "country").distinct().withColumn("bad_", F.lit(True))
    late = open_.select(*key, "taxon_name").join(zoned, key).join(known, key, "left").join(countries, "assigned_zone", "left").join(bad, ["taxon_name", "country"], "left")
    outcome = F.when(F.col("assigned_zone").isNull(), "outside_zone").when(F.col("known_"), "skipped_dupe").when(F.col("bad_"), "invasive_without_paper").otherwise("stored")
    again = rows.filter("reason IS NULL").groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0").select(*key, F.explode(F.array_repeat(F.lit("skipped_dupe"), F.col("n").cast("int"))).alias("outcome"))
    return rows.filter("reason IS NOT NULL").select(*key, F.col("reason").alias("outcome")).unionByName(late.select(*key, outcome.alias("outcome"))).unionByName(again)


def run_ledger(rows: DataFrame) -> DataFrame:
    """Per source: observations fetched, stored and skipped as known, and a map of the refusals."""
    counts = rows.groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    refused = ~F.col("outcome").isin("stored", "skipped_dupe")
    return counts.groupBy("source_id").agg(
        F.sum("n").alias("fetched"), F.coalesce(F.sum(F.when(F.col("outcome") == "stored", F.col("n"))), F.lit(0)).alias("stored"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "skipped_dupe", F.col("n"))), F.lit(0)).alias("skipped_dupe"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(refused, F.struct("outcome", "n"))))).alias("rejected"),
    )


def county_coverage(zones: DataFrame, counties: list[tuple[str, str, str]]) -> DataFrame:
    """The counties that are read for each zone, as (zone slug, state, county)."""
    rows = zones.sparkSession.createDataFrame(counties, "slug string, state string, county string")
    return zones.select(F.col("id").alias("zone_id"), "slug").join(F.broadcast(rows), "slug").groupBy("zone_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "state", "county"))).alias("counties"))


def in_rectangle(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a place lies in a rectangle, edges included; a missing coordinate doesn't."""
    return F.coalesce(lon.between(west, east) & lat.between(south, north), F.lit(False))


def geodesic_areas(polygons: DataFrame) -> DataFrame:
    return polygons.select(F.col("id").alias("zone_id"), geo.geodesic_km2(F.col("rings")).alias("area_km2"))


def ellipsoid_areas(polygons: DataFrame) -> DataFrame:
    return polygons.select(F.col("id").alias("zone_id"), geo.ellipsoid_km2(F.col("rings")).alias("area_km2"))
