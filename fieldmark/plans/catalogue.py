"""Queries by name over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import geo, text
from fieldmark.functions.references import decoded, decoded_sql
from fieldmark.operators import analytics, evidence, ingest, maintenance, metrics, serving, summary, views
from fieldmark.sources.testdata import Domain, prelude
from fieldmark.streaming.ingest import monthly_counts, requests_in_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF, EVENTS_AS_OF = "1996-06-30", "2024-01-20 00:00:00"

# Views in SQL that several queries read.
RESEARCHED = "researched AS (SELECT species_id FROM findings WHERE verified UNION SELECT species_id FROM playbooks WHERE verified)"
ORIGIN = """origin AS (SELECT *, CASE WHEN means ILIKE '%native%' THEN 'native' WHEN means ILIKE '%cryptogenic%' OR means ILIKE '%uncertain%' THEN 'uncertain' ELSE 'alien' END AS origin_class FROM status)"""
RECORDS = """records AS (SELECT d.* FROM detections d JOIN zones z ON z.id = d.zone_id JOIN origin o ON o.species_id = d.species_id AND o.country = z.country AND o.is_invasive AND o.origin_class = 'alien'
    WHERE d.species_id IN (SELECT species_id FROM researched))"""
SUMMARY = """summary AS (SELECT zone_id, species_id, count(*) AS records, CAST(min(captured_at) AS DATE) AS first_record, CAST(max(captured_at) AS DATE) AS last_record, count(DISTINCT source_id) AS sources FROM records GROUP BY ALL)"""
CENTRE = """centre AS (SELECT id AS zone_id, slug, lat0 + CASE WHEN is_corner THEN CAST(1 AS DOUBLE) / 6 ELSE CAST(0.2 AS DOUBLE) END AS center_lat FROM zones)"""
POINTS = """points AS (SELECT r.*, sp.scientific_name, sp.common_name, sp.kingdom, s.name AS source, year(r.captured_at) AS yr,
    CAST(floor(r.lon / (KM / (CAST(111.320 AS DOUBLE) * cos(radians(c.center_lat))))) AS INT) AS cx, CAST(floor(r.lat / (KM / CAST(110.574 AS DOUBLE))) AS INT) AS cy,
    KM / (CAST(111.320 AS DOUBLE) * cos(radians(c.center_lat))) AS dlon, KM / CAST(110.574 AS DOUBLE) AS dlat
    FROM records r JOIN centre c ON c.zone_id = r.zone_id JOIN species sp ON sp.id = r.species_id JOIN sources s ON s.id = r.source_id)"""
BASE = prelude("zones", "species", "sources", "media", "detections", "status", "findings", "playbooks") + f", {RESEARCHED}, {ORIGIN}, {RECORDS}, {SUMMARY}, {CENTRE}"


def points_sql(km: float = 2) -> str:
    return POINTS.replace("KM", f"CAST({km} AS DOUBLE)")


class World(Domain):
    """The test tables with the views made from them."""

    @property
    def researched(self) -> DataFrame:
        return views.researched_species(self.findings, self.playbooks)

    @property
    def records(self) -> DataFrame:
        return views.invasive_records(self.detections, self.zones, self.status, self.researched)

    @property
    def summary(self) -> DataFrame:
        return views.zone_invasive_summary(self.records)

    @property
    def polygons(self) -> DataFrame:
        return views.zone_polygons(self.zones)

    def points(self, **wanted) -> DataFrame:
        return serving.grid_points(self.records, self.polygons, self.species, self.sources, **wanted)

    @property
    def cooccurrence_cells(self) -> DataFrame:
        return analytics.cooccurrence_cells(self.detections, self.zones, self.status, self.researched)

    @property
    def trend_years(self) -> DataFrame:
        return analytics.trend_years(self.detections, self.zones, self.status, self.researched)

    @property
    def judged(self) -> DataFrame:
        return ingest.judged(self.observations, EVENTS_AS_OF)


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def digits(df: DataFrame, *names: str, n: int = 9) -> DataFrame:
    """Doubles to so many places, for engines add in different orders."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in names})


# --- views --------------------------------------------------------------------------------------------------------------------

query("researched_species", f"{BASE} SELECT species_id FROM researched")(lambda w: w.researched)
query("origin_class", f"{BASE} SELECT species_id, country, is_invasive, origin_class FROM origin")(lambda w: views.with_origin(w.status).select("species_id", "country", "is_invasive", "origin_class"))
query("invasive_records", f"{BASE} SELECT zone_id, species_id, media_id, source_id, CAST(captured_at AS DATE) AS day, origin FROM records")(lambda w: w.records.select("zone_id", "species_id", "media_id", "source_id", F.to_date("captured_at").alias("day"), "origin"))
query("zone_invasive_summary", f"{BASE} SELECT * FROM summary")(lambda w: w.summary)
query("effort_monthly", f"{BASE} SELECT zone_id, CAST(date_trunc('month', captured_at) AS DATE) AS month, count(*) AS effort FROM media WHERE zone_id IS NOT NULL AND captured_at IS NOT NULL GROUP BY ALL")(lambda w: views.effort_monthly(w.media))
MONTHLY = """SELECT a.zone_id, a.species_id, a.month, a.detections, e.effort, round(CAST(a.detections AS DOUBLE) / e.effort, 9) AS rate FROM
    (SELECT zone_id, species_id, CAST(date_trunc('month', captured_at) AS DATE) AS month, count(*) AS detections FROM chosen GROUP BY ALL) a
    JOIN (SELECT zone_id, CAST(date_trunc('month', captured_at) AS DATE) AS month, count(*) AS effort FROM media GROUP BY ALL) e ON e.zone_id = a.zone_id AND e.month = a.month"""
MONTH_COLUMNS = ["zone_id", "species_id", "month", "detections", "effort", "rate"]
query("invasion_index_monthly", f"""{BASE}, chosen AS (SELECT d.* FROM detections d JOIN zones z ON z.id = d.zone_id JOIN origin o ON o.species_id = d.species_id AND o.country = z.country AND o.is_invasive AND o.origin_class = 'alien') {MONTHLY}""")(
    lambda w: digits(views.invasion_index_monthly(w.detections, w.media, w.zones, w.status).select(*MONTH_COLUMNS), "rate")
)
query("native_trend_monthly", f"""{BASE}, chosen AS (SELECT d.* FROM detections d JOIN zones z ON z.id = d.zone_id WHERE NOT EXISTS
    (SELECT 1 FROM origin o WHERE o.species_id = d.species_id AND o.country = z.country AND o.origin_class IN ('alien', 'uncertain'))) {MONTHLY}""")(
    lambda w: digits(views.native_trend_monthly(w.detections, w.media, w.zones, w.status).select(*MONTH_COLUMNS), "rate")
)
query("source_health", prelude("sources", "media", "runs") + """ SELECT s.id AS source_id, s.name, coalesce(m.n, 0) AS stored, r.id AS run_id, CAST(r.finished_at AS DATE) AS finished, r.fetched FROM sources s
    LEFT JOIN (SELECT source_id, count(*) AS n FROM media GROUP BY 1) m ON m.source_id = s.id
    LEFT JOIN (SELECT * FROM runs WHERE finished_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY finished_at DESC, id DESC) = 1) r ON r.source_id = s.id""")(
    lambda w: views.source_health(w.sources, w.media, w.runs)
)
query("record_class", f"""{BASE} SELECT d.zone_id, CASE WHEN o.is_invasive AND o.origin_class = 'alien' THEN 'invasive' WHEN o.origin_class IN ('alien', 'uncertain') THEN 'introduced' ELSE 'native' END AS class, count(*) AS records
    FROM detections d JOIN zones z ON z.id = d.zone_id LEFT JOIN origin o ON o.species_id = d.species_id AND o.country = z.country GROUP BY ALL""")(lambda w: views.record_classes(w.detections, w.zones, w.status))
query("public_species", f"{BASE} SELECT id, scientific_name FROM species WHERE id IN (SELECT species_id FROM researched)")(lambda w: w.species.join(w.researched, w.species["id"] == F.col("species_id"), "left_semi").select("id", "scientific_name"))

# --- serving --------------------------------------------------------------------------------------------------------------------

GRID = """SELECT zone_id, cx, cy, round(cx * min(dlon), 9) AS west, round(cy * min(dlat), 9) AS south, round((cx + 1) * min(dlon), 9) AS east, round((cy + 1) * min(dlat), 9) AS north,
    count(*) AS records, count(DISTINCT species_id) AS species_count FROM points"""
CELLS = ["zone_id", "cx", "cy", "west", "south", "east", "north", "records", "species_count"]
query("hotspot_grid", f"{BASE}, {points_sql()} {GRID} GROUP BY zone_id, cx, cy")(lambda w: digits(serving.hotspot_grid(w.points()).select(*CELLS), "west", "south", "east", "north"))
query("hotspot_grid_filtered", f"{BASE}, {points_sql(5)} {GRID} WHERE kingdom = 'Animalia' AND source IN ('urgent', 'high') AND yr BETWEEN 1996 AND 1999 GROUP BY zone_id, cx, cy")(
    lambda w: digits(serving.hotspot_grid(w.points(km=5, kingdom="Animalia", source_names="urgent,high", year_from=1996, year_to=1999)).select(*CELLS), "west", "south", "east", "north")
)
query("hotspot_grid_species", f"""{BASE}, {points_sql()} SELECT *, row_number() OVER (PARTITION BY zone_id, cx, cy ORDER BY records DESC, name) - 1 AS place FROM
    (SELECT zone_id, cx, cy, scientific_name AS name, common_name, kingdom, count(*) AS records, min(yr) AS first_year, max(yr) AS last_year FROM points GROUP BY ALL) x""")(
    lambda w: serving.hotspot_grid(w.points()).select("zone_id", "cx", "cy", F.posexplode("species").alias("place", "s")).select("zone_id", "cx", "cy", "s.name", "s.common_name", "s.kingdom", "s.records", F.col("s.first_year").cast("long").alias("first_year"), F.col("s.last_year").cast("long").alias("last_year"), F.col("place").cast("long").alias("place"))
)
query("hotspot_grid_years", f"{BASE}, {points_sql()} SELECT zone_id, cx, cy, yr AS year, count(*) AS n FROM points GROUP BY ALL")(lambda w: serving.hotspot_grid(w.points()).select("zone_id", "cx", "cy", F.explode("by_year").alias("y")).select("zone_id", "cx", "cy", F.col("y.year").cast("long").alias("year"), "y.n"))
query("hotspot_grid_sources", f"{BASE}, {points_sql()} SELECT zone_id, cx, cy, source, count(*) AS n FROM points GROUP BY ALL")(lambda w: serving.hotspot_grid(w.points()).select("zone_id", "cx", "cy", F.explode("by_source").alias("source", "n")))
query("rank_species", f"{BASE}, {points_sql()} SELECT zone_id, scientific_name AS name, count(*) AS records, min(yr) AS first_year, max(yr) AS last_year FROM points GROUP BY ALL")(
    lambda w: serving.rank_species(serving.hotspot_grid(w.points())).select("zone_id", "name", "records", F.col("first_year").cast("long").alias("first_year"), F.col("last_year").cast("long").alias("last_year"))
)
query("cells_in_view", f"{BASE}, {points_sql()}, cells AS (SELECT zone_id, cx, cy, count(*) AS records, (cx + CAST(0.5 AS DOUBLE)) * min(dlon) AS x, (cy + CAST(0.5 AS DOUBLE)) * min(dlat) AS y FROM points GROUP BY zone_id, cx, cy) SELECT zone_id, cx, cy, records FROM cells WHERE x BETWEEN -60 AND -19.8 AND y BETWEEN -20 AND 0.2")(
    lambda w: serving.cells_in_view(serving.hotspot_grid(w.points()), -60, -20, -19.8, 0.2).select("zone_id", "cx", "cy", "records")
)
query("heat_levels", f"{BASE}, {points_sql()}, cells AS (SELECT zone_id, cx, cy, count(*) AS records FROM points GROUP BY zone_id, cx, cy), top AS (SELECT zone_id, max(records) AS most FROM cells GROUP BY 1) SELECT c.zone_id, CAST(least(4, floor(5 * sqrt(records / CAST(most AS DOUBLE)))) AS INT) AS heat, count(*) AS cells FROM cells c JOIN top t ON t.zone_id = c.zone_id GROUP BY ALL")(
    lambda w: (lambda c: c.join(c.groupBy("zone_id").agg(F.max("records").alias("most")), "zone_id").groupBy("zone_id", geo.heat_level(F.col("records"), F.col("most").cast("double")).alias("heat")).agg(F.count(F.lit(1)).alias("cells")))(serving.hotspot_grid(w.points()).select("zone_id", "records"))
)
query("invasive_by_year", f"{BASE} SELECT year(captured_at) AS year, count(*) AS records FROM records GROUP BY 1")(lambda w: serving.invasive_by_year(w.records))
query("species_profile", f"""{BASE} SELECT species_id, part, key, records, first_year, last_year FROM (
    SELECT species_id, 'total' AS part, NULL AS key, count(*) AS records, min(year(captured_at)) AS first_year, max(year(captured_at)) AS last_year FROM records GROUP BY 1
    UNION ALL SELECT species_id, 'zone', zone_id, count(*), min(year(captured_at)), max(year(captured_at)) FROM records GROUP BY species_id, zone_id
    UNION ALL SELECT species_id, 'year', year(captured_at), count(*), min(year(captured_at)), max(year(captured_at)) FROM records GROUP BY species_id, year(captured_at)
    UNION ALL SELECT species_id, 'source', source_id, count(*), min(year(captured_at)), max(year(captured_at)) FROM records GROUP BY species_id, source_id) x""")(lambda w: serving.species_profile(w.records))
query("zones_overview", f"""{BASE} SELECT z.id AS zone_id, z.slug, round(lon0, 9) AS west, round(lat0, 9) AS south, round(lon0 + 0.5, 9) AS east, round(lat0 + CAST(0.4 AS DOUBLE), 9) AS north,
    coalesce(m.n, 0) AS media, coalesce(d.n, 0) AS detections, coalesce(d.s, 0) AS species, coalesce(r.n, 0) AS invasive_records FROM zones z
    LEFT JOIN (SELECT zone_id, count(*) AS n FROM media GROUP BY 1) m ON m.zone_id = z.id LEFT JOIN (SELECT zone_id, count(*) AS n, count(DISTINCT species_id) AS s FROM detections GROUP BY 1) d ON d.zone_id = z.id
    LEFT JOIN (SELECT zone_id, count(*) AS n FROM records GROUP BY 1) r ON r.zone_id = z.id""")(lambda w: digits(serving.zones_overview(w.polygons, w.detections, w.records, w.media).drop("area_km2"), "west", "south", "east", "north"))
query("zone_geometry", f"""{prelude("zones")} SELECT id AS zone_id, round(lat0 + CASE WHEN is_corner THEN CAST(1 AS DOUBLE) / 6 ELSE CAST(0.2 AS DOUBLE) END, 9) AS center_lat,
    round(CASE WHEN is_corner THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END * CAST(110.574 AS DOUBLE) * CAST(111.320 AS DOUBLE) * cos(radians(lat0 + CASE WHEN is_corner THEN CAST(1.2 AS DOUBLE) / 6 ELSE CAST(0.2 AS DOUBLE) END)), 5) AS area_km2 FROM zones""")(
    lambda w: digits(digits(w.polygons.select(F.col("id").alias("zone_id"), "center_lat", geo.area_km2(F.col("rings")).alias("area_km2")), "center_lat"), "area_km2", n=5)
)
SEARCH = "SELECT media_id, species_id, scientific_name, CAST(captured_at AS DATE) AS day, zone_id, round(confidence, 9) AS confidence, origin FROM (SELECT d.*, s.scientific_name, s.common_name FROM detections d JOIN species s ON s.id = d.species_id) x"
query("detections_search", f"{BASE} {SEARCH} WHERE (lower(scientific_name) = 'common 7' OR lower(common_name) = 'common 7') AND captured_at >= TIMESTAMP '1996-01-01' AND captured_at < TIMESTAMP '1999-01-01' AND confidence >= 0.6 ORDER BY captured_at DESC, media_id, species_id, confidence, origin LIMIT 100")(
    lambda w: digits(serving.search_records(w.detections, w.species, name="COMMON 7", since="1996-01-01", until="1999-01-01", least=0.6, limit=100), "confidence")
)
query("species_search", f"{BASE} SELECT s.id, s.scientific_name, s.common_name, s.kingdom, o.is_invasive AND o.origin_class = 'alien' AS is_invasive FROM species s LEFT JOIN origin o ON o.species_id = s.id AND o.country = 'IN' WHERE s.scientific_name ILIKE '%1%' OR s.common_name ILIKE '%1%'")(
    lambda w: serving.search_species(w.species, views.with_origin(w.status), text="1")
)
query("invasive_species_search", f"{BASE} SELECT s.id, s.scientific_name, s.common_name, s.kingdom, true AS is_invasive FROM species s JOIN origin o ON o.species_id = s.id AND o.country = 'FR' WHERE o.is_invasive AND o.origin_class = 'alien'")(
    lambda w: serving.search_species(w.species, views.with_origin(w.status), country="FR", invasive_only=True)
)
query("playbooks_list", f"{BASE} SELECT s.scientific_name, p.method, p.design, p.doi FROM playbooks p JOIN species s ON s.id = p.species_id WHERE p.verified")(
    lambda w: w.playbooks.filter("verified").join(w.species.select(F.col("id").alias("species_id"), "scientific_name"), "species_id").select("scientific_name", "method", "design", "doi")
)
query("top_species", f"{BASE} SELECT species_id, CAST(sum(records) AS BIGINT) AS records FROM summary GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda w: serving.top(w.summary.groupBy("species_id").agg(F.sum("records").alias("records")), 10, F.desc("records"), "species_id"))

# --- analytics ------------------------------------------------------------------------------------------------------------------

query("zone_totals", f"{BASE} SELECT zone_id, count(*) AS records, count(DISTINCT species_id) AS species FROM detections GROUP BY 1")(lambda w: w.detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("species_id").alias("species")))
query("documented_findings", f"""{BASE} SELECT CAST(z.id AS BIGINT) AS zone_id, f.species_id, f.finding_type, f.certainty, f.doi, coalesce(s.records, 0) AS records, coalesce(s.records, 0) > 0 AS recorded
    FROM findings f CROSS JOIN zones z LEFT JOIN summary s ON s.zone_id = z.id AND s.species_id = f.species_id WHERE f.verified AND (f.zone_id = z.id OR f.zone_id IS NULL AND s.records > 0)""")(lambda w: analytics.documented_findings(w.findings, w.summary))
PAIR_CELLS = """, per AS (SELECT d.zone_id, CAST(floor(lon / CAST(0.05 AS DOUBLE)) AS INT) AS cx, CAST(floor(lat / CAST(0.05 AS DOUBLE)) AS INT) AS cy, d.species_id, count(*) AS n, bool_or(o.is_invasive AND o.origin_class = 'alien' AND d.species_id IN (SELECT species_id FROM researched)) AS inv,
      bool_or(coalesce(o.origin_class IN ('alien', 'uncertain'), false)) AS odd FROM detections d JOIN zones z ON z.id = d.zone_id LEFT JOIN origin o ON o.species_id = d.species_id AND o.country = z.country GROUP BY 1, 2, 3, 4),
    tot AS (SELECT zone_id, cx, cy, sum(n) AS all_records, coalesce(sum(n) FILTER (WHERE inv), 0) AS invasive_records, coalesce(sum(n) FILTER (WHERE NOT odd), 0) AS big FROM per GROUP BY 1, 2, 3),
    rich AS (SELECT p.zone_id, p.cx, p.cy, sum(1 - (SELECT product(CAST(greatest(t.big - p.n - i, 0) AS DOUBLE) / (t.big - i)) FROM range(10) r(i))) AS richness FROM per p JOIN tot t ON t.zone_id = p.zone_id AND t.cx = p.cx AND t.cy = p.cy WHERE NOT p.odd AND t.big >= 10 GROUP BY 1, 2, 3),
    cells AS (SELECT t.zone_id, t.cx, t.cy, CAST(all_records AS BIGINT) AS all_records, CAST(invasive_records AS BIGINT) AS invasive_records, richness FROM tot t LEFT JOIN rich r ON r.zone_id = t.zone_id AND r.cx = t.cx AND r.cy = t.cy)"""
query("cooccurrence_cells", f"{BASE}{PAIR_CELLS} SELECT zone_id, cx, cy, all_records, invasive_records, round(richness, 7) AS richness FROM cells")(lambda w: digits(w.cooccurrence_cells, "richness", n=7))
query("cooccurrence", f"""{BASE}{PAIR_CELLS}, good AS (SELECT *, round(invasive_records / CAST(all_records AS DOUBLE), 9) AS share, round(richness, 9) AS rich9 FROM cells WHERE richness IS NOT NULL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY share) + (count(*) OVER (PARTITION BY zone_id, share) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY zone_id ORDER BY rich9) + (count(*) OVER (PARTITION BY zone_id, rich9) - 1) / 2.0 AS ry FROM good),
    stat AS (SELECT zone_id, count(*) AS cells, count(*) FILTER (WHERE invasive_records > 0) AS invaded, corr(rx, ry) AS rho FROM ranked GROUP BY 1)
    SELECT zone_id, cells, invaded, CASE WHEN cells < 20 THEN 'cells' WHEN invaded < 5 THEN 'invaded' END AS reason, CASE WHEN cells >= 20 AND invaded >= 5 THEN round(rho, 6) END AS rho FROM stat""")(
    lambda w: digits(analytics.cooccurrence(w.cooccurrence_cells.withColumn("richness", F.round("richness", 9))), "rho", n=6)
)
query("group_squares", f"""{BASE}{PAIR_CELLS}, good AS (SELECT zone_id, invasive_records, round(invasive_records / CAST(all_records AS DOUBLE), 9) AS share, richness FROM cells WHERE richness IS NOT NULL),
    r AS (SELECT *, count(*) OVER (PARTITION BY zone_id) AS n, rank() OVER (PARTITION BY zone_id ORDER BY share) AS f FROM good WHERE invasive_records > 0),
    p AS (SELECT *, CASE WHEN n >= 12 THEN 3 WHEN n >= 6 THEN 2 ELSE 1 END AS k FROM r),
    g AS (SELECT zone_id, CASE WHEN k = 1 OR f <= floor(n / CAST(k AS DOUBLE)) THEN 1 WHEN k = 2 OR f <= floor(n * 2 / CAST(k AS DOUBLE)) THEN 2 ELSE 3 END AS part, share, richness FROM p UNION ALL SELECT zone_id, 0, share, richness FROM good WHERE invasive_records = 0)
    SELECT zone_id, CAST(part AS BIGINT) AS part, count(*) AS squares, min(share) AS low, max(share) AS high, round(avg(richness), 6) AS richness FROM g GROUP BY 1, 2""")(
    lambda w: digits(summary.group_squares(w.cooccurrence_cells.filter("richness IS NOT NULL").withColumn("share", F.round(F.col("invasive_records") / F.col("all_records").cast("double"), 9))), "richness", n=6)
)
query("cooccurrence_interval")(lambda w: analytics.bootstrap_interval(w.cooccurrence_cells))
YEARS = """, years AS (SELECT d.zone_id, year(d.captured_at) AS year, count(DISTINCT media_id) AS effort, count(*) FILTER (WHERE o.is_invasive AND o.origin_class = 'alien' AND d.species_id IN (SELECT species_id FROM researched)) AS invasive,
    count(*) FILTER (WHERE d.species_id IS NOT NULL AND coalesce(o.origin_class, 'native') = 'native') AS native FROM detections d JOIN zones z ON z.id = d.zone_id LEFT JOIN origin o ON o.species_id = d.species_id AND o.country = z.country GROUP BY 1, 2)"""
query("trend_years", f"{BASE}{YEARS} SELECT * FROM years")(lambda w: w.trend_years)
query("trend", f"""{BASE}{YEARS}, good AS (SELECT zone_id, year, invasive / CAST(effort AS DOUBLE) AS rate FROM years WHERE effort >= 15 AND zone_id IN (SELECT zone_id FROM years GROUP BY 1 HAVING sum(invasive) >= 30 AND count(*) FILTER (WHERE effort >= 15) >= 6)),
    pairs AS (SELECT a.zone_id, sign(b.rate - a.rate) AS s, (b.rate - a.rate) / (b.year - a.year) AS slope FROM good a JOIN good b ON a.zone_id = b.zone_id AND a.year < b.year),
    p AS (SELECT zone_id, CAST(sum(s) AS BIGINT) AS s, median(slope) AS slope FROM pairs GROUP BY 1),
    t AS (SELECT zone_id, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT zone_id, rate, count(*) AS k FROM good GROUP BY 1, 2) x GROUP BY 1),
    v AS (SELECT t.zone_id, CAST(n AS BIGINT) AS n, s, slope, (n * (n - 1) * (2 * n + 5) - tied) / CAST(18 AS DOUBLE) AS variance FROM t JOIN p ON p.zone_id = t.zone_id WHERE n >= 4)
    SELECT zone_id, n, s, round(variance, 6) AS variance, round(CASE WHEN variance <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(variance) END, 6) AS z, round(s / (n * (n - 1) / CAST(2 AS DOUBLE)), 6) AS tau, round(slope, 6) AS slope FROM v""")(
    lambda w: digits(analytics.trend(w.trend_years).drop("p"), "variance", "z", "tau", "slope", n=6)
)
query("trend_p")(lambda w: analytics.trend(w.trend_years).select("zone_id", F.round("p", 9).alias("p")))
query("first_record_alerts", f"""{BASE}, new AS (SELECT * FROM summary WHERE first_record <= DATE '{AS_OF}' AND first_record > DATE '{AS_OF}' - INTERVAL 365 DAY),
    eff AS (SELECT n.zone_id, n.species_id, count(*) AS prior_effort FROM new n JOIN media m ON m.zone_id = n.zone_id AND CAST(m.captured_at AS DATE) < n.first_record GROUP BY 1, 2)
    SELECT n.zone_id, n.species_id, n.first_record, e.prior_effort, CASE WHEN EXISTS (SELECT 1 FROM findings f WHERE f.verified AND f.species_id = n.species_id AND certainty IN ('experimental', 'observational', 'review')) THEN 'high' ELSE 'medium' END AS severity
    FROM new n JOIN eff e ON e.zone_id = n.zone_id AND e.species_id = n.species_id WHERE e.prior_effort >= 50 AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.verified AND f.species_id = n.species_id AND f.zone_id = n.zone_id)""")(
    lambda w: analytics.first_record_alerts(w.summary, w.media, w.findings, w.playbooks, AS_OF)
)
query("zone_report")(lambda w: analytics.zone_report(w.zones, w.detections, w.summary, analytics.cooccurrence(w.cooccurrence_cells), analytics.trend(w.trend_years)))

# --- summaries ------------------------------------------------------------------------------------------------------------------

query("records_by_park_source", f"{BASE} SELECT zone_id, source_id, count(*) AS records, CAST(min(captured_at) AS DATE) AS earliest, CAST(max(captured_at) AS DATE) AS latest FROM detections GROUP BY 1, 2")(lambda w: summary.records_by_park_source(w.detections))
query("records_by_year", f"{BASE} SELECT zone_id, year(captured_at) AS year, count(*) AS records FROM detections GROUP BY 1, 2")(lambda w: summary.records_by_year(w.detections))
PERIOD = "CASE WHEN year(captured_at) <= 1996 THEN 'to 1996' WHEN year(captured_at) <= 1999 THEN '1997-1999' ELSE '2000 on' END"
query("period_source_matrix", f"{BASE} SELECT {PERIOD} AS period, " + ", ".join(f"count(*) FILTER (WHERE source_id = {s}) AS source_{s}" for s in range(1, 6)) + " FROM records GROUP BY 1")(lambda w: summary.period_source_matrix(w.records, [1, 2, 3, 4, 5], (1997, 2000)))
query("period_shares", f"{BASE} SELECT b.period, b.records, coalesce(a.invasive, 0) AS invasive, round(coalesce(a.invasive, 0) / CAST(b.records AS DOUBLE), 9) AS share FROM (SELECT {PERIOD} AS period, count(*) AS records FROM detections GROUP BY 1) b LEFT JOIN (SELECT {PERIOD} AS period, count(*) AS invasive FROM records GROUP BY 1) a ON a.period = b.period")(
    lambda w: digits(summary.period_shares(w.records, w.detections, (1997, 2000)), "share")
)
query("records_with_total", f"{BASE} SELECT zone_id, source_id, count(*) AS records, grouping(zone_id) * 2 + grouping(source_id) AS level FROM detections GROUP BY ROLLUP (zone_id, source_id)")(lambda w: summary.records_with_total(w.detections))
query("refused_by_reason", prelude("runs") + """ SELECT source_id, reason, CAST(sum(refused) AS BIGINT) AS refused FROM (SELECT * FROM runs WHERE source_id NOT IN (1, 2)
    UNION ALL (SELECT * FROM runs WHERE source_id IN (1, 2) QUALIFY row_number() OVER (PARTITION BY source_id, scope ORDER BY fetched DESC, id) = 1)) x GROUP BY 1, 2""")(lambda w: summary.refused_by_reason(w.runs, [1, 2]))
query("hotspot_concentration", f"""{BASE}, {points_sql()}, cells AS (SELECT zone_id, cx, cy, count(*) AS records FROM points GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY records DESC, cx, cy) AS place, count(*) OVER (PARTITION BY zone_id) AS cells FROM cells)
    SELECT zone_id, max(cells) AS cells, max(records) AS busiest, count(*) FILTER (WHERE records = 1) AS singletons, CAST(sum(records) AS BIGINT) AS records, round(sum(records) FILTER (WHERE place <= greatest(1, round_even(cells * CAST(0.1 AS DOUBLE), 0))) / CAST(sum(records) AS DOUBLE), 9) AS top_share FROM ranked GROUP BY 1""")(
    lambda w: digits(summary.hotspot_concentration(serving.hotspot_grid(w.points()).select("zone_id", "cx", "cy", "records")), "top_share")
)
query("evidence_coverage", f"""{BASE} SELECT zone_id, count(*) AS species, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM findings f WHERE f.verified AND f.species_id = s.species_id)) AS with_finding,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM findings f WHERE f.verified AND f.species_id = s.species_id AND f.zone_id = s.zone_id)) AS documented_here,
    count(*) FILTER (WHERE EXISTS (SELECT 1 FROM playbooks f WHERE f.verified AND f.species_id = s.species_id)) AS with_management, CAST(sum(records) AS BIGINT) AS records FROM summary s GROUP BY 1""")(lambda w: summary.evidence_coverage(w.summary, w.findings, w.playbooks))
query("evidence_table", f"{BASE} SELECT species_id, count(DISTINCT doi) AS papers, CAST(sum(f) AS BIGINT) AS findings, CAST(sum(m) AS BIGINT) AS management FROM (SELECT species_id, doi, 1 AS f, 0 AS m FROM findings WHERE verified UNION ALL SELECT species_id, doi, 0, 1 FROM playbooks WHERE verified) x GROUP BY 1")(lambda w: summary.evidence_table(w.findings, w.playbooks))
query("knowledge_counts", f"{BASE} SELECT 'certainty' AS kind, certainty AS value, count(*) AS n, count(*) FILTER (WHERE verified) AS verified FROM findings GROUP BY 2 UNION ALL SELECT 'method', method, count(*), count(*) FILTER (WHERE verified) FROM playbooks GROUP BY 2")(lambda w: summary.knowledge_counts(w.findings, w.playbooks))
query("distinct_papers", f"{BASE} SELECT count(DISTINCT doi) AS papers FROM (SELECT doi FROM findings WHERE verified UNION ALL SELECT doi FROM playbooks WHERE verified) x")(lambda w: summary.distinct_papers(w.findings, w.playbooks))
query("species_entries", f"""{BASE}, e AS (SELECT species_id, count(*) AS evidence FROM (SELECT species_id FROM findings WHERE verified UNION ALL SELECT species_id FROM playbooks WHERE verified) x GROUP BY 1), r AS (SELECT species_id, CAST(sum(records) AS BIGINT) AS records FROM summary GROUP BY 1)
    SELECT s.id AS species_id, coalesce(s.common_name, s.scientific_name) AS name, coalesce(e.evidence, 0) AS evidence, coalesce(r.records, 0) AS records FROM species s LEFT JOIN e ON e.species_id = s.id LEFT JOIN r ON r.species_id = s.id WHERE e.evidence IS NOT NULL OR r.records IS NOT NULL""")(
    lambda w: summary.species_entries(w.species, w.findings, w.playbooks, w.summary)
)
query("not_recorded", f"{BASE} SELECT species_id FROM researched EXCEPT SELECT species_id FROM summary")(lambda w: summary.not_recorded(w.researched, w.summary))
query("bin_years", f"{BASE}, y AS (SELECT year(captured_at) AS year, count(*) AS records FROM records GROUP BY 1), b AS (SELECT g.start AS start FROM range(1990, 2010, 5) g(start) WHERE g.start >= (SELECT floor(min(year) / 5) * 5 FROM y) AND g.start <= (SELECT floor(max(year) / 5) * 5 FROM y)) SELECT b.start, CAST(5 AS BIGINT) AS width, CAST(coalesce(sum(y.records), 0) AS BIGINT) AS records FROM b LEFT JOIN y ON floor(y.year / 5) * 5 = b.start GROUP BY 1")(
    lambda w: summary.bin_years(serving.invasive_by_year(w.records), most=4)
)
query("zones_needing_records", f"{BASE} SELECT z.id AS zone_id, coalesce(m.n, 0) AS media, row_number() OVER (ORDER BY coalesce(m.n, 0), z.id) AS place FROM zones z LEFT JOIN (SELECT zone_id, count(*) AS n FROM media GROUP BY 1) m ON m.zone_id = z.id")(lambda w: summary.zones_needing_records(w.zones, w.media))

# --- ingest ---------------------------------------------------------------------------------------------------------------------

JUDGED = prelude("observations", "zones", "media", "species", "status", "runs") + f""", judged AS (SELECT *, CASE WHEN basis = 'mirror' THEN 'duplicate_of_inaturalist' WHEN basis <> 'specimen' THEN 'not_a_specimen' WHEN lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'bad_coordinates'
    WHEN lat = 0 AND lon = 0 THEN 'null_island' WHEN obscured THEN 'obscured_location' WHEN uncertainty_m > 2000 THEN 'imprecise_location' WHEN captured_at IS NULL THEN 'no_date' WHEN captured_at > TIMESTAMP '{EVENTS_AS_OF}' THEN 'future_date'
    WHEN taxon_rank IS NULL OR lower(taxon_rank) NOT IN ('species', 'subspecies', 'variety', 'form', 'hybrid', 'infraspecies', 'infrahybrid') THEN 'not_species_level' WHEN captive THEN 'captive_or_cultivated' WHEN failed_introduction THEN 'not_established' WHEN taxon_name = '' THEN 'no_taxon' END AS reason FROM observations)"""
query("reject_reasons", f"{JUDGED} SELECT external_id, reason FROM judged")(lambda w: w.judged.select("external_id", "reason"))
query("reason_counts", f"{JUDGED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1")(lambda w: ingest.reason_counts(w.judged))
query("spatial_assign", f"""{JUDGED} SELECT j.external_id, min(z.id) AS assigned_zone FROM judged j LEFT JOIN zones z ON j.lon >= z.lon0 AND j.lon < z.lon0 + 0.5 AND j.lat >= z.lat0 AND j.lat < z.lat0 + CAST(0.4 AS DOUBLE)
    AND NOT (z.is_corner AND j.lon >= z.lon0 + 0.25 AND j.lat >= z.lat0 + CAST(0.2 AS DOUBLE)) WHERE j.reason IS NULL GROUP BY 1""")(lambda w: ingest.assign_zones(w.judged.filter("reason IS NULL").select("external_id", "lon", "lat"), w.polygons, ["external_id"]))
query("new_observations", f"{JUDGED} SELECT source_id, external_id FROM judged WHERE reason IS NULL AND (source_id, external_id) NOT IN (SELECT source_id, id FROM media)")(
    lambda w: ingest.new_rows(w.judged.filter("reason IS NULL").select("source_id", "external_id"), w.media.select("source_id", F.col("id").alias("external_id")), ["source_id", "external_id"])
)
query("near_duplicate_media", f"""{JUDGED} SELECT a.id, min(b.id) AS original FROM media a JOIN media b ON a.captured_at = b.captured_at AND coalesce(a.width, -1) = coalesce(b.width, -1) AND coalesce(a.height, -1) = coalesce(b.height, -1) AND b.id < a.id AND bit_count(xor(a.phash, b.phash)) <= 2 GROUP BY 1""")(lambda w: ingest.near_duplicate_media(w.media))
query("merge_species", f"""{JUDGED}, inc AS (SELECT i.v AS seq, (i.v * 7) % 260 AS id, 'New ' || i.v AS scientific_name, CASE WHEN i.v % 3 = 0 THEN NULL ELSE 'Named ' || i.v END AS common_name, 'Plantae' AS kingdom FROM range(100) i(v)),
    n AS (SELECT id, arg_max(scientific_name, seq) AS sn, arg_max(common_name, seq) FILTER (WHERE common_name IS NOT NULL) AS cn, arg_max(kingdom, seq) AS k FROM inc GROUP BY 1)
    SELECT coalesce(s.id, n.id) AS id, coalesce(n.sn, s.scientific_name) AS scientific_name, coalesce(s.common_name, n.cn) AS common_name, coalesce(n.k, s.kingdom) AS kingdom FROM species s FULL JOIN n ON n.id = s.id""")(
    lambda w: ingest.merge_species(
        w.species.withColumn("id", F.col("id").cast("long")),
        w.spark.range(100).select(F.col("id").alias("seq"), ((F.col("id") * 7) % 260).alias("id"), F.concat(F.lit("New "), F.col("id")).alias("scientific_name"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("Named "), F.col("id"))).alias("common_name"), F.lit("Plantae").alias("kingdom")),
    )
)
query("merge_checklist", f"{JUDGED} SELECT species_id % 40 AS species_id, country, bool_or(is_invasive) AS is_invasive, arg_min(means, species_id) FILTER (WHERE means IS NOT NULL) AS means, count(*) AS rows FROM status GROUP BY 1, 2")(
    lambda w: ingest.merge_checklist(w.status.filter("means IS NOT NULL").select((F.col("species_id") % 40).alias("species_id"), "country", "is_invasive", "means", F.col("species_id").alias("seq"))).select("species_id", "country", "means").join(
        ingest.merge_checklist(w.status.select((F.col("species_id") % 40).alias("species_id"), "country", "is_invasive", "means", F.col("species_id").alias("seq"))).select("species_id", "country", "is_invasive", "rows"), ["species_id", "country"], "right"
    ).select("species_id", "country", "is_invasive", "means", "rows")
)
query("prune_runs", f"{JUDGED} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, finished_at IS NULL ORDER BY finished_at DESC, id DESC) AS place FROM runs) x WHERE finished_at IS NULL OR place <= 20 OR finished_at >= TIMESTAMP '2024-01-25'")(lambda w: ingest.prune_runs(w.runs, 20, "2024-01-25").select("id"))
query("capped_media", f"{JUDGED} SELECT id FROM media QUALIFY row_number() OVER (PARTITION BY zone_id, source_id ORDER BY captured_at DESC, id) <= 50")(lambda w: ingest.capped(w.media, ["zone_id", "source_id"], 50, [F.desc("captured_at"), "id"]).select("id"))
query("fair_sample", f"""{JUDGED}, t AS (SELECT id, zone_id, md5(CAST(id AS VARCHAR) || ':0') AS h FROM media), r AS (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY h, id) AS turn FROM t) SELECT id, zone_id FROM r ORDER BY turn, h, id LIMIT 100""")(lambda w: ingest.fair_sample(w.media.select("id", "zone_id"), "zone_id", 100))

query("upsert_summary", f"""{BASE}, old AS (SELECT zone_id, species_id, 1 AS records, DATE '1990-01-01' AS first_record, sources AS score FROM summary WHERE species_id % 2 = 0), new AS (SELECT zone_id, species_id, records, first_record, sources AS score FROM summary WHERE species_id % 3 = 0)
    SELECT coalesce(o.zone_id, n.zone_id) AS zone_id, coalesce(o.species_id, n.species_id) AS species_id, coalesce(n.records, o.records) AS records, coalesce(o.first_record, n.first_record) AS first_record, CASE WHEN o.zone_id IS NOT NULL AND (n.score IS NULL OR n.score <= 2) THEN o.score ELSE n.score END AS score
    FROM old o FULL JOIN new n ON n.zone_id = o.zone_id AND n.species_id = o.species_id""")(
    lambda w: maintenance.upsert(
        w.summary.filter("species_id % 2 = 0").select("zone_id", "species_id", F.lit(1).cast("long").alias("records"), F.lit("1990-01-01").cast("date").alias("first_record"), F.col("sources").alias("score")),
        w.summary.filter("species_id % 3 = 0").select("zone_id", "species_id", "records", "first_record", F.col("sources").alias("score")),
        ["zone_id", "species_id"], keep=["first_record"], prefer={"score": F.col("new_score") > 2},
    )
)
query("remove_unresearched", f"""{BASE} SELECT d.media_id, d.species_id, z.country FROM detections d JOIN zones z ON z.id = d.zone_id WHERE NOT EXISTS (SELECT 1 FROM origin o WHERE o.species_id = d.species_id AND o.country = z.country AND o.is_invasive AND o.origin_class = 'alien')
    OR d.species_id IN (SELECT species_id FROM researched)""")(
    lambda w: maintenance.remove_unresearched(w.detections.join(w.zones.select(F.col("id").alias("zone_id"), "country"), "zone_id"), views.alien_invasive(w.status), w.researched).select("media_id", "species_id", "country")
)
query("claimed_media", f"{JUDGED} SELECT id, 'processing' AS status FROM (SELECT * FROM media WHERE status = 'new' ORDER BY captured_at, id LIMIT 200) x")(lambda w: maintenance.claim(w.media, 200).select("id", "status"))
query("requeued_media", f"{JUDGED} SELECT CASE WHEN status = 'failed' AND captured_at < TIMESTAMP '1998-01-01' THEN 'new' WHEN status = 'failed' THEN 'processing' ELSE status END AS status, count(*) AS n FROM media GROUP BY 1")(
    lambda w: maintenance.requeue(w.media.withColumn("status", F.when(F.col("status") == "failed", "processing").otherwise(F.col("status"))), "1998-01-01").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)
query("refreshed_months", f"{BASE} SELECT zone_id, CAST(date_trunc('month', captured_at) AS DATE) AS month, count(*) AS effort FROM media GROUP BY 1, 2")(
    lambda w: maintenance.refreshed_months(views.effort_monthly(w.media.filter("id % 5 != 0")), w.media, w.media.filter("id % 5 = 0"))
)
query("photo_quota", f"""{JUDGED}, ph AS (SELECT id, zone_id AS species_id, source_id = 1 AS in_region FROM media), o AS (SELECT *, row_number() OVER (PARTITION BY species_id, in_region ORDER BY id) AS own FROM ph)
    SELECT id, species_id, in_region FROM o QUALIFY row_number() OVER (PARTITION BY species_id ORDER BY CASE WHEN in_region AND own <= 5 THEN 0 ELSE 1 END, id) <= 20""")(
    lambda w: maintenance.quota_by_region(w.media.select("id", F.col("zone_id").alias("species_id"), (F.col("source_id") == 1).alias("in_region")), 20, 5)
)
query("type_counts", f"{JUDGED} SELECT coalesce(taxon_rank, 'unknown') AS type, count(*) AS n FROM observations GROUP BY 1")(lambda w: maintenance.type_counts(w.observations, "taxon_rank"))
query("stratified_sample", f"""{JUDGED}, k AS (SELECT id AS frame, zone_id AS location, status = 'new' AS empty, md5(CAST(id AS VARCHAR) || ':0') AS h FROM media), r AS (SELECT *, row_number() OVER (PARTITION BY empty, location ORDER BY h, frame) AS turn FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY empty ORDER BY turn, h, frame) AS place FROM r) SELECT frame, location, empty FROM p WHERE place <= CASE WHEN empty THEN 60 ELSE 140 END""")(
    lambda w: maintenance.stratified_sample(w.media.select(F.col("id").alias("frame"), F.col("zone_id").alias("location")), w.media.select(F.col("id").alias("frame"), F.when(F.col("status") == "new", "empty").otherwise("animal").alias("category")), 200)
)
query("crops_per_class", prelude("boxes") + """, b AS (SELECT image, box, label, image % 7 AS location, CAST((x2 - x1) * 640 AS DOUBLE) AS width_px, CAST((y2 - y1) * 480 AS DOUBLE) AS height_px, md5(CAST(image AS VARCHAR) || ':0') AS h FROM boxes),
    o AS (SELECT *, row_number() OVER (PARTITION BY label, image ORDER BY least(width_px, height_px) DESC, box) AS n FROM b WHERE least(width_px, height_px) >= 32), t AS (SELECT *, row_number() OVER (PARTITION BY label, location ORDER BY h, image) AS turn FROM o WHERE n = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, h, image) AS place FROM t) SELECT image, box, label, location FROM p WHERE place <= 50""")(lambda w: maintenance.crops_per_class(w.boxes.select("image", "box", "label", (F.col("image") % 7).alias("location"), ((F.col("x2") - F.col("x1")) * 640).alias("width_px"), ((F.col("y2") - F.col("y1")) * 480).alias("height_px")), 50).select("image", "box", "label", "location"))

# --- text -----------------------------------------------------------------------------------------------------------------------

query("quotes_in_documents", """WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(strip_accents(text)), '\\s+', '', 'g') AS t FROM documents), q AS (SELECT item_id, regexp_replace(lower(strip_accents(text)), '\\s+', '', 'g') AS t FROM benchmark)
    SELECT DISTINCT doc_id, item_id FROM d JOIN q ON contains(d.t, q.t) WHERE q.t <> ''""")(
    lambda w: evidence.quotes_found(w.raw("documents").select("doc_id", "text"), w.raw("benchmark").select("item_id", "text"), "doc_id", "item_id")
)
TAGLESS = r"regexp_replace(regexp_replace(html, '<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
query("html_to_text", rf"SELECT page_id, trim(regexp_replace({decoded_sql('t')}, '[\s\x{{00A0}}]+', ' ', 'g')) AS text FROM (SELECT page_id, {TAGLESS} AS t FROM pages) x")(lambda w: w.raw("pages").select("page_id", text.html_to_text(F.col("html")).alias("text")))
# Every text with a reference of each kind: a name of the table, one without its semicolon, numbers, and what is none.
REFERENCED = "concat('x&', names[CAST(doc_id % {n} AS INT) + 1], 'y &eacute &', 'unknown; &#', doc_id, '; &#x', CAST(doc_id % 10 AS STRING), 'F;', text)"
query("character_references", f"SELECT doc_id, {decoded_sql('t')} AS text FROM (SELECT doc_id, {REFERENCED.format(n=len(html5)).replace('STRING', 'VARCHAR')} AS t FROM (SELECT doc_id, text, {sorted(html5)} AS names FROM documents) x) y")(
    lambda w: w.raw("documents").withColumn("names", F.lit(sorted(html5))).select("doc_id", decoded(F.concat(F.lit("x&"), F.element_at("names", (F.col("doc_id") % len(html5)).cast("int") + 1), F.lit("y &eacute &unknown; &#"), "doc_id", F.lit("; &#x"), (F.col("doc_id") % 10).cast("string"), F.lit("F;"), "text")).alias("text"))
)
query("numbers_in_documents", r"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '(\d),(\d{3})', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(n, '\.?0+$', '') ELSE n END))) AS BIGINT) AS numbers FROM documents")(
    lambda w: w.raw("documents").select("doc_id", F.size(text.numbers_in(F.col("text"))).cast("long").alias("numbers"))
)

query("requests_in_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")(
    lambda w: requests_in_window(w.raw("events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "in_window")
)


def _streamed(w: World) -> DataFrame:
    """Events of the table read as a stream until its end, counted by type and month."""
    raw = w.raw("events")
    stream = w.spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(w.sf_dir)
    name = f"counts_{uuid.uuid4().hex}"
    counts = monthly_counts(stream, "ts", ["event_type"]).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    return w.spark.table(name)


query("streamed_monthly_counts", "SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1, 2")(_streamed)

# --- metrics --------------------------------------------------------------------------------------------------------------------

P = prelude("predictions")
query("outcome_by_kind", f"""{P}, k AS (SELECT kind, count(*) AS n, count(predicted) AS answered, count(*) FILTER (WHERE predicted = truth) AS "right" FROM predictions GROUP BY 1), q AS (SELECT *, "right" / CAST(n AS DOUBLE) AS p, CAST(1.96 AS DOUBLE) AS z FROM k)
    SELECT kind, n, answered, "right", round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM q""")(
    lambda w: digits(metrics.outcome_by_kind(w.predictions), "low", "high")
)
query("confusion", f"{P} SELECT truth, coalesce(predicted, -1) AS predicted, count(*) AS n FROM predictions GROUP BY 1, 2")(lambda w: metrics.confusion(w.predictions))
query("per_class", f"""{P}, c AS (SELECT l.label, count(*) FILTER (WHERE truth = l.label) AS support, count(*) FILTER (WHERE predicted = l.label) AS named, count(*) FILTER (WHERE truth = l.label AND predicted = l.label) AS hits FROM predictions, (SELECT 0 AS label UNION ALL SELECT 1) l GROUP BY 1),
    r AS (SELECT *, hits / CAST(nullif(named, 0) AS DOUBLE) AS p, hits / CAST(nullif(support, 0) AS DOUBLE) AS q FROM c) SELECT label, support, round(p, 9) AS precision, round(q, 9) AS recall, CASE WHEN p > 0 AND q > 0 THEN round(2 * p * q / (p + q), 9) END AS f1 FROM r""")(
    lambda w: digits(metrics.per_class(w.predictions), "precision", "recall", "f1")
)
query("calibration", f"{P}, b AS (SELECT ceil(confidence * 10) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(predicted = truth AS INT)) AS a FROM predictions WHERE predicted IS NOT NULL AND confidence > 0 GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 9) AS error FROM b")(lambda w: digits(metrics.calibration(w.predictions), "error"))
query("threshold_table", f"{P} SELECT t.t AS t, count(p.id) AS answered, count(*) FILTER (WHERE p.predicted = p.truth) AS \"right\" FROM range(21) t(t) LEFT JOIN predictions p ON p.predicted IS NOT NULL AND floor(p.confidence * 20) >= t.t GROUP BY 1")(lambda w: metrics.threshold_table(w.predictions))
query("image_level", f"""{P}, c AS (SELECT count(*) FILTER (WHERE confidence >= 0.2 AND truth = 1) AS tp, count(*) FILTER (WHERE confidence >= 0.2 AND truth <> 1) AS fp, count(*) FILTER (WHERE confidence < 0.2 AND truth = 1) AS fn, count(*) FILTER (WHERE confidence < 0.2 AND truth <> 1) AS tn FROM predictions)
    SELECT tp, fp, fn, tn, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 9) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 9) AS recall, round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 9) AS false_alarms FROM c""")(lambda w: digits(metrics.image_level(w.predictions, 0.2), "precision", "recall", "false_alarms"))
query("visible_boxes", prelude("boxes") + """, c AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, greatest(0, least(x1, 1)) AS a1, greatest(0, least(y1, 1)) AS b1, greatest(0, least(x2, 1)) AS a2, greatest(0, least(y2, 1)) AS b2 FROM boxes)
    SELECT image, box, label, round(a1, 9) AS x1, round(b1, 9) AS y1, round(a2, 9) AS x2, round(b2, 9) AS y2, round(score, 9) AS score FROM c WHERE area > 0 AND (a2 - a1) * (b2 - b1) >= 0.5 * area""")(
    lambda w: digits(metrics.visible(w.boxes), "x1", "y1", "x2", "y2", "score")
)
query("dangerous_by_kind", f"{P} SELECT kind, count(*) AS n, count(*) FILTER (WHERE predicted = 1) AS wrong FROM predictions WHERE truth <> 1 GROUP BY 1")(lambda w: metrics.dangerous_by_kind(w.predictions).select("kind", "n", "wrong"))
query("safe_threshold", f"""{P}, g AS (SELECT t, kind, count(*) FILTER (WHERE predicted = 1 AND floor(confidence * 100) >= t) / CAST(count(*) AS DOUBLE) AS rate FROM predictions, range(101) r(t) WHERE truth <> 1 GROUP BY 1, 2)
    SELECT min(t) AS t FROM (SELECT t FROM g GROUP BY 1 HAVING max(rate) <= 0.05) x""")(lambda w: metrics.safe_threshold(w.predictions))
query("log_loss", """WITH l AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 5) AS z FROM embeddings), t AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS temperature)
    SELECT temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / temperature)))) - z[label + 1] / temperature), 6) AS loss FROM l, t WHERE label < len(z) GROUP BY 1""")(
    lambda w: digits(metrics.log_loss(w.raw("embeddings").select(F.transform("embedding", lambda x: x.cast("double") * 5).alias("logits"), F.col("label").alias("truth")).filter(F.col("truth") < F.size("logits")), [0.5, 1.0, 2.0]), "loss", n=6)
)
VISIBLE = """SELECT image, box, label, a1 AS x1, b1 AS y1, a2 AS x2, b2 AS y2, score FROM (SELECT *, (x2 - x1) * (y2 - y1) AS area, greatest(0, least(x1, 1)) AS a1, greatest(0, least(y1, 1)) AS b1, greatest(0, least(x2, 1)) AS a2, greatest(0, least(y2, 1)) AS b2 FROM boxes) c
    WHERE area > 0 AND (a2 - a1) * (b2 - b1) >= 0.5 * area"""


def overlap_sql(a: str, b: str) -> str:
    both = f"greatest(CAST(0 AS DOUBLE), least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(CAST(0 AS DOUBLE), least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    return f"({both}) / greatest(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {both}, CAST(1e-12 AS DOUBLE))"


BOX = "{'box': box, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}"
ORDERED = f"list([{BOX}] ORDER BY score DESC, box, x1, y1)"


def suppressed_sql(boxes: str) -> str:
    """A fold over lists of one box each: the list so far, with the next box if none overlaps it too much."""
    kept = f"list_reduce({ORDERED}, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {overlap_sql('k', 'b[1]')} > CAST(0.45 AS DOUBLE))) > 0 THEN kept ELSE list_concat(kept, b) END)"
    return f"SELECT image, label, unnest(kept, recursive := true) FROM (SELECT image, label, {kept} AS kept FROM ({boxes}) x GROUP BY 1, 2) g"


def matched_sql(found: str, truth: str) -> str:
    """A fold that starts with the true boxes: each found one takes away the one that it overlaps most."""
    numbered = lambda r, order, one=False: f"list({'[' * one}{BOX[:-1]}, 'r': CAST({r} AS BIGINT)}}{']' * one} ORDER BY {order})"
    best = f"list_max(list_transform(free, lambda t: {{'v': {overlap_sql('b[1]', 't')}, 'n': -t.r}}))"
    taken = f"list_transform([{best}], lambda m: list_filter(free, lambda t: NOT coalesce(m.v >= CAST(0.5 AS DOUBLE) AND t.r = -m.n, false)))[1]"
    left = f"len(list_reduce(list_prepend(trues, founds), lambda free, b: {taken}))"
    return f"""SELECT image, n - missed AS hits, len(founds) - n + missed AS extra, missed FROM (SELECT image, founds, len(trues) AS n, {left} AS missed FROM (SELECT image, coalesce(f, []) AS founds, coalesce(m, []) AS trues
    FROM (SELECT image, {numbered("0", "score DESC, box, x1, y1", one=True)} AS f FROM ({found}) x GROUP BY 1) a FULL JOIN (SELECT image, {numbered("r", "r")} AS m FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY box, x1, y1, x2, y2) AS r FROM ({truth}) v) y GROUP BY 1) b USING (image)) z) w"""


MATCHED = matched_sql("SELECT * FROM boxes WHERE score >= 0.3", "SELECT * FROM boxes WHERE truth_score >= 0.3")
query("suppressed_boxes", f"{prelude('boxes')} {suppressed_sql(VISIBLE)}")(lambda w: metrics.suppress(metrics.visible(w.boxes)))
query("matched_boxes", f"{prelude('boxes')} {MATCHED}")(lambda w: (lambda b: metrics.match_boxes(b.filter("score >= 0.3"), b.filter("truth_score >= 0.3")))(w.boxes))
query("class_centres", "SELECT label, i - 1 AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i")(lambda w: digits(metrics.class_centres(w.raw("embeddings")).withColumn("at", F.col("at").cast("long")), "x", n=6))
query("normalised_embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l1 FROM embeddings")(
    lambda w: digits(w.raw("embeddings").select("vec_id", F.aggregate(metrics.l2_normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + F.abs(x)).alias("l1")), "l1", n=6)
)
