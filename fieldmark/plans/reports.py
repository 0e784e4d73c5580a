"""Queries of lists, tables, layers and ingest outcomes, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldmark.functions import geo, pixels
from fieldmark.operators import detect, maintenance, metrics, reports, serving, summary
from fieldmark.plans import catalogue
from fieldmark.plans.catalogue import BASE, EVENTS_AS_OF, JUDGED, ORACLE_SQL, PAIR_CELLS, QUERIES, YEARS, P, World, digits, points_sql, query  # noqa: F401
from fieldmark.sources.testdata import prelude

NAMED = "JOIN species sp ON sp.id = x.species_id"
CELLS_SQL = "cells AS (SELECT zone_id, cx, cy, count(*) AS records FROM points GROUP BY 1, 2, 3)"


def cells(w: World):
    return serving.hotspot_grid(w.points())


# --- lists ------------------------------------------------------------------------------------------------------------------------

query("hotspot_order", f"{BASE}, {points_sql()}, {CELLS_SQL} SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY records DESC, cx, cy) AS place FROM cells")(lambda w: reports.placed(cells(w).select("zone_id", "cx", "cy", "records"), ["zone_id"], F.desc("records"), "cx", "cy"))
query("alerts_list", f"WITH x AS ({ORACLE_SQL['first_record_alerts']}), {BASE.removeprefix('WITH ')} SELECT z.slug, sp.scientific_name, first_record, severity, row_number() OVER (ORDER BY first_record DESC, slug, scientific_name) AS place FROM x {NAMED} JOIN zones z ON z.id = x.zone_id ORDER BY place LIMIT 50")(
    lambda w: reports.alerts_list(catalogue.analytics.first_record_alerts(w.summary, w.media, w.findings, w.playbooks, catalogue.AS_OF), w.zones, w.species)
)
query("playbooks_order", f"{BASE} SELECT sp.scientific_name, x.method, x.design, x.doi, row_number() OVER (PARTITION BY sp.scientific_name ORDER BY x.method, x.doi, x.design) AS place FROM playbooks x {NAMED} WHERE x.verified")(lambda w: reports.playbooks_in_order(w.playbooks, w.species))
query("findings_order", f"""{BASE}, x AS (SELECT CAST(z.id AS BIGINT) AS zone_id, f.zone_id IS NULL AS general, f.species_id, f.finding_type, f.certainty, f.doi, coalesce(s.records, 0) AS records FROM findings f CROSS JOIN zones z
    LEFT JOIN summary s ON s.zone_id = z.id AND s.species_id = f.species_id WHERE f.verified AND (f.zone_id = z.id OR f.zone_id IS NULL AND s.records > 0))
    SELECT zone_id, general, sp.scientific_name, finding_type, certainty, doi, records, records > 0 AS recorded, row_number() OVER (PARTITION BY zone_id ORDER BY general, scientific_name, finding_type, doi) AS place FROM x {NAMED}""")(lambda w: reports.findings_in_order(w.findings, w.summary, w.species))
query("invasive_order", f"{BASE} SELECT zone_id, sp.scientific_name, records, year(first_record) AS first_year, year(last_record) AS last_year, row_number() OVER (PARTITION BY zone_id ORDER BY records DESC, scientific_name) AS place FROM summary x {NAMED}")(lambda w: reports.invasive_in_order(w.summary, w.species))
query("species_without_photo", f"{BASE}, c AS (SELECT species_id, CAST(sum(records) AS BIGINT) AS records FROM summary WHERE species_id NOT IN (SELECT id FROM species WHERE common_name IS NULL) GROUP BY 1) SELECT x.species_id, sp.scientific_name, records, row_number() OVER (ORDER BY records DESC, x.species_id) AS place FROM c x {NAMED} ORDER BY place LIMIT 50")(
    lambda w: reports.species_without_photo(w.species, w.summary, w.species.filter("common_name IS NULL").select(F.col("id").alias("species_id")), 50)
)
query("scatter_points", f"{BASE}{PAIR_CELLS} SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY invasive_records DESC, cx, cy) AS place, round(invasive_records / CAST(all_records AS DOUBLE), 4) AS share, round(richness, 3) AS richness, all_records FROM cells WHERE richness IS NOT NULL QUALIFY place <= 400")(lambda w: reports.scatter_points(w.cooccurrence_cells))
query("best_boxes", prelude("boxes") + " SELECT image, box, label, score, row_number() OVER (PARTITION BY image ORDER BY score DESC, box) AS place FROM boxes QUALIFY place <= 300")(lambda w: reports.best_boxes(w.boxes))
SOFTMAX = "WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 5) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


def centres(w: World) -> np.ndarray:
    """The mean vector of each label, a row a label: as many numbers as labels times components."""
    rows = metrics.class_centres(w.raw("embeddings")).collect()
    out = np.zeros((1 + max(r["label"] for r in rows), 1 + max(r["at"] for r in rows)))
    for r in rows:
        out[r["label"], r["at"]] = r["x"]
    return out


def softmaxed(w: World):
    return w.raw("embeddings").select("vec_id", metrics.softmax(F.transform("embedding", lambda x: x.cast("double") * 5)).alias("p"))


query("top_classes", f"{SOFTMAX}, r AS (SELECT vec_id, unnest(p) AS probability, unnest(range(len(p))) AS label FROM p) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, label) AS place, label, round(probability, 6) AS probability FROM r QUALIFY place <= 3")(lambda w: digits(reports.top_classes(softmaxed(w), "vec_id", "p"), "probability", n=6))
query("softmax", f"{SOFTMAX} SELECT vec_id, round(list_max(p), 6) AS best, round(list_sum(p), 6) AS total FROM p")(lambda w: digits(softmaxed(w).select("vec_id", F.array_max("p").alias("best"), F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("total")), "best", "total", n=6))
query("evidence_ranking", f"""{BASE}, x AS (SELECT species_id, doi, 'finding' AS kind, certainty AS design FROM findings WHERE verified UNION ALL SELECT species_id, doi, 'management', design FROM playbooks WHERE verified),
    c AS (SELECT sp.scientific_name, count(DISTINCT doi) AS papers, count(*) FILTER (WHERE kind = 'finding') AS finding, count(*) FILTER (WHERE kind = 'management') AS management, """ + ", ".join(f"count(*) FILTER (WHERE design = '{d}') AS {d}" for d in ("experimental", "observational", "review", "modelled")) + f""" FROM x {NAMED} GROUP BY x.species_id, 1)
    SELECT *, row_number() OVER (ORDER BY papers DESC, scientific_name) AS place FROM c ORDER BY place LIMIT 50""")(lambda w: reports.evidence_ranking(w.findings, w.playbooks, w.species))
query("busiest_park", f"{BASE} SELECT z.slug, count(*) AS records FROM records r JOIN zones z ON z.id = r.zone_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda w: reports.busiest_park(w.records, w.zones))

# --- tables -----------------------------------------------------------------------------------------------------------------------

query("year_totals", f"{BASE}, {points_sql()} SELECT zone_id, yr AS year, count(*) AS records FROM points GROUP BY 1, 2")(lambda w: reports.totals_of(cells(w), "year"))
query("source_totals", f"{BASE}, {points_sql()} SELECT zone_id, source, count(*) AS records FROM points GROUP BY 1, 2")(lambda w: reports.totals_of(cells(w), "source"))
REFUSED = ORACLE_SQL["refused_by_reason"]
SUMS = [f"CAST(coalesce(sum(refused) FILTER (WHERE source_id = {s}), 0) AS BIGINT)" for s in range(5)]
query("refused_table", f"SELECT *, row_number() OVER (ORDER BY total DESC, reason) AS place FROM (SELECT reason, {', '.join(f'{x} AS source_{s}' for s, x in enumerate(SUMS))}, CAST(sum(refused) AS BIGINT) AS total FROM ({REFUSED}) x GROUP BY 1) y")(
    lambda w: reports.refused_table(summary.refused_by_reason(w.runs, [1, 2]), [0, 1, 2, 3, 4])
)
query("invasive_shares", f"{BASE} SELECT z.slug, coalesce(d.n, 0) AS records, coalesce(r.n, 0) AS invasive, round(CAST(100 AS DOUBLE) * coalesce(r.n, 0) / nullif(d.n, 0), 1) AS percent, coalesce(r.s, 0) AS species FROM zones z LEFT JOIN (SELECT zone_id, count(*) AS n FROM detections GROUP BY 1) d ON d.zone_id = z.id LEFT JOIN (SELECT zone_id, count(*) AS n, count(DISTINCT species_id) AS s FROM records GROUP BY 1) r ON r.zone_id = z.id")(
    lambda w: reports.invasive_shares(w.zones, w.detections, w.records)
)
query("covered_shares", f"{BASE}, c AS (SELECT zone_id, CAST(sum(records) AS BIGINT) AS records, CAST(coalesce(sum(records) FILTER (WHERE species_id IN (SELECT species_id FROM findings WHERE verified)), 0) AS BIGINT) AS covered FROM summary GROUP BY 1) SELECT *, round(CAST(100 AS DOUBLE) * covered / records, 0) AS percent FROM c")(lambda w: reports.covered_shares(w.summary, w.findings))
query("capped_parks", f"{BASE} SELECT zone_id, source_id, count(*) AS records, CAST(max(captured_at) AS DATE) AS latest FROM detections GROUP BY 1, 2 HAVING count(*) >= 480")(lambda w: reports.capped_parks(w.detections, 480))
query("unresearched", f"{BASE} SELECT count(*) AS missing, count(*) = 0 AS subset FROM (SELECT species_id FROM summary EXCEPT SELECT species_id FROM researched) x")(lambda w: reports.unresearched(w.summary, w.researched))
query("names_to_species", f"{BASE}, n AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN 'nothing ' || id ELSE upper(scientific_name) END AS name FROM species) SELECT name, min(s.id) AS species_id FROM n LEFT JOIN species s ON lower(s.scientific_name) = lower(name) GROUP BY 1")(
    lambda w: reports.names_to_species(w.species.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("nothing "), "id")).otherwise(F.upper("scientific_name")).alias("name")), w.species)
)

# --- statistics -------------------------------------------------------------------------------------------------------------------

PAIRS = ORACLE_SQL["cooccurrence"]
GATED = f"SELECT * REPLACE (coalesce(reason, CASE WHEN rho IS NULL OR isnan(rho) THEN 'constant' END) AS reason, CASE WHEN NOT isnan(rho) THEN rho END AS rho) FROM ({PAIRS}) x"
query("pairs_layer", f"""SELECT zone_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'insufficient' END AS status, reason,
    CASE WHEN reason IS NOT NULL THEN 'squares with 10 native records: 20; of these with invasive records: 5' END AS needs, CASE WHEN reason IS NULL THEN '{reports.CAUTION_PAIRS.replace("'", "''")}' END AS caution, cells, invaded, rho FROM ({GATED}) y""")(
    lambda w: digits(reports.pairs_layer(w.cooccurrence_cells.withColumn("richness", F.round("richness", 9)), draws=0), "rho", n=6)
)
query("pairs_interval")(lambda w: reports.pairs_layer(w.cooccurrence_cells).select("zone_id", "status", "low", "high"))
MK = """SELECT t.zone_id, CAST(n AS BIGINT) AS n, s, round(s / (n * (n - 1) / CAST(2 AS DOUBLE)), 6) AS tau, round(slope, 6) AS slope FROM (SELECT zone_id, count(*) AS n FROM good GROUP BY 1) t JOIN
    (SELECT a.zone_id, CAST(sum(sign(b.RATE - a.RATE)) AS BIGINT) AS s, median((b.RATE - a.RATE) / (b.year - a.year)) AS slope FROM good a JOIN good b ON a.zone_id = b.zone_id AND a.year < b.year GROUP BY 1) p ON p.zone_id = t.zone_id WHERE n >= 4"""
LAYER = f"""{BASE}{YEARS}, g AS (SELECT zone_id, count(*) AS years_with_data, count(*) FILTER (WHERE effort >= 15) AS usable_years, CAST(sum(invasive) AS BIGINT) AS invasive_records, min(year) FILTER (WHERE effort >= 15) AS y0, max(year) FILTER (WHERE effort >= 15) AS y1 FROM years GROUP BY 1),
    layer AS (SELECT *, CASE WHEN usable_years < 6 OR invasive_records < 30 THEN 'insufficient' ELSE 'ok' END AS status FROM g),
    good AS (SELECT zone_id, year, invasive / CAST(effort AS DOUBLE) AS invasive, native / CAST(effort AS DOUBLE) AS native FROM years WHERE effort >= 15 AND zone_id IN (SELECT zone_id FROM layer WHERE status = 'ok')),
    a AS ({MK.replace("RATE", "invasive")}), b AS ({MK.replace("RATE", "native")})"""
query("trend_layer", f"""{LAYER} SELECT l.zone_id, status, CASE WHEN usable_years < 6 THEN 'years' WHEN invasive_records < 30 THEN 'records' END AS reason,
    CASE WHEN status <> 'ok' THEN 'years of 15 observations or more: 6; invasive records: 30' END AS needs, CASE WHEN status = 'ok' THEN '{reports.CAUTION_TREND.replace("'", "''")}' END AS caution, years_with_data, usable_years, invasive_records,
    CASE WHEN status = 'ok' THEN y0 END AS first_year, CASE WHEN status = 'ok' THEN y1 END AS last_year, a.n AS invasive_n, a.s AS invasive_s, a.tau AS invasive_tau, a.slope AS invasive_slope, b.n AS native_n, b.s AS native_s, b.tau AS native_tau, b.slope AS native_slope
    FROM layer l LEFT JOIN a ON a.zone_id = l.zone_id LEFT JOIN b ON b.zone_id = l.zone_id""")(
    lambda w: digits(reports.trend_layer(w.trend_years).drop("invasive_p", "native_p"), "invasive_tau", "invasive_slope", "native_tau", "native_slope", n=6)
)
query("trend_line", f"""{LAYER}, s AS ({MK.replace("round(slope, 6)", "slope").replace("RATE", "invasive")}) SELECT g.zone_id, round(median(g.invasive - s.slope * g.year), 5) AS intercept, round(max(s.slope), 6) AS slope FROM good g JOIN s ON s.zone_id = g.zone_id GROUP BY 1""")(
    lambda w: (lambda rows: digits(digits(reports.theil_sen_line(rows, catalogue.analytics.mann_kendall(rows, "year", "rate", "zone_id"), "year", "rate", "zone_id"), "intercept", n=5), "slope", n=6))(
        w.trend_years.filter("effort >= 15").join(reports.trend_layer(w.trend_years).filter("status = 'ok'").select("zone_id"), "zone_id", "left_semi").withColumn("rate", F.col("invasive") / F.col("effort").cast("double"))
    )
)
query("tests_corrected")(lambda w: reports.bonferroni(reports.trend_layer(w.trend_years).select("zone_id", F.col("invasive_p").alias("p")), "p"))
REPORT = f"""WITH pl AS ({ORACLE_SQL['pairs_layer']}), tl AS ({ORACLE_SQL['trend_layer']}), fo AS ({ORACLE_SQL['findings_order']}), io AS ({ORACLE_SQL['invasive_order']}), {BASE.removeprefix('WITH ')},
    tot AS (SELECT z.id AS zone_id, count(d.media_id) AS n, count(DISTINCT d.species_id) AS s FROM zones z LEFT JOIN detections d ON d.zone_id = z.id GROUP BY 1)
    SELECT zone_id, 'total' AS part, 1 AS place, 'observations' AS key, CAST(n AS VARCHAR) AS value FROM tot UNION ALL SELECT zone_id, 'total', 2, 'species', CAST(s AS VARCHAR) FROM tot
    UNION ALL SELECT zone_id, 'invasive', place, scientific_name, CAST(records AS VARCHAR) FROM io
    UNION ALL SELECT zone_id, 'finding', place, scientific_name, finding_type || ' ' || certainty || ' ' || doi || CASE WHEN recorded THEN ' recorded' ELSE ' not recorded' END FROM fo
    UNION ALL SELECT zone_id, 'cooccurrence', 0, 'status', coalesce('insufficient: ' || reason, status) FROM pl UNION ALL SELECT zone_id, 'cooccurrence', 1, 'cells', CAST(cells AS VARCHAR) FROM pl UNION ALL SELECT zone_id, 'cooccurrence', 2, 'invaded', CAST(invaded AS VARCHAR) FROM pl
    UNION ALL SELECT zone_id, 'cooccurrence', 3, 'rho', printf('%.6f', rho) FROM pl WHERE status = 'ok'
    UNION ALL SELECT zone_id, 'trend', 0, 'status', coalesce('insufficient: ' || reason, status) FROM tl UNION ALL SELECT zone_id, 'trend', 1, 'usable_years', CAST(usable_years AS VARCHAR) FROM tl UNION ALL SELECT zone_id, 'trend', 2, 'invasive_records', CAST(invasive_records AS VARCHAR) FROM tl
    UNION ALL SELECT zone_id, 'trend', 3, 'invasive_s', CAST(invasive_s AS VARCHAR) FROM tl WHERE status = 'ok' UNION ALL SELECT zone_id, 'trend', 4, 'native_s', CAST(native_s AS VARCHAR) FROM tl WHERE status = 'ok'"""
query("report_lines", f"SELECT CAST(zone_id AS BIGINT) AS zone_id, part, CAST(place AS BIGINT) AS place, key, value FROM ({REPORT}) y")(
    lambda w: reports.report_lines(w.zones, w.detections, w.summary, w.species, w.findings, reports.pairs_layer(w.cooccurrence_cells.withColumn("richness", F.round("richness", 9)), draws=0), reports.trend_layer(w.trend_years)).withColumn("zone_id", F.col("zone_id").cast("long"))
)

# --- maps -------------------------------------------------------------------------------------------------------------------------

query("zone_features")(lambda w: reports.zone_features(w.polygons, serving.zones_overview(w.polygons, w.detections, w.records, w.media)))
query("zone_collection")(lambda w: reports.feature_collection(reports.zone_features(w.polygons, serving.zones_overview(w.polygons, w.detections, w.records, w.media))))
R2 = f"CAST({geo.AUTHALIC_KM} AS DOUBLE) * CAST({geo.AUTHALIC_KM} AS DOUBLE)"
def _below(lat: str, width: str) -> str:
    """Area between the equator and a side between two points of one latitude, for an equatorial radius of one."""
    e = geo.ECCENTRICITY
    x = f"({e!r}::DOUBLE * sin(radians({lat})))"
    beta = f"asin({1 - e * e!r}::DOUBLE * (sin(radians({lat})) / (1 - {x} * {x}) + ln((1 + {x}) / (1 - {x})) / {2 * e!r}::DOUBLE) / {geo.POLE_ZONE!r}::DOUBLE)"
    return f"{geo.POLE_ZONE!r}::DOUBLE * atan(tan(radians({width}::DOUBLE) / 2) * sin({beta}))"


query("ellipsoid_areas", f"""{prelude("zones")} SELECT id AS zone_id, round({geo.EQUATOR_KM**2!r}::DOUBLE * (CASE WHEN is_corner
    THEN {_below("lat0 + 0.4::DOUBLE", "0.25")} + {_below("lat0 + 0.2::DOUBLE", "0.25")} ELSE {_below("lat0 + 0.4::DOUBLE", "0.5")} END - {_below("lat0", "0.5")}), 3) AS area_km2 FROM zones""")(
    lambda w: digits(reports.ellipsoid_areas(w.polygons), "area_km2", n=3)
)
query("geodesic_areas", f"""{prelude("zones")} SELECT id AS zone_id, round({R2} * (radians(CAST(0.5 AS DOUBLE)) * (sin(radians(lat0 + CAST(0.4 AS DOUBLE))) - sin(radians(lat0))) - CASE WHEN is_corner THEN radians(CAST(0.25 AS DOUBLE)) * (sin(radians(lat0 + CAST(0.4 AS DOUBLE))) - sin(radians(lat0 + CAST(0.2 AS DOUBLE)))) ELSE 0 END), 3) AS area_km2 FROM zones""")(
    lambda w: digits(reports.geodesic_areas(w.polygons), "area_km2", n=3)
)
def _halved(ring):
    """The ring with a point in the middle of each side."""
    following = lambda i, c: F.element_at(ring, (i + 1) % F.size(ring) + 1)[c]
    return F.flatten(F.transform(ring, lambda p, i: F.array(p, F.struct(((p["x"] + following(i, "x")) / 2).alias("x"), ((p["y"] + following(i, "y")) / 2).alias("y")))))


query("simplified_zones", f"{prelude('zones')} SELECT id AS zone_id, CAST(CASE WHEN is_corner THEN 7 ELSE 5 END AS BIGINT) AS points FROM zones")(
    lambda w: geo.simplify(w.polygons.withColumn("rings", F.transform("rings", _halved))).select(F.col("id").alias("zone_id"), F.size(F.col("rings")[0]).cast("long").alias("points"))
)
query("media_in_rectangle", f"{JUDGED} SELECT id, coalesce(lon BETWEEN -60 AND -19.8 AND lat BETWEEN -20 AND 0.2, false) AS inside FROM media")(lambda w: w.media.select("id", reports.in_rectangle(F.col("lon"), F.col("lat"), -60, -20, -19.8, 0.2).alias("inside")))
COUNTIES = [("nation_1", "Narok", "Mara"), ("nation_1", "Narok", "Trans Mara"), ("nation_3", "Occitanie", "Gard"), ("nowhere", "x", "y")]
query("county_coverage", f"{prelude('zones')} SELECT id AS zone_id, unnest(CASE slug WHEN 'nation_1' THEN ['Narok/Mara', 'Narok/Trans Mara'] ELSE ['Occitanie/Gard'] END) AS county FROM zones WHERE slug IN ('nation_1', 'nation_3')")(lambda w: reports.county_coverage(w.zones, COUNTIES).select("zone_id", F.explode("counties").alias("county")))

# --- ingest and upkeep --------------------------------------------------------------------------------------------------------------

SEEN = """obs AS (SELECT * REPLACE (CASE WHEN external_id % 43 = 0 THEN NULL ELSE taxon_name END AS taxon_name) FROM judged),
    o1 AS (SELECT *, CASE WHEN reason IN ('duplicate_of_inaturalist', 'not_a_specimen') THEN reason WHEN lat IS NULL OR lon IS NULL OR taxon_name IS NULL THEN 'unparseable' ELSE reason END AS why FROM obs),
    o2 AS (SELECT o.source_id, o.external_id, o.why, o.taxon_name, min(z.id) AS zone FROM o1 o LEFT JOIN zones z ON o.lon > z.lon0 AND o.lon < z.lon0 + 0.5 AND o.lat > z.lat0 AND o.lat < z.lat0 + CAST(0.4 AS DOUBLE) AND NOT (z.is_corner AND o.lon >= z.lon0 + 0.25 AND o.lat >= z.lat0 + CAST(0.2 AS DOUBLE)) GROUP BY 1, 2, 3, 4),
    outcomes AS (SELECT source_id, external_id, coalesce(why, CASE WHEN zone IS NULL THEN 'outside_zone' WHEN external_id % 10 = 0 THEN 'skipped_dupe' WHEN CAST(substr(taxon_name, 7) AS INT) % 5 = 0 AND z.country IN ('KE', 'FR') THEN 'invasive_without_paper' ELSE 'stored' END) AS outcome FROM o2 LEFT JOIN zones z ON z.id = o2.zone)"""


def outcomes(w: World):
    rows = w.observations.withColumn("taxon_name", F.when(F.col("external_id") % 43 != 0, F.col("taxon_name")))
    bad = w.spark.range(40).select(F.concat(F.lit("Taxon "), F.col("id") * 5).alias("taxon_name"), F.explode(F.array(F.lit("KE"), F.lit("FR"))).alias("country"))
    return reports.outcomes(rows, w.polygons, w.observations.filter("external_id % 10 = 0"), bad, EVENTS_AS_OF)


query("ingest_outcomes", f"{JUDGED}, {SEEN} SELECT * FROM outcomes")(outcomes)
query("run_ledger", f"{JUDGED}, {SEEN} SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'stored') AS stored, count(*) FILTER (WHERE outcome = 'skipped_dupe') AS skipped_dupe FROM outcomes GROUP BY 1")(lambda w: reports.run_ledger(outcomes(w)).drop("rejected"))
query("rejected_map", f"{JUDGED}, {SEEN} SELECT source_id, outcome AS reason, count(*) AS n FROM outcomes WHERE outcome NOT IN ('stored', 'skipped_dupe') GROUP BY 1, 2")(lambda w: reports.run_ledger(outcomes(w)).select("source_id", F.explode("rejected").alias("reason", "n")))
query("merge_by_name", f"""{JUDGED}, st AS (SELECT CAST(id AS BIGINT) AS id, CASE WHEN id % 2 = 0 THEN CAST(id AS BIGINT) END AS gbif_key, CASE WHEN id % 4 = 0 THEN CAST(id * 10 AS BIGINT) END AS inat_id, scientific_name, kingdom, common_name FROM species),
    inc AS (SELECT CAST(id AS BIGINT) AS seq, CASE WHEN id % 2 = 0 THEN CAST(id + 50 AS BIGINT) END AS gbif_key, CASE WHEN id % 3 = 0 THEN CAST((id + 20) * 10 AS BIGINT) END AS inat_id, CASE WHEN id % 5 = 0 THEN 'fresh ' || (id % 7) ELSE upper(scientific_name) END AS scientific_name, CASE WHEN id % 11 = 0 THEN NULL ELSE kingdom END AS kingdom, CASE WHEN id % 6 = 0 THEN 'called ' || id END AS common_name FROM species),
    sg AS (SELECT *, CASE WHEN gbif_key IS NOT NULL THEN 'k' || gbif_key ELSE 'n' || lower(scientific_name) || '|' || coalesce(kingdom, '?') END AS g FROM st), ig AS (SELECT *, CASE WHEN gbif_key IS NOT NULL THEN 'k' || gbif_key ELSE 'n' || lower(scientific_name) || '|' || coalesce(kingdom, '?') END AS g FROM inc),
    fc AS (SELECT g, arg_min(inat_id, seq) AS inat_id, min(seq) AS seq FROM ig WHERE inat_id IS NOT NULL AND inat_id NOT IN (SELECT inat_id FROM st WHERE inat_id IS NOT NULL) AND g NOT IN (SELECT g FROM sg WHERE inat_id IS NOT NULL) GROUP BY 1),
    cl AS (SELECT inat_id, arg_min(g, seq) AS g FROM fc GROUP BY 1),
    r AS (SELECT g, min(seq) AS first, max(gbif_key) AS k, arg_max(scientific_name, seq) AS nn, arg_min(scientific_name, seq) AS fn, arg_max(kingdom, seq) FILTER (WHERE kingdom IS NOT NULL) AS nk, arg_min(common_name, seq) FILTER (WHERE common_name IS NOT NULL) AS nc FROM ig GROUP BY 1)
    SELECT coalesce(s.id, (SELECT max(id) FROM st) + 1 + r.first) AS id, coalesce(s.gbif_key, r.k) AS gbif_key, coalesce(s.inat_id, cl.inat_id) AS inat_id, CASE WHEN coalesce(s.gbif_key, r.k) IS NOT NULL THEN coalesce(nn, s.scientific_name) ELSE coalesce(s.scientific_name, fn) END AS scientific_name,
    coalesce(nk, s.kingdom) AS kingdom, coalesce(s.common_name, nc) AS common_name FROM sg s FULL JOIN r ON r.g = s.g LEFT JOIN cl ON cl.g = r.g""")(
    lambda w: maintenance.merge_by_name(
        w.species.select(F.col("id").cast("long").alias("id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("long")).alias("gbif_key"), F.when(F.col("id") % 4 == 0, (F.col("id") * 10).cast("long")).alias("inat_id"), "scientific_name", "kingdom", "common_name"),
        w.species.select(F.col("id").cast("long").alias("seq"), F.when(F.col("id") % 2 == 0, (F.col("id") + 50).cast("long")).alias("gbif_key"), F.when(F.col("id") % 3 == 0, ((F.col("id") + 20) * 10).cast("long")).alias("inat_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("fresh "), F.col("id") % 7)).otherwise(F.upper("scientific_name")).alias("scientific_name"), F.when(F.col("id") % 11 != 0, F.col("kingdom")).alias("kingdom"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("called "), "id")).alias("common_name")),
    )
)
query("prune_owned", f"{BASE} SELECT id, doi FROM findings WHERE NOT verified OR id % 4 <> 1")(lambda w: maintenance.prune_owned(w.findings.select("id", "doi", F.when(F.col("verified"), "loader").alias("owner")), w.findings.filter("id % 4 <> 1").select("id"), ["id"], "loader").select("id", "doi"))
query("specimens_only", f"{JUDGED} SELECT id, source_id FROM media WHERE NOT (source_id = 2 AND id % 5 = 0)")(lambda w: maintenance.drop_other_basis(w.media, 2, w.media.select("id", F.when(F.col("id") % 5 == 0, "observation").otherwise("specimen").alias("basis"))).select("id", "source_id"))
query("rename_source", f"{prelude('sources')} SELECT id, CASE WHEN name = 'high' THEN 'highest' ELSE name END AS name FROM sources")(
    lambda w: maintenance.rename_source(maintenance.rename_source(maintenance.rename_source(w.sources, "high", "highest"), "high", "highest"), "low", "urgent")
)

# --- metrics ------------------------------------------------------------------------------------------------------------------------

query("box_level", f"{prelude('boxes')}, m AS ({catalogue.MATCHED}) SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(extra) AS BIGINT) AS extra, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(hits) AS DOUBLE) / (sum(hits) + sum(extra)) AS precision, CAST(sum(hits) AS DOUBLE) / (sum(hits) + sum(missed)) AS recall FROM m")(lambda w: metrics.box_level(metrics.match_boxes(w.boxes.filter("score >= 0.3"), w.boxes.filter("truth_score >= 0.3"))))
query("recall_by_category", prelude("boxes") + " , i AS (SELECT image, min(label) AS category FROM boxes GROUP BY 1) SELECT category, count(*) AS images, round(count(*) FILTER (WHERE image IN (SELECT image FROM boxes WHERE score >= 0.98)) / CAST(count(*) AS DOUBLE), 3) AS recall FROM i GROUP BY 1")(
    lambda w: metrics.recall_by_category(w.boxes.groupBy("image").agg(F.min("label").alias("category")), w.boxes, 0.98)
)
query("throughput", "SELECT count(*) AS items, round(count(*) / sum(s), 2) AS per_second, round(median(s) * 1000, 1) AS median_ms FROM (SELECT (event_id % 97 + 1) / CAST(1000 AS DOUBLE) AS s FROM events) x")(lambda w: metrics.throughput(w.raw("events").select(((F.col("event_id") % 97 + 1) / F.lit(1000.0)).alias("s")), "s"))
query("majority_baseline", f"{P} SELECT max(n) AS most, CAST(sum(n) AS BIGINT) AS \"rows\", max(n) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT truth, count(*) AS n FROM predictions GROUP BY 1) x")(lambda w: metrics.majority_baseline(w.predictions, "truth"))
query("outcome_shares", f"{P} SELECT kind, count(*) FILTER (WHERE predicted = truth) / CAST(count(*) AS DOUBLE) AS named_right, (count(predicted) - count(*) FILTER (WHERE predicted = truth)) / CAST(count(*) AS DOUBLE) AS named_wrong, (count(*) - count(predicted)) / CAST(count(*) AS DOUBLE) AS unknown FROM predictions GROUP BY 1")(lambda w: metrics.outcome_shares(metrics.outcome_by_kind(w.predictions)))
query("observer_hash", "SELECT DISTINCT user_id, substr(sha256('observer:' || user_id), 1, 12) AS observer FROM events")(lambda w: w.raw("events").select("user_id", metrics.observer_hash(F.col("user_id")).alias("observer")).distinct())
query("named_animals", prelude("boxes") + " SELECT box, label = 0 AS to_name FROM boxes WHERE score >= 0.2")(lambda w: metrics.named_animals(w.boxes).select("box", "to_name"))
SCORED = "SELECT image, box, label, x1, y1, x2, y2, sc AS score FROM (SELECT *, 1 / (1 + exp(-(score * 4 - 2))) AS sc FROM boxes) s WHERE sc > 0.2"
query("postprocessed_boxes", f"{prelude('boxes')}, kept AS ({catalogue.suppressed_sql(SCORED)}), best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, box) <= 300) SELECT image, box, label FROM ({catalogue.VISIBLE.replace('FROM boxes', 'FROM best')}) v")(lambda w: metrics.postprocessed(w.boxes.withColumn("logit", F.col("score") * 4 - 2), "logit").select("image", "box", "label"))
query("box_overlaps", prelude("boxes") + """, p AS (SELECT image, min(box) AS a, max(box) AS b FROM boxes GROUP BY 1), q AS (SELECT p.image, CAST(greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) AS DOUBLE) AS o, CAST((x.x2 - x.x1) * (x.y2 - x.y1) + (y.x2 - y.x1) * (y.y2 - y.y1) AS DOUBLE) AS t
    FROM p JOIN boxes x ON x.box = p.a JOIN boxes y ON y.box = p.b) SELECT image, round(o / nullif(t - o, 0), 6) AS iou FROM q""")(
    lambda w: (lambda b, p: digits(p.join(b.select(F.col("box").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")]), "a").join(b.select(F.col("box").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")]), "b").select("image", metrics.iou("a", "b").alias("iou")), "iou", n=6))(
        w.boxes, w.boxes.groupBy("image").agg(F.min("box").alias("a"), F.max("box").alias("b"))
    )
)
query("linear_head", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), centre AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY 1),
    n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), d AS (SELECT vec_id, label, list_inner_product(e, c) / sqrt(list_inner_product(e, e)) / CAST(0.1 AS DOUBLE) AS z FROM n, centre),
    z AS (SELECT vec_id, list(z ORDER BY label) AS z FROM d GROUP BY 1), p AS (SELECT vec_id, z, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM z)
    SELECT vec_id, CASE WHEN p >= CAST(0.2 AS DOUBLE) THEN CAST(list_position(z, list_max(z)) - 1 AS BIGINT) ELSE -1 END AS predicted, round(p, 6) AS probability FROM p""")(lambda w: digits(metrics.linear_head(w.raw("embeddings"), centres(w), np.zeros(10), 0.1, 0.2), "probability", n=6))

# --- detection jobs ---------------------------------------------------------------------------------------------------------------


def load_media(url: str) -> bytes:
    """The bytes of an image of the test tables: its hash, in digits; some addresses don't answer, some images are broken."""
    _, number, bits = url.split(":")
    if int(number) % 13 == 0:
        raise ConnectionError(number)
    return b"" if int(number) % 17 == 0 else bits.encode()


def decode_media(content: bytes) -> tuple[int, int]:
    return int(content), int(content)


def media_detector():
    """Boxes by an image's hash, up to three; some images can't be searched."""

    def find(pictures: list[int]) -> list[list[tuple]]:
        if any(p % 11 == 7 for p in pictures):
            raise RuntimeError("too large")
        return [[(i, 0.5, 0.1, 0.1, 0.2, 0.2) for i in range(p % 4)] for p in pictures]

    return find


def detected(w: World):
    """Outcomes of all new media that have an address; done ones are stored."""
    steps = detect.Steps(load_media, decode_media, media_detector)
    new = w.media.filter("status = 'new' AND id % 29 <> 0").withColumn("image_url", F.concat_ws(":", F.lit("media"), "id", "phash"))
    images = detect.fetched(new, steps, 1000)  # these images are a few bytes each
    doubles = detect.twins(images, w.media.filter("status = 'done'").withColumn("id", F.col("id").cast("long")))
    return detect.outcomes(images, doubles, steps, 1000)


JOBS = f"""{JUDGED}, q AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'download' WHEN id % 17 = 0 THEN 'unreadable' END AS bad FROM media WHERE status = 'new' AND id % 29 <> 0),
    known AS (SELECT id, captured_at, width, height, phash, false AS old FROM q WHERE bad IS NULL UNION ALL SELECT id, captured_at, width, height, phash, true FROM media WHERE status = 'done'),
    t AS (SELECT a.id, min(b.id) AS twin FROM q a JOIN known b ON a.captured_at = b.captured_at AND a.width IS NOT DISTINCT FROM b.width AND a.height IS NOT DISTINCT FROM b.height AND (b.old OR b.id < a.id) AND bit_count(xor(a.phash, b.phash)) <= 2 WHERE a.bad IS NULL GROUP BY 1),
    o AS (SELECT q.id, coalesce(bad, CASE WHEN twin IS NOT NULL THEN 'near_duplicate' WHEN phash % 11 = 7 THEN 'detector' END) AS reason, twin, phash % 4 AS n FROM q LEFT JOIN t ON t.id = q.id)"""
query("detection_outcomes", f"{JOBS} SELECT CAST(id AS BIGINT) AS id, CASE WHEN reason IS NULL THEN 'done' WHEN reason = 'near_duplicate' THEN 'skipped' ELSE 'failed' END AS status, reason, CAST(twin AS BIGINT) AS twin, CAST(CASE WHEN reason IS NULL THEN n ELSE 0 END AS INTEGER) AS boxes FROM o")(
    lambda w: detected(w).select("id", "status", "reason", "twin", F.size("boxes").alias("boxes"))
)
query("detection_counts", f"{JOBS} SELECT count(*) AS claimed, count(*) FILTER (WHERE reason <> 'near_duplicate') AS failed, count(*) FILTER (WHERE reason = 'near_duplicate') AS duplicates, count(*) FILTER (WHERE reason IS NULL AND n > 0) AS with_boxes, count(*) FILTER (WHERE reason IS NULL AND n = 0) AS empty, CAST(coalesce(sum(n) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS boxes FROM o")(
    lambda w: detect.run_counts(detected(w))
)


def pictures(w: World):
    """Each vector as a picture of 16 by 4 pixels: a component, its opposite and its double are a pixel's colours."""
    shade = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 300 * x.cast("double")))).cast("int")
    colours = F.flatten(F.transform("embedding", lambda x: F.array(shade(x), 255 - shade(x), 2 * shade(x) % 256)))
    content = F.unhex(F.array_join(F.transform(colours, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return w.raw("embeddings").select("vec_id", F.lit(16).alias("width"), F.lit(4).alias("height"), content.alias("content"))


def _line_sql(size: int, to: int, first: int, n: int) -> str:
    """(o, i, w): weights of pixels i for places o, of a line that grows."""
    x = f"abs(i + 0.5::DOUBLE - (o + {first} + 0.5::DOUBLE) * {size} / {to}::DOUBLE)"
    k = f"CASE WHEN x < 1 THEN 1.5::DOUBLE * x * x * x - 2.5::DOUBLE * x * x + 1 WHEN x < 2 THEN -0.5::DOUBLE * (x * x * x - 5 * x * x + 8 * x - 4) ELSE 0 END"
    return f"SELECT o, i, CAST(sign(k) * floor(abs(k / sum(k) OVER (PARTITION BY o)) * 4194304 + 0.5::DOUBLE) AS BIGINT) AS w FROM (SELECT o, i, {k} AS k FROM (SELECT o, i, {x} AS x FROM range({n}) a(o), range({size}) b(i)) c) d"


_SUMS = "greatest(0, least(255, CAST(floor((sum(v * w) + 2097152) / 4194304::DOUBLE) AS BIGINT))) AS v"
query("prepared_pixels", f"""WITH s AS (SELECT vec_id, i, CAST(least(255, greatest(0, floor(128 + 300 * CAST(embedding[i + 1] AS DOUBLE)))) AS BIGINT) AS s FROM embeddings, range(64) t(i)),
    p AS (SELECT vec_id, i % 16 AS x, i // 16 AS y, c, CASE c WHEN 0 THEN s WHEN 1 THEN 255 - s ELSE 2 * s % 256 END AS v FROM s, range(3) t(c)), kx AS ({_line_sql(16, 24, 9, 6)}), ky AS ({_line_sql(4, 6, 0, 6)}),
    h AS (SELECT vec_id, c, y, kx.o AS x, {_SUMS} FROM p JOIN kx ON kx.i = p.x GROUP BY 1, 2, 3, 4), q AS (SELECT vec_id, c, x, ky.o AS y, {_SUMS} FROM h JOIN ky ON ky.i = h.y GROUP BY 1, 2, 3, 4)
    SELECT vec_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * ((y * 6 + x) * 3 + c + 1)) AS BIGINT) AS by_place, CAST(min(v) AS BIGINT) AS lowest, CAST(max(v) AS BIGINT) AS highest FROM q GROUP BY 1""")(
    lambda w: pixels.prepared(pictures(w), 6, "vec_id", 1000).select(
        "vec_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + p).alias("total"), F.aggregate(F.transform("pixels", lambda p, i: p * (i + 1)), F.lit(0).cast("long"), lambda a, p: a + p).alias("by_place"),
        F.array_min("pixels").cast("long").alias("lowest"), F.array_max("pixels").cast("long").alias("highest"),
    )
)
