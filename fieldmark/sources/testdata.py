"""The domain's tables made from general-purpose tables, by arithmetic that any SQL engine does alike.

Each table is one SELECT over tables named before it; ``prelude`` gives them as common table expressions, ``Domain`` as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "zones": """
        SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name, r_name AS group_name,
               CASE n_regionkey WHEN 0 THEN 'KE' WHEN 1 THEN 'US' WHEN 2 THEN 'IN' WHEN 3 THEN 'FR' ELSE 'AE' END AS country,
               CAST((n_nationkey % 5) * 20 - 60 AS DOUBLE) AS lon0,
               CAST(FLOOR(n_nationkey / 5) * 10 - 20 AS DOUBLE) AS lat0,
               n_nationkey % 7 = 0 AS is_corner
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "species": """
        SELECT p_partkey AS id, p_name || ' ' || p_partkey AS scientific_name,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Common ' || (p_partkey % 50) END AS common_name,
               CASE p_partkey % 3 WHEN 0 THEN 'Plantae' WHEN 1 THEN 'Animalia' ELSE 'Fungi' END AS kingdom
        FROM {part}""",
    "sources": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS id, lower(substr(o_orderpriority, 3)) AS name FROM {orders}""",
    "media": """
        SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS source_id, o_orderdate AS captured_at, c_nationkey AS zone_id,
               CAST((c_nationkey % 5) * 20 - 60 AS DOUBLE) + (o_custkey % 50) * CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS lon,
               CAST(FLOOR(c_nationkey / 5) * 10 - 20 AS DOUBLE) + (o_orderkey % 40) * CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE) AS lat,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'new' ELSE 'failed' END AS status,
               (o_orderkey % 97) * 1000003 + (o_custkey % 5) AS phash,
               CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 640 + o_custkey % 3 END AS width,
               CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 480 END AS height
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "detections": """
        SELECT m.id AS media_id, l_partkey AS species_id, m.zone_id, m.source_id, m.captured_at, m.lon, m.lat,
               1 - 5 * l_discount AS confidence, CASE l_linestatus WHEN 'O' THEN 'observer' ELSE 'model' END AS origin
        FROM {lineitem} JOIN {media} m ON l_orderkey = m.id""",
    "status": """
        SELECT species_id, country, is_invasive, means FROM (
            SELECT s.id AS species_id, c.country AS country, (s.id * 7 + c.region * 3) % 10 AS k,
                   CASE (s.id + c.region) % 4 WHEN 3 THEN NULL WHEN 2 THEN false ELSE true END AS is_invasive,
                   CASE (s.id * 7 + c.region * 3) % 10 WHEN 2 THEN 'Native|Alien' WHEN 3 THEN 'Cryptogenic|Uncertain' WHEN 4 THEN NULL ELSE 'Alien' END AS means
            FROM {species} s CROSS JOIN (SELECT 0 AS region, 'KE' AS country UNION ALL SELECT 1, 'US' UNION ALL SELECT 2, 'IN' UNION ALL SELECT 3, 'FR' UNION ALL SELECT 4, 'AE') c
        ) x WHERE k < 5""",
    "findings": """
        SELECT id, id AS species_id, CASE WHEN id % 2 = 0 THEN id % 25 END AS zone_id,
               CASE id % 3 WHEN 1 THEN 'impact' ELSE 'concern' END AS finding_type,
               CASE id % 4 WHEN 0 THEN 'experimental' WHEN 1 THEN 'observational' WHEN 2 THEN 'review' ELSE 'modelled' END AS certainty,
               '10.1000/f' || (id % 40) AS doi, 2016 + id % 9 AS paper_year, id % 5 <> 0 AS verified
        FROM {species} WHERE id % 3 <> 0""",
    "playbooks": """
        SELECT id, id AS species_id, CASE id % 4 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'detection' WHEN 2 THEN 'biological' ELSE 'chemical' END AS method,
               CASE id % 3 WHEN 0 THEN 'experimental' WHEN 1 THEN 'review' ELSE 'modelled' END AS design,
               '10.1000/p' || (id % 30) AS doi, id % 7 <> 0 AS verified
        FROM {species} WHERE id % 2 = 1""",
    "runs": """
        SELECT event_id AS id, user_id % 5 AS source_id, user_id % 3 AS scope, ts AS started_at,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS finished_at, event_id % 500 AS fetched,
               CASE event_id % 4 WHEN 0 THEN 'no_date' WHEN 1 THEN 'outside_zone' WHEN 2 THEN 'imprecise_location' ELSE 'captive_or_cultivated' END AS reason,
               event_id % 17 AS refused
        FROM {events}""",
    "observations": """
        SELECT event_id AS external_id, user_id % 5 AS source_id, event_id % 25 AS zone_id,
               CASE WHEN event_id % 50 = 1 THEN NULL ELSE ts END AS captured_at,
               CASE WHEN event_id % 61 = 0 THEN CAST(99 AS DOUBLE) WHEN event_id % 67 = 0 THEN CAST(0 AS DOUBLE)
                    ELSE CAST(FLOOR((event_id % 25) / 5) * 10 - 20 AS DOUBLE) + (event_id % 43) * CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE) END AS lat,
               CASE WHEN event_id % 67 = 0 THEN CAST(0 AS DOUBLE)
                    ELSE CAST((event_id % 5) * 20 - 60 AS DOUBLE) + (event_id % 53) * CAST(0.01 AS DOUBLE) + CAST(0.005 AS DOUBLE) END AS lon,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id % 41) * 60 AS DOUBLE) END AS uncertainty_m,
               event_id % 19 = 0 AS obscured, event_id % 23 = 0 AS captive, event_id % 29 = 0 AS failed_introduction,
               CASE event_id % 13 WHEN 0 THEN 'Genus' WHEN 1 THEN 'Variety' WHEN 2 THEN NULL ELSE 'Species' END AS taxon_rank,
               CASE WHEN event_id % 31 = 0 THEN '' ELSE 'Taxon ' || (event_id % 200) END AS taxon_name,
               CASE WHEN event_id % 37 = 0 THEN 'mirror' WHEN event_id % 41 = 0 THEN 'machine' ELSE 'specimen' END AS basis
        FROM {events}""",
    "predictions": """
        SELECT doc_id AS id, quality AS truth, CASE WHEN doc_id % 9 = 0 THEN 1 - quality WHEN doc_id % 10 = 0 THEN NULL ELSE quality END AS predicted,
               ((doc_id * 37) % 100 + 1) / CAST(100 AS DOUBLE) AS confidence, doc_id % 3 AS kind
        FROM {labels}""",
    "boxes": """
        SELECT l_suppkey AS image, l_orderkey * 10 + l_linenumber AS box, l_linenumber % 2 AS label,
               (l_partkey % 60) / CAST(100 AS DOUBLE) AS x1, (l_orderkey % 50) / CAST(100 AS DOUBLE) AS y1,
               (l_partkey % 60 + 20 + l_quantity % 30) / CAST(100 AS DOUBLE) AS x2, (l_orderkey % 50 + 30) / CAST(100 AS DOUBLE) AS y2,
               l_discount * 10 AS score, l_tax * 10 AS truth_score
        FROM {lineitem}""",
}
RAW = "region nation customer part orders lineitem events labels documents benchmark pages embeddings".split()


def prelude(*names: str) -> str:
    """``WITH`` and the tables named, with those that they need."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in TABLES:
            if f"{{{other}}}" in TABLES[name] and other not in needed:
                need(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    own = {x: x for x in [*TABLES, *RAW]}
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**own)})" for n in needed)


class Domain:
    """The tables as DataFrames; each is read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.known:
            parts = {x: self.raw(x) for x in RAW if f"{{{x}}}" in TABLES[name]} | {x: getattr(self, x) for x in TABLES if f"{{{x}}}" in TABLES[name]}
            self.known[name] = self.spark.sql(TABLES[name], **parts)
        return self.known[name]

