"""Incremental ingest as functions of old tables and new rows: rules with reasons, duplicates, zones, merges, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import cover

# Ranks at which a record names a species, and licences under which an image may be used.
SPECIES_RANKS = ("species", "subspecies", "variety", "form", "hybrid", "infraspecies", "infrahybrid")
IMAGE_LICENCES = ("cc0", "cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nc-sa")
MAX_UNCERTAINTY_M = 2000.0


def reject_reason(as_of: Column) -> Column:
    """The first rule that an observation breaks, null if none; the order of the rules is part of the result."""
    c = F.col
    rules = [
        ("duplicate_of_inaturalist", c("basis") == "mirror"),
        ("not_a_specimen", c("basis") != "specimen"),
        ("bad_coordinates", ~c("lat").between(-90, 90) | ~c("lon").between(-180, 180)),
        ("null_island", (c("lat") == 0) & (c("lon") == 0)),
        ("obscured_location", c("obscured")),
        ("imprecise_location", c("uncertainty_m") > MAX_UNCERTAINTY_M),
        ("no_date", c("captured_at").isNull()),
        ("future_date", c("captured_at") > as_of),
        ("not_species_level", ~F.coalesce(F.lower("taxon_rank").isin(*SPECIES_RANKS), F.lit(False))),
        ("captive_or_cultivated", c("captive")),
        ("not_established", c("failed_introduction")),
        ("no_taxon", F.coalesce(c("taxon_name"), F.lit("")) == ""),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def judged(observations: DataFrame, as_of: str) -> DataFrame:
    return observations.withColumn("reason", reject_reason(F.lit(as_of).cast("timestamp_ntz")))


def reason_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet, one for each key."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def assign_zones(points: DataFrame, polygons: DataFrame, keep: list[str], max_broadcast: int = 64 << 20) -> DataFrame:
    """Each point with the lowest id of the zones that hold it, null if none does.

    Polygons are covered by cells of a quad-tree, and points meet them by their own cells, an equal join. Inner cells decide at once,
    border cells by the sides that they need, so a large polygon isn't copied to each of its cells. A cover is broadcast only if
    its cells and sides, which are counted, take no more than so many bytes; else both sides are shuffled by cell.
    """
    cells = cover.covered(polygons)
    sizes = cells.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("sides"), F.lit(0))).alias("sides")).collect()  # a row for each level
    small = sum(64 * r["n"] + 32 * r["sides"] for r in sizes) <= max_broadcast
    at = cover.point_cells(F.col("lon"), F.col("lat"), sorted(r["level"] for r in sizes))
    cut = points.withColumn("cell", F.explode_outer(at if sizes else F.lit(None).cast("array<bigint>")))
    met = cut.join(F.broadcast(cells) if small else cells, "cell", "left")
    inside = cover.holds(F.col("lon"), F.col("lat"))
    return met.groupBy(*keep).agg(F.min(F.when(inside, F.col("zone_"))).alias("assigned_zone"))


def near_duplicate_media(media: DataFrame, distance: int = 2, stored: DataFrame | None = None) -> DataFrame:
    """(id, original): media with an earlier one of the same moment and size whose image hash differs in few bits; the lowest id.

    ``stored``: other media, of any id, that count as earlier ones too.
    A hash is cut into ``distance + 1`` blocks of bits; two hashes that are so close have one of them in common. Media of one hash are
    compared as one, and the join is on moment, size and block, so media of one moment, many where times are days, meet only by blocks.
    """
    key = ["captured_at", "w", "h"]
    cuts = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    blocks = [F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("phash", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("v")) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]

    def keyed(df: DataFrame) -> DataFrame:
        return df.filter("captured_at IS NOT NULL AND phash IS NOT NULL").select("id", "phash", "captured_at", F.coalesce("width", F.lit(-1)).alias("w"), F.coalesce("height", F.lit(-1)).alias("h"))

    def cut(df: DataFrame) -> DataFrame:
        hashes = df.groupBy(*key, "phash").agg(F.min("id").alias("first"))
        return hashes.select(*key, "phash", "first", F.explode(F.array(*blocks)).alias("x")).select(*key, "phash", "first", "x.b", "x.v")

    m = keyed(media)
    own = cut(m)
    other = own.withColumn("old", F.lit(False))
    if stored is not None:
        other = other.unionByName(cut(keyed(stored)).withColumn("old", F.lit(True)))
    other = other.select(*key, F.col("phash").alias("other_hash"), F.col("first").alias("other"), "old", "b", "v")
    close = F.bit_count(F.col("phash").bitwiseXOR(F.col("other_hash"))) <= distance
    first = lambda where: F.min(F.when(where, F.col("other")))
    found = own.join(other, [*key, "b", "v"]).filter(close).groupBy(*key, "phash").agg(first(~F.col("old")).alias("before"), first(F.col("old")).alias("kept"))
    original = F.least("kept", F.when(F.col("before") < F.col("id"), F.col("before")))
    return m.join(found, [*key, "phash"]).select("id", original.alias("original")).filter("original IS NOT NULL")


def merge_species(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored species with incoming ones by id: names are replaced, a common name only fills a gap, and new species are added."""
    new = incoming.groupBy("id").agg(F.max_by("scientific_name", "seq").alias("new_name"), F.max_by("common_name", F.when(F.col("common_name").isNotNull(), F.col("seq"))).alias("new_common"), F.max_by("kingdom", "seq").alias("new_kingdom"))
    df = stored.join(new, "id", "full")
    return df.select("id", F.coalesce("new_name", "scientific_name").alias("scientific_name"), F.coalesce("common_name", "new_common").alias("common_name"), F.coalesce("new_kingdom", "kingdom").alias("kingdom"))


def merge_checklist(rows: DataFrame) -> DataFrame:
    """Checklist rows of one taxon and country made one: invasive if any says so, else not if any says so, else unknown; first wording."""
    return rows.groupBy("species_id", "country").agg(F.bool_or("is_invasive").alias("is_invasive"), F.min_by("means", "seq").alias("means"), F.count(F.lit(1)).alias("rows"))


def prune_runs(runs: DataFrame, keep: int, older_than: str) -> DataFrame:
    """Runs that stay: unfinished ones, the latest ``keep`` of each source, and those not older; ties by id."""
    if keep < 1:
        raise ValueError("at least one run of each source must stay")
    w = Window.partitionBy("source_id").orderBy(F.desc("finished_at"), F.desc("id"))
    finished = runs.filter("finished_at IS NOT NULL").withColumn("place", F.row_number().over(w))
    stay = finished.filter((F.col("place") <= keep) | (F.col("finished_at") >= F.lit(older_than).cast("timestamp_ntz"))).drop("place")
    return stay.unionByName(runs.filter("finished_at IS NULL"))


def fair_sample(rows: DataFrame, group: str, k: int, seed: int = 0, key: str = "id") -> DataFrame:
    """k rows spread over the groups in turns, in an order fixed by a hash of key and seed."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return rows.withColumn("turn_", turn).withColumn("hash_", h).orderBy("turn_", "hash_", key).limit(k).drop("turn_", "hash_")


def capped(rows: DataFrame, keys: list[str], cap: int, order: list[Column | str]) -> DataFrame:
    """The first ``cap`` rows of each key: a storage limit, not a sample."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place_", F.row_number().over(w)).filter(F.col("place_") <= cap).drop("place_")
