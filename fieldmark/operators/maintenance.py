"""Upkeep of stored tables: keyed merges that keep what must be kept, queues, removals, refreshed months, samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.views import month


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = (), prefer: dict[str, Column] | None = None) -> DataFrame:
    """Stored rows with incoming ones by key. Incoming values win, but for the columns of ``keep``, which stay as first stored.

    ``prefer``: for a column a condition on ``new_<column>`` under which the incoming value wins. Incoming keys are distinct.
    """
    names = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("is_new_"))
    df = stored.withColumn("is_old_", F.lit(True)).join(new, keys, "full")
    both = F.col("is_new_") & F.col("is_old_")

    def value(c: str) -> Column:
        wins = (prefer or {}).get(c, F.lit(True))
        if c in keep:
            wins = F.lit(False)
        return F.when(both, F.when(wins, F.col(f"new_{c}")).otherwise(F.col(c))).when(F.col("is_new_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return df.select(*keys, *[value(c) for c in names])


def remove_unresearched(rows: DataFrame, alien_invasive: DataFrame, researched: DataFrame) -> DataFrame:
    """Rows but for those of a species that is alien and invasive in their country without a paper that backs it."""
    bad = alien_invasive.join(researched, "species_id", "left_anti")
    return rows.join(bad, ["species_id", "country"], "left_anti")


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The next n media to work on, oldest first; one writer claims, so there are no locks."""
    return queue.filter("status = 'new'").orderBy("captured_at", "id").limit(n).withColumn("status", F.lit("processing"))


def requeue(queue: DataFrame, stuck_before: str) -> DataFrame:
    """Media that have been in work for too long are new again."""
    stuck = (F.col("status") == "processing") & (F.col("captured_at") < F.lit(stuck_before).cast("timestamp_ntz"))
    return queue.withColumn("status", F.when(stuck, "new").otherwise(F.col("status")))


def refreshed_months(rollup: DataFrame, all_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """A monthly count with the months of changed rows counted anew from all rows, so late rows of any age count."""
    keys = ["zone_id", "month"]
    months = changed.select("zone_id", month(F.col("captured_at")).alias("month")).distinct()
    fresh = all_rows.withColumn("month", month(F.col("captured_at"))).join(months, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("effort"))
    return rollup.join(months, keys, "left_anti").select(*keys, "effort").unionByName(fresh)


def stratified_sample(frames: DataFrame, annotations: DataFrame, n: int, empty_share: float = 0.3, seed: int = 0) -> DataFrame:
    """n frames, a share of them empty: frames with a box, and frames whose only annotation is "empty", each kind spread over locations.

    A frame that is annotated both ways counts as one with a box. Frames are taken in turns of locations, in an order fixed by a hash.
    """
    boxed = annotations.filter("category != 'empty'").select("frame").distinct()
    blank = annotations.filter("category = 'empty'").select("frame").distinct().join(boxed, "frame", "left_anti")
    kinds = frames.join(boxed.withColumn("empty", F.lit(False)).unionByName(blank.withColumn("empty", F.lit(True))), "frame")
    h = F.md5(F.concat(F.col("frame").cast("string"), F.lit(f":{seed}")))
    turn = F.row_number().over(Window.partitionBy("empty", "location").orderBy(h, "frame"))
    empties = round(n * empty_share)
    ranked = kinds.withColumn("turn_", turn).withColumn("hash_", h)
    pick = lambda empty, k: ranked.filter(F.col("empty") == empty).orderBy("turn_", "hash_", "frame").limit(k)
    return pick(True, empties).unionByName(pick(False, n - empties)).drop("turn_", "hash_")


def crops_per_class(boxes: DataFrame, k: int, least_px: int = 32, seed: int = 0) -> DataFrame:
    """Up to k boxes of each class: one of each image, the largest, and fair over locations."""
    side = F.least(F.col("width_px"), F.col("height_px"))
    one = Window.partitionBy("label", "image").orderBy(F.desc(side), "box")
    df = boxes.filter(side >= least_px).withColumn("n_", F.row_number().over(one)).filter("n_ = 1")
    h = F.md5(F.concat(F.col("image").cast("string"), F.lit(f":{seed}")))
    df = df.withColumn("turn_", F.row_number().over(Window.partitionBy("label", "location").orderBy(h, "image"))).withColumn("hash_", h)
    df = df.withColumn("place_", F.row_number().over(Window.partitionBy("label").orderBy("turn_", "hash_", "image")))
    return df.filter(F.col("place_") <= k).drop("n_", "turn_", "hash_", "place_")


def quota_by_region(photos: DataFrame, k: int, quota: int) -> DataFrame:
    """Up to k photos of each species: first up to ``quota`` from the region, then any others, in an order fixed by id."""
    df = photos.withColumn("own_", F.row_number().over(Window.partitionBy("species_id", "in_region").orderBy("id")))
    first = F.col("in_region") & (F.col("own_") <= quota)
    df = df.withColumn("place_", F.row_number().over(Window.partitionBy("species_id").orderBy(F.desc(first), "id")))
    return df.filter(F.col("place_") <= k).drop("own_", "place_")


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def storage_status(used_bytes: int, limit_bytes: int, warn: float = 0.8, stop: float = 0.9) -> str:
    """ok, warn or stop, by the share of a storage limit that is used."""
    share = used_bytes / limit_bytes
    return "stop" if share >= stop else "warn" if share >= warn else "ok"


def merge_by_name(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored species (id, gbif_key, inat_id, scientific_name, kingdom, common_name) with incoming rows (seq instead of id).

    A row with a key belongs to the species of that key, one without to the keyless species of its name in any case and its kingdom.
    The last name wins for keyed species; kingdoms are replaced by known ones only; a common name fills a gap, the first that comes;
    a species without an inat_id claims its first one that no stored species has, and of several that claim it the first gets it.
    New species have the ids ``max(id) + 1 + seq`` of their first row.
    """
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))
    group = F.when(F.col("gbif_key").isNotNull(), F.struct(F.col("gbif_key").alias("k"), F.lit("").alias("n"), F.lit("").alias("g"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("k"), F.lower("scientific_name").alias("n"), F.coalesce("kingdom", F.lit("\x00")).alias("g"))
    )
    known = stored.withColumn("at_", group)
    new = incoming.withColumn("at_", group)
    taken = stored.filter("inat_id IS NOT NULL").select("inat_id").distinct()
    free = new.select("at_", "seq", "inat_id").filter("inat_id IS NOT NULL").join(taken, "inat_id", "left_anti")
    free = free.join(known.filter("inat_id IS NOT NULL").select("at_"), free["at_"].eqNullSafe(known["at_"]), "left_anti")
    claims = free.groupBy("at_").agg(F.min(F.struct("seq", "inat_id")).alias("c")).groupBy("c.inat_id").agg(F.min_by("at_", "c.seq").alias("claimer_"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    rows = new.groupBy("at_").agg(F.min("seq").alias("first_"), F.max_by("scientific_name", "seq").alias("new_name"), F.min_by("scientific_name", "seq").alias("first_name"), last("kingdom").alias("new_kingdom"), F.min_by("common_name", F.when(F.col("common_name").isNotNull(), F.col("seq"))).alias("new_common"))
    rows = rows.join(claims.withColumnRenamed("inat_id", "claim_"), F.col("at_").eqNullSafe(F.col("claimer_")), "left").withColumnRenamed("at_", "new_at")
    df = known.join(rows, F.col("at_").eqNullSafe(F.col("new_at")), "full").crossJoin(F.broadcast(top))
    keyed = F.coalesce(F.col("at_.k"), F.col("new_at.k"))
    name = F.when(keyed.isNotNull(), F.coalesce("new_name", "scientific_name")).otherwise(F.coalesce("scientific_name", "first_name"))
    return df.select(
        F.coalesce("id", F.col("top_") + 1 + F.col("first_")).alias("id"), keyed.alias("gbif_key"), F.coalesce("inat_id", "claim_").alias("inat_id"),
        name.alias("scientific_name"), F.coalesce("new_kingdom", "kingdom").alias("kingdom"), F.coalesce("common_name", "new_common").alias("common_name"),
    )


def prune_owned(rows: DataFrame, wanted: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Rows but for those of this owner that are no longer wanted; rows of others stay."""
    mine = F.coalesce(F.col("owner") == owner, F.lit(False))
    return rows.filter(~mine).unionByName(rows.filter(mine).join(wanted.select(*keys).distinct(), keys, "left_semi").select(*rows.columns))


def drop_other_basis(media: DataFrame, source_id: int, basis: DataFrame, wanted: str = "specimen") -> DataFrame:
    """Media but for those of a source whose record (id, basis) is of another basis; unknown records stay."""
    other = basis.filter(F.col("basis") != wanted).select("id").distinct()
    own = F.col("source_id") == source_id
    return media.filter(own).join(other, "id", "left_anti").select(*media.columns).unionByName(media.filter(~own | F.col("source_id").isNull()))


def rename_source(sources: DataFrame, old: str, new: str) -> DataFrame:
    """A source under its new name; nothing changes where the old name is gone or the new one is taken."""
    taken = sources.filter(F.col("name") == new).agg(F.count(F.lit(1)).alias("taken_"))
    rename = (F.col("name") == old) & (F.col("taken_") == 0)
    return sources.crossJoin(F.broadcast(taken)).withColumn("name", F.when(rename, new).otherwise(F.col("name"))).drop("taken_")


def replace_parts(rows: DataFrame, path: str, part: str, expected: list) -> None:
    """Write rows so that each value of ``part`` in ``expected`` has these rows and no others, and other values' files aren't touched.

    Rows are counted by part first: a part that is expected but has no rows, or has rows but isn't expected, is an error, and then nothing
    is written, for a report that didn't arrive is no reason to delete the old one. Parts are swapped as the write is committed.
    """
    found = {r[0] for r in rows.select(part).distinct().limit(len(set(expected)) + 1).collect()}  # one more than expected tells
    if found != set(expected):
        raise ValueError(f"parts without rows: {sorted(map(str, set(expected) - found))}; parts that weren't expected: {sorted(map(str, found - set(expected)))}")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def seeded(stored: DataFrame, incoming: DataFrame, key: str = "slug", ident: str = "id") -> DataFrame:
    """Stored rows with incoming ones by a name: those of a known name replace all but its number, new names get the next numbers in
    their order, and stored rows that don't come stay. Of incoming rows with one name the last counts, by column ``seq``."""
    columns = [c for c in stored.columns if c not in (key, ident)]
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("new_"))
    df = stored.join(last, key, "full")
    new = df.filter(F.col(ident).isNull()).select(key).withColumn("next_", F.row_number().over(Window.orderBy(key)))
    top = stored.agg(F.coalesce(F.max(ident), F.lit(0)).alias("top_"))
    numbers = new.crossJoin(F.broadcast(top)).select(F.col(key).alias("key_"), (F.col("top_") + F.col("next_")).alias("number_"))
    out = df.join(numbers, F.col(key) == F.col("key_"), "left")
    return out.select(F.coalesce(ident, "number_").alias(ident), key, *[F.when(F.col("new_").isNotNull(), F.col(f"new_.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
