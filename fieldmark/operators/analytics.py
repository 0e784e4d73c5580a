"""Statistics by zone: ranks, rarefied richness, co-occurrence, trends, first-record alerts. All zones are computed in one plan."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.views import with_origin

CELL_DEGREES = 0.05
RAREFIED = 10
MIN_CELLS, MIN_INVADED = 20, 5
MIN_EFFORT, MIN_YEARS, MIN_INVASIVE = 15, 6, 30


def average_rank(value: str, by: str) -> Column:
    """Ranks from 1, ties by their mean."""
    w = Window.partitionBy(by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, rho): null with fewer than three rows or a constant side."""
    ranked = df.withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by))
    n, sx, sy = F.count(F.lit(1)), F.sum("rx"), F.sum("ry")
    cov = n * F.sum(F.col("rx") * F.col("ry")) - sx * sy
    var = (n * F.sum(F.col("rx") * F.col("rx")) - sx * sx) * (n * F.sum(F.col("ry") * F.col("ry")) - sy * sy)
    return ranked.groupBy(by).agg(n.alias("n"), F.when((n >= 3) & (var > 0), cov / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("rho"))


def rarefied_richness(counts: Column, total: Column, n: int = RAREFIED) -> Column:
    """Expected number of species among n individuals drawn without replacement from ``total``, the sum of the counts.

    Null with fewer than n; zeros ignored. ``total`` should be a column, for it is read for every count.
    """

    def absent(c: Column) -> Column:
        out = F.lit(1.0)
        for i in range(n):
            out = out * F.greatest(total - c - i, F.lit(0)) / (total - i)
        return out

    seen = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s + 1 - absent(c))
    return F.when((total >= n) & F.lit(n >= 1), seen)


def cooccurrence_cells(detections: DataFrame, zones: DataFrame, status: DataFrame, researched: DataFrame) -> DataFrame:
    """Per zone and 0.05 degree cell: all and invasive records, and the richness of species neither alien nor uncertain there."""
    per = detections.groupBy("zone_id", F.floor(F.col("lon") / CELL_DEGREES).cast("int").alias("cx"), F.floor(F.col("lat") / CELL_DEGREES).cast("int").alias("cy"), "species_id").agg(F.count(F.lit(1)).alias("n"))
    known = with_origin(status).select("species_id", "country", (F.col("is_invasive") & (F.col("origin_class") == "alien")).alias("alien_invasive"), F.col("origin_class").isin("alien", "uncertain").alias("odd"))
    per = per.join(zones.select(F.col("id").alias("zone_id"), "country"), "zone_id").join(known, ["species_id", "country"], "left")
    per = per.join(researched.withColumn("backed", F.lit(True)), "species_id", "left")
    invasive = F.coalesce(F.col("alien_invasive") & F.col("backed"), F.lit(False))
    native = ~F.coalesce(F.col("odd"), F.lit(False)) & F.col("species_id").isNotNull()
    out = per.groupBy("zone_id", "cx", "cy").agg(
        F.sum("n").alias("all_records"),
        F.coalesce(F.sum(F.when(invasive, F.col("n"))), F.lit(0)).alias("invasive_records"),
        F.collect_list(F.when(native, F.col("n"))).alias("native_counts"),
        F.coalesce(F.sum(F.when(native, F.col("n"))), F.lit(0)).alias("native_total"),
    )
    return out.select("zone_id", "cx", "cy", "all_records", "invasive_records", rarefied_richness(F.sort_array("native_counts"), F.col("native_total")).alias("richness"))


def cooccurrence(cells: DataFrame) -> DataFrame:
    """Rank correlation of the invasive share with native richness; a reason stands where a zone has too little to tell."""
    usable = cells.filter("richness IS NOT NULL").withColumn("share", F.col("invasive_records") / F.col("all_records").cast("double"))
    gates = usable.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("invasive_records") > 0).alias("invaded"))
    reason = F.when(F.col("cells") < MIN_CELLS, "cells").when(F.col("invaded") < MIN_INVADED, "invaded")
    both = gates.join(spearman(usable, "share", "richness", "zone_id").drop("n"), "zone_id").withColumn("reason", reason)
    return both.select("zone_id", "cells", "invaded", "reason", F.when(F.col("reason").isNull(), F.col("rho")).alias("rho"))


def bootstrap_interval(cells: DataFrame, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the rank correlation for each zone, over cells in a fixed order; a zone has a bounded number of cells."""

    def ranks(m: np.ndarray) -> np.ndarray:
        return np.stack([pd.Series(r).rank().to_numpy() for r in m])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cx", "cy"])
        x, y = pdf["share"].to_numpy(float), pdf["richness"].to_numpy(float)
        at = np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))
        rx, ry = ranks(x[at]), ranks(y[at])
        rx, ry = rx - rx.mean(1, keepdims=True), ry - ry.mean(1, keepdims=True)
        scale = np.sqrt((rx**2).sum(1) * (ry**2).sum(1))
        rho = ((rx * ry).sum(1)[scale > 0]) / scale[scale > 0]
        low, high = np.percentile(rho, [50 - 50 * level, 50 + 50 * level]) if len(rho) >= draws // 2 else (None, None)
        return pd.DataFrame({"zone_id": [pdf["zone_id"].iloc[0]], "low": [low], "high": [high]})

    usable = cells.filter("richness IS NOT NULL").withColumn("share", F.col("invasive_records") / F.col("all_records").cast("double"))
    return usable.groupBy("zone_id").applyInPandas(one, "zone_id int, low double, high double")


def trend_years(detections: DataFrame, zones: DataFrame, status: DataFrame, researched: DataFrame) -> DataFrame:
    """Per zone and year: media with a detection (the effort), invasive and native detections."""
    known = with_origin(status).select("species_id", "country", (F.col("is_invasive") & (F.col("origin_class") == "alien")).alias("alien_invasive"), "origin_class")
    known = known.join(researched.withColumn("backed", F.lit(True)), "species_id", "left")
    df = detections.select("zone_id", "species_id", "media_id", "captured_at").join(zones.select(F.col("id").alias("zone_id"), "country"), "zone_id").join(known, ["species_id", "country"], "left")
    return df.groupBy("zone_id", F.year("captured_at").cast("long").alias("year")).agg(
        F.countDistinct("media_id").alias("effort"),
        F.count_if(F.col("alien_invasive") & F.col("backed")).alias("invasive"),
        F.count_if(F.col("species_id").isNotNull() & (F.coalesce("origin_class", F.lit("native")) == "native")).alias("native"),
    )


def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)


def p_value():
    """``normal_p`` for columns. Filters stay above it: pushed into one, it would stand in an expression that only the JVM evaluates."""
    return F.pandas_udf(normal_p, "double").asNondeterministic()


def kendall(rows: Column) -> Column:
    """struct(n, s, tied, slope) of an array of structs (t, y): rows, S, the sum over ties of y, and the median slope of all pairs in time."""

    def of(a: Column) -> Column:
        later = F.filter(rows, lambda b: b["t"] > a["t"])
        k = F.size(F.filter(rows, lambda b: b["y"].eqNullSafe(a["y"]))).cast("long")
        rises = F.transform(later, lambda b: F.signum(b["y"] - a["y"]))
        return F.struct(((k - 1) * (2 * k + 5)).alias("tied"), F.filter(rises, lambda x: x.isNotNull()).alias("rises"), F.filter(F.transform(later, lambda b: (b["y"] - a["y"]) / (b["t"] - a["t"])), lambda x: x.isNotNull()).alias("slopes"))

    def summed(each: Column) -> Column:
        rises, slopes = F.flatten(F.transform(each, lambda x: x["rises"])), F.array_sort(F.flatten(F.transform(each, lambda x: x["slopes"])))
        return F.transform(F.array(F.struct(rises.alias("r"), slopes.alias("s"))), lambda x: total(each, x["r"], x["s"]))[0]

    def total(each: Column, rises: Column, slopes: Column) -> Column:
        m = F.size(slopes)
        middle = 0.5 * F.get(slopes, F.floor((m - 1) / 2).cast("int")) + 0.5 * F.get(slopes, F.floor(m / 2).cast("int"))
        s = F.when(F.size(rises) > 0, F.aggregate(rises, F.lit(0.0), lambda a, x: a + x).cast("long"))
        tied = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x["tied"])
        return F.struct(F.size(each).cast("long").alias("n"), s.alias("s"), tied.alias("tied"), F.when(m > 0, middle).alias("slope"))

    return F.transform(F.array(F.transform(rows, of)), summed)[0]


def tested(found: Column) -> dict[str, Column]:
    """Columns n, s, variance, z, tau and slope from what ``kendall`` gives."""
    n, s = found["n"], found["s"]
    var = (n * (n - 1) * (2 * n + 5) - found["tied"]) / F.lit(18.0)
    z = F.when(var <= 0, 0.0).otherwise((s - F.signum(s.cast("double"))) / F.sqrt(var))
    return {"n": n, "s": s, "variance": var, "z": z, "tau": s / (n * (n - 1) / F.lit(2.0)), "slope": found["slope"]}


def mann_kendall(df: DataFrame, time: str, value: str, by: str) -> DataFrame:
    """Per group: S, its variance corrected for ties of the value, continuity-corrected z, two-sided p, tau-a and the Theil-Sen slope.

    Null with fewer than four rows; z 0 and p 1 where the variance isn't positive. A group's rows meet as one array, so that what the
    rows come from is computed once; there are as many slopes as pairs of them.
    """
    rows = df.groupBy(by).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("y"))).alias("rows_"))
    found = rows.filter(F.size("rows_") >= 4).select(by, kendall(F.col("rows_")).alias("k_"))
    p = p_value()
    return found.select(by, *[c.alias(n) for n, c in tested(F.col("k_")).items()]).withColumn("p", p("z"))


def trend(years: DataFrame) -> DataFrame:
    """Mann-Kendall of invasive records over effort, for zones with enough years of enough effort and enough invasive records at all."""
    usable = F.col("effort") >= MIN_EFFORT
    row = F.when(usable, F.struct(F.col("year").alias("t"), (F.col("invasive") / F.col("effort").cast("double")).alias("y")))
    zones = years.groupBy("zone_id").agg(F.sum("invasive").alias("total"), F.collect_list(row).alias("rows_"))
    good = zones.filter((F.col("total") >= MIN_INVASIVE) & (F.size("rows_") >= MIN_YEARS))
    return mann_kendall(good.select("zone_id", F.inline("rows_")), "t", "y", "zone_id")


def documented_findings(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """Verified findings per zone: those of the zone always, general ones where the species is recorded."""
    local = findings.filter("verified AND zone_id IS NOT NULL").join(summary.select("zone_id", "species_id", "records"), ["zone_id", "species_id"], "left")
    general = findings.filter("verified AND zone_id IS NULL").drop("zone_id").join(summary.select("zone_id", "species_id", "records"), "species_id")
    both = local.unionByName(general, allowMissingColumns=True)
    return both.select("zone_id", "species_id", "finding_type", "certainty", "doi", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) > 0).alias("recorded"))


def first_record_alerts(summary: DataFrame, media: DataFrame, findings: DataFrame, playbooks: DataFrame, as_of: str, days: int = 365, effort: int = 50) -> DataFrame:
    """Species first recorded in a zone within the last days, after some effort there, that no finding documents for the zone.

    Severity is high if a verified finding is more than modelled. Effort before the record is counted per zone by date ranges:
    media are summed by zone and day, and the running sum before a day is joined, so no record meets all media of its zone.
    """
    day = F.col("first_record")
    new = summary.filter((day <= F.lit(as_of).cast("date")) & (day > F.date_sub(F.lit(as_of).cast("date"), days)))
    daily = media.groupBy("zone_id", F.to_date("captured_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    marks = new.select("zone_id", F.col("first_record").alias("day")).distinct().withColumn("n", F.lit(0))
    w = Window.partitionBy("zone_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = daily.unionByName(marks).groupBy("zone_id", "day").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(w) - F.col("n"))
    local = findings.filter("verified AND zone_id IS NOT NULL").select("zone_id", "species_id").distinct()
    harm = findings.filter("verified AND certainty IN ('experimental', 'observational', 'review')").select("species_id").distinct().withColumn("harm", F.lit(True))
    out = new.join(running.select("zone_id", F.col("day").alias("first_record"), "before"), ["zone_id", "first_record"]).filter(F.col("before") >= effort)
    out = out.join(local, ["zone_id", "species_id"], "left_anti").join(harm, "species_id", "left")
    return out.select("zone_id", "species_id", "first_record", F.col("before").alias("prior_effort"), F.when(F.col("harm"), "high").otherwise("medium").alias("severity"))


def zone_report(zones: DataFrame, detections: DataFrame, summary: DataFrame, pairs: DataFrame, trends: DataFrame) -> DataFrame:
    """One document per zone: totals, invasive species in order, and the results of co-occurrence and trend."""
    totals = detections.groupBy("zone_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("species_id").alias("species"))
    named = summary.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("records")).alias("order"), "species_id", "records", "first_record"))).alias("invasive"))
    df = zones.select(F.col("id").alias("zone_id"), "slug").join(totals, "zone_id", "left").join(named, "zone_id", "left")
    df = df.join(pairs.select("zone_id", F.struct("cells", "invaded", "reason", "rho").alias("cooccurrence")), "zone_id", "left")
    return df.join(trends.select("zone_id", F.struct("n", "s", "tau", "slope", "p").alias("trend")), "zone_id", "left")


