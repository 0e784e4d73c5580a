"""Images are fetched, read, compared and searched for animals: one outcome for each, by steps that are written and never done twice.

Loader, reader and detector are functions passed in. A failing image is an outcome; a detector that can't be made is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.ingest import near_duplicate_media

BOX = "label int, score double, x1 double, y1 double, x2 double, y2 double"
FETCHED = "id long, captured_at timestamp_ntz, width int, height int, content binary, phash long, reason string, detail string"
OUTCOME = f"id long, status string, reason string, detail string, twin long, phash long, boxes array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>"
#: Characters of an error's text that an outcome keeps.
DETAIL = 300


class Steps(NamedTuple):
    """``load(url)`` gives bytes; ``decode(bytes)`` a picture and its 64-bit hash, signed; ``detector()``, once a task, a function from
    pictures to their boxes, each (label, score, x1, y1, x2, y2)."""

    load: Callable[[str], bytes]
    decode: Callable[[bytes], tuple[Any, int]]
    detector: Callable[[], Callable[[list], list[list[tuple]]]]


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:DETAIL]


def fetched(queue: DataFrame, steps: Steps, batch: int = 8) -> DataFrame:
    """(FETCHED) for each row (id, image_url, captured_at, width, height): its bytes and hash, or why there are none: download, unreadable.

    A task holds ``batch`` images at a time.
    """

    def one(row) -> tuple:
        own = (row.id, row.captured_at, row.width, row.height)
        try:
            content = bytes(steps.load(row.image_url))
        except Exception as e:  # one image's failure is its outcome
            return *own, None, None, "download", _told(e)
        try:
            return *own, content, int(steps.decode(content)[1]), None, None
        except Exception as e:
            return *own, None, None, "unreadable", _told(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FETCHED.split(", ")]
        for frame in frames:
            for a in range(0, len(frame), batch):
                out = pd.DataFrame([one(r) for r in frame.iloc[a : a + batch].itertuples(index=False)], columns=columns)
                yield out.astype({"width": "Int32", "height": "Int32", "phash": "Int64"})

    rows = queue.select(F.col("id").cast("long").alias("id"), "image_url", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    nullable = rows.withColumns({c: F.col(c).cast("string") for c in ("width", "height")})  # pandas makes numbers with nulls floats
    return nullable.mapInPandas(run, FETCHED)


def twins(images: DataFrame, stored: DataFrame | None = None, distance: int = 2) -> DataFrame:
    """(id, twin) of fetched images that are near-duplicates of a stored one, or of an earlier one among themselves."""
    return near_duplicate_media(images, distance, stored).select("id", F.col("original").alias("twin"))


def outcomes(images: DataFrame, doubles: DataFrame, steps: Steps, batch: int = 8) -> DataFrame:
    """(OUTCOME) of every fetched image: failed with a reason, skipped with its twin, or done with its boxes.

    Where a batch fails in the detector its images are tried one by one, so that each has an outcome of its own (reason: detector).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, find = [c.split()[0] for c in OUTCOME.split("<")[0].split(", ")], None

        def searched(pictures: list) -> list[list[tuple]]:
            boxes = find(pictures)
            if len(boxes) != len(pictures):
                raise ValueError(f"{len(boxes)} lists of boxes for {len(pictures)} images")
            return boxes

        def alone(picture: Any) -> list[tuple] | Exception:
            try:
                return searched([picture])[0]
            except Exception as e:
                return e

        for frame in frames:
            find = find or steps.detector()
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                pictures = [steps.decode(bytes(c))[0] for c in part["content"]]
                try:
                    found = searched(pictures)
                except Exception:
                    found = [alone(p) for p in pictures]
                rows = [(i, "failed", "detector", _told(b), None, h, []) if isinstance(b, Exception) else (i, "done", None, None, None, h, [dict(zip(("label", "score", "x1", "y1", "x2", "y2"), x, strict=True)) for x in b]) for i, h, b in zip(part["id"], part["phash"], found, strict=True)]
                yield pd.DataFrame(rows, columns=columns).astype({"twin": "Int64"})

    none = F.array().cast(OUTCOME[OUTCOME.index("array<") :])
    good = images.filter("reason IS NULL").join(doubles, "id", "left")
    failed = images.filter("reason IS NOT NULL").select("id", F.lit("failed").alias("status"), "reason", "detail", F.lit(None).cast("long").alias("twin"), "phash", none.alias("boxes"))
    skipped = good.filter("twin IS NOT NULL").select("id", F.lit("skipped").alias("status"), F.lit("near_duplicate").alias("reason"), F.lit(None).cast("string").alias("detail"), "twin", "phash", none.alias("boxes"))
    done = good.filter("twin IS NULL").select("id", "phash", "content").mapInPandas(run, OUTCOME)
    return done.unionByName(failed).unionByName(skipped)


class Jobs:
    """Tables of claims and outcomes under a folder, a part for each run; a part counts once its write is committed.

    Runs start one after another; they may work at the same time, and a run that died blocks its images until its lease is over. Then
    others may claim them; if it comes back after all, the outcome of the later run counts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, step: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{step}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, step: str) -> list[int]:
        """Numbers of the runs that have committed this step."""
        at, fs = self._files(step)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        out = sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))
        return [r for r in out if self.committed(step, r)]

    def committed(self, step: str, run: int) -> bool:
        at, fs = self._files(f"{step}/run={run}/_SUCCESS")
        return fs.exists(at)

    def read(self, step: str, schema: str, runs: list[int] | None = None, spark: SparkSession | None = None) -> DataFrame:
        """Rows of a step's committed runs with the column ``run``."""
        spark, runs = spark or self.spark, self.runs(step) if runs is None else runs
        if not runs:
            return spark.createDataFrame([], f"{schema}, run int")
        return spark.read.schema(f"{schema}, run int").option("basePath", f"{self.path}/{step}").parquet(*[f"{self.path}/{step}/run={r}" for r in runs])

    def write(self, step: str, run: int, make: Callable[[], DataFrame]) -> None:
        """Do a step, unless the run has done it."""
        if not self.committed(step, run):
            make().write.mode("overwrite").parquet(f"{self.path}/{step}/run={run}")

    def drop(self, step: str, run: int) -> None:
        at, fs = self._files(f"{step}/run={run}")
        fs.delete(at, True)

    def outcomes(self) -> DataFrame:
        """One outcome for each image that has any, of its last run."""
        rows = self.read("outcomes", OUTCOME)
        return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "run").alias("x")).select("id", "x.*")

    def claimed(self, now: str) -> DataFrame:
        """(id) of images that a run without outcomes holds by a lease that isn't over."""
        open_runs = sorted(set(self.runs("claims")) - set(self.runs("outcomes")))
        live = self.read("claims", "id long, until timestamp_ntz", open_runs).filter(F.col("until") > F.lit(now).cast("timestamp_ntz"))
        return live.select("id").distinct()

    def state(self, media: DataFrame, now: str) -> DataFrame:
        """Media with status, reason, detail, twin and phash as the runs left them: new, processing, done, failed or skipped."""
        known = self.outcomes().select("id", *[F.col(c).alias(f"{c}_") for c in ("status", "reason", "detail", "twin", "phash")])
        df = media.drop("reason", "detail", "twin").join(known, "id", "left").join(self.claimed(now).withColumn("held_", F.lit(True)), "id", "left")
        held = F.when(F.col("held_") & (F.col("status") == "new"), "processing")
        out = df.withColumns({"status": F.coalesce("status_", held, "status"), "phash": F.coalesce("phash_", "phash")})
        return out.select(*media.drop("reason", "detail", "twin").columns, *[F.col(f"{c}_").alias(c) for c in ("reason", "detail", "twin")])


def run_detection(media: DataFrame, jobs: Jobs, steps: Steps, now: str, limit: int | None = None, run: int | None = None, lease: str = "1 hour", batch: int = 8) -> DataFrame:
    """Outcomes of one run over the ``limit`` new images of least id (all, if None) that have an address and that no other run holds.

    ``media``: id, image_url, captured_at, width, height, status, phash. A run goes on where it stopped if it is given its number again:
    images aren't claimed, fetched or searched anew once that step is written. Bytes are kept between fetching and the outcomes only.
    An image's outcome and boxes are one row, so they are stored together or not at all.
    """
    run = max(jobs.runs("claims"), default=0) + 1 if run is None else run

    def claims() -> DataFrame:
        free = media.filter("status = 'new' AND image_url IS NOT NULL").select(F.col("id").cast("long").alias("id"))
        free = free.join(jobs.outcomes().select("id"), "id", "left_anti").join(jobs.claimed(now), "id", "left_anti")
        free = free if limit is None else free.orderBy("id").limit(limit)
        return free.withColumn("until", F.lit(now).cast("timestamp_ntz") + F.expr(f"INTERVAL {lease}"))

    jobs.write("claims", run, claims)
    if not jobs.committed("outcomes", run):
        mine = jobs.read("claims", "id long, until timestamp_ntz", [run]).select("id")
        jobs.write("fetched", run, lambda: fetched(media.join(mine, "id", "left_semi"), steps, batch))
        images = jobs.read("fetched", FETCHED, [run])
        kept = ["id", "captured_at", "width", "height", "phash"]
        earlier = jobs.outcomes().select("id", F.col("phash").alias("found_"))
        stored = media.join(earlier, "id", "left").withColumn("phash", F.coalesce("found_", "phash")).select(*kept).join(mine, "id", "left_anti")
        jobs.write("twins", run, lambda: twins(images.select(*kept), stored))
        own = jobs.spark.newSession()  # images are large: few go to Python at once, by a setting of this session alone
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        jobs.write("outcomes", run, lambda: outcomes(jobs.read("fetched", FETCHED, [run], own).drop("run"), jobs.read("twins", "id long, twin long", [run], own).drop("run"), steps, batch))
        for step in ("fetched", "twins"):
            jobs.drop(step, run)
    return jobs.read("outcomes", OUTCOME, [run]).drop("run")


def detections_of(media: DataFrame, results: DataFrame, version: int) -> DataFrame:
    """A row for each box of images that are done, with the image's moment (of arrival, if it has none), its year, place and zone."""
    boxes = results.filter("status = 'done'").select(F.col("id").alias("media_id"), F.explode("boxes").alias("b")).select("media_id", "b.*")
    at = F.coalesce("captured_at", "ingested_at")
    own = media.select(F.col("id").alias("media_id"), at.alias("captured_at"), F.year(at).alias("year"), "zone_id", "lon", "lat")
    return boxes.withColumnRenamed("score", "confidence").join(own, "media_id").withColumns({"model_version": F.lit(version), "origin": F.lit("model")})


def run_counts(results: DataFrame) -> DataFrame:
    """One row: images claimed, failed, duplicates, those with boxes, empty ones, and all boxes."""
    done, n = F.col("status") == "done", F.size("boxes")
    return results.agg(
        F.count(F.lit(1)).alias("claimed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("duplicates"),
        F.count_if(done & (n > 0)).alias("with_boxes"), F.count_if(done & (n == 0)).alias("empty"), F.coalesce(F.sum(n), F.lit(0)).alias("boxes"),
    )
