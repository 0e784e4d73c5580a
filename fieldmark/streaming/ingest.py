"""Streams: observations from a landing folder into a store, each once, with a ledger of what was refused; windows over requests."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, PythonException
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fieldmark.operators.ingest import assign_zones, judged, new_rows
from fieldmark.sources.paged import Refused


def landing(spark: SparkSession, folder: str, schema: str, files: int = 200) -> DataFrame:
    """New JSON files of a folder, at most so many for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def stored_rows(like: DataFrame, store: str, years: list[int]) -> DataFrame:
    """The store's rows of these years; ``like``, which has no rows, before the first batch has made it."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(store).filter(F.col("year").isin(years))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], store: str, ledger: str, checkpoint: str, as_of: str, polygons: DataFrame | None = None, seconds: float | None = None) -> bool:
    """Read all that is there, then stop; True if ``seconds`` passed before that, and what is left waits for the next run.

    A batch appends rows that break no rule and aren't stored yet, with their zone if ``polygons`` are given (rows in none are refused),
    and a row for each reason, "unparseable" where the parser says so (column unparseable), "skipped_dupe" for known rows. Stored rows
    have the number of their batch, and "accepted" is the number of stored rows that have it: a batch that is run again after a failure
    anywhere finds its own rows, stores what is left, counts all of them once, and replaces its ledger rows. One that fails leaves a
    ledger row "error" and the run fails. Only the stored years that a batch has rows of are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, to = batch.sparkSession, f"{ledger}/batch={number}"
        try:
            rows = parse(batch)
            broken = F.col("unparseable") if "unparseable" in rows.columns else F.lit(False)
            rows = judged(rows, as_of)
            early = F.col("reason").isin("duplicate_of_inaturalist", "not_a_specimen")
            rows = rows.withColumn("reason", F.when(F.coalesce(early, F.lit(False)), F.col("reason")).when(broken, "unparseable").otherwise(F.col("reason"))).drop("unparseable")
            if polygons is not None:
                key = ["source", "external_id"]
                zoned = assign_zones(rows.filter("reason IS NULL").select(*key, "lon", "lat"), polygons, key).withColumnRenamed("assigned_zone", "zone_id")
                rows = rows.join(zoned, key, "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("zone_id").isNull(), "outside_zone").otherwise(F.col("reason")))
            rows = rows.persist()
            good = rows.filter("reason IS NULL").drop("reason", "basis").withColumns({"year": F.year("captured_at"), "ingest_batch": F.lit(number).cast("long")})
            reasons = rows.groupBy("reason", F.when(F.col("reason").isNull(), F.year("captured_at")).alias("year")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each reason and year
            years = [r["year"] for r in reasons if r["reason"] is None]
            new_rows(good, stored_rows(good.limit(0), store, years), ["source", "external_id"]).write.mode("append").partitionBy("year").parquet(store)
            kept = stored_rows(good.limit(0), store, years).filter(F.col("ingest_batch") == number).count()
            counts = Counter({"accepted": kept, "skipped_dupe": sum(r["n"] for r in reasons if r["reason"] is None) - kept})
            for r in reasons:
                counts[r["reason"]] += r["n"] if r["reason"] is not None else 0
            spark.createDataFrame([x for x in counts.items() if x[1]], "reason string, n long").coalesce(1).write.mode("overwrite").parquet(to)
            rows.unpersist()
        except Exception as e:
            spark.createDataFrame([(f"error: {type(e).__name__}", 0)], "reason string, n long").write.mode("overwrite").parquet(to)
            raise

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if query.awaitTermination(seconds) if seconds is not None else query.awaitTermination() is None:
        return False
    query.stop()
    return True


def run_all(runs: dict[str, Callable[[], object]], outages: tuple[type[BaseException], ...] = (Refused, ConnectionError, TimeoutError)) -> dict[str, str]:
    """Run each zone's ingest by itself: an outage of its provider doesn't stop the others; if none succeeds, that is an error.

    Outages are exceptions of these kinds, also where a task or a stream raised them. Errors of any other kind are raised.
    """
    out = {}
    for name, run in runs.items():
        try:
            run()
            out[name] = "ok"
        except Exception as e:
            kinds = "|".join(k.__name__ for k in outages)
            remote = isinstance(e, (CapturedException, PythonException)) and re.search(rf"^(?:[\w.]*\.)?(?:{kinds})\b", str(e), re.MULTILINE)
            if not isinstance(e, outages) and not remote:
                raise
            out[name] = f"{type(e).__name__}: {e}"[:300]
    if out and "ok" not in out.values():
        raise RuntimeError(f"nothing was fetched: {out}")
    return out


class Limiter(StatefulProcessor):
    """Requests of each client in the order of their times: at most ``most`` are allowed in any window.

    A client's state is the times of its allowed requests that still count. A timer clears it once the watermark has passed the end of the
    last one's window, so clients that stay away leave nothing behind.
    """

    def __init__(self, most: int, window: int) -> None:
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.hits = handle, handle.getValueState("hits", "at array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        hits = list(self.hits.get()[0]) if self.hits.exists() else []
        times = np.sort(np.concatenate([r["at"].to_numpy(np.int64) for r in rows]))
        waits = []
        for t in times.tolist():
            hits = [h for h in hits if t - h < self.window]
            waits.append((self.window - (t - hits[0])) / 1e6 if len(hits) >= self.most else None)
            if waits[-1] is None:
                hits.append(t)
        self.hits.update((hits,))
        self.handle.registerTimer(self.gone(hits))
        yield pd.DataFrame({"client": [key[0]] * len(times), "at": times, "wait": pd.array(waits, "Float64")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.hits.exists() and self.gone(list(self.hits.get()[0])) <= expiredTimerInfo.getExpiryTimeInMs():
            self.hits.clear()
        return iter(())

    def gone(self, hits: list[int]) -> int:
        """The millisecond from which none of these count."""
        return -(-(max(hits) + self.window) // 1000)


def limited(requests: DataFrame, client: str, time: str, most: int, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(client, at, wait) of a stream of requests: null where a request is allowed, else seconds until the client may try again.

    Requests of a micro-batch are taken in the order of their times. Those that come later than ``late`` behind the newest get no answer,
    for what they would be counted with may be gone. Needs the state store of RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    if most < 1:
        raise ValueError("at least one request must be allowed in a window")
    kind = requests.schema[client].dataType.simpleString()
    stamped = requests.withColumn("stamp_", F.col(time).cast("timestamp")).withWatermark("stamp_", late)
    named = stamped.select(F.col(client).alias("client"), F.unix_micros("stamp_").alias("at"), "stamp_")
    return named.groupBy("client").transformWithStateInPandas(Limiter(most, seconds * 1_000_000), f"client {kind}, at long, wait double", "Append", "EventTime")


def distinct_within(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """Rows of a stream, one for each key within the horizon; state older than it is dropped."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def monthly_counts(stream: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Running counts by calendar month; complete mode keeps late rows of any age right."""
    return stream.groupBy(*keys, F.to_date(F.date_trunc("month", time)).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def requests_in_window(requests: DataFrame, client: str, time: str, seconds: int = 60) -> DataFrame:
    """Each request with the number of its client's requests in the window that ends with it."""
    w = Window.partitionBy(client).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))
