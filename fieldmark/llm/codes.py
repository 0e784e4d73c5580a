"""Compression of vectors: product quantisation whose codebooks are fitted and applied by exponion search, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import discard, materialise, only
from fieldmark.llm.vectors import Codebook, batch_of, bytes_of, codes_of, matrix, means, with_whole_numbers

ASSIGNED = "vec_id long, label long, whole_ array<int>, code_ binary, error long, sums_ array<bigint>"


class Fit(NamedTuple):
    """Final codebooks (part, entry, component), and the rows with their codes and errors."""

    books: np.ndarray
    rows: DataFrame


def first_books(whole: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks made of the vectors of the smallest ids: as many as there are entries, so a bounded number of rows."""
    rows = whole.select("vec_id", "whole_").orderBy(F.col("vec_id").asc_nulls_last(), "whole_").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    widths = {len(r["whole_"]) for r in rows}
    if len(widths) > 1 or min(widths) % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; found {sorted(widths)}")
    return np.array([r["whole_"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def assign(rows: DataFrame, books: np.ndarray, started: bool, summed: bool) -> DataFrame:
    """Every row's nearest entries and its error; with ``summed``, a row for each task with sums and counts by part and entry.

    With ``started``, rows begin at the entries of ``code_``, those of the round before.
    """
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(x) for x in books]
        sums, seen = np.zeros((parts, size, width + 1), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            whole = batch.column("whole_")
            points = np.ascontiguousarray(matrix(whole, parts * width).T)
            before = codes_of(batch.column("code_"), parts) if started else None
            codes, error = np.empty((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for p, book in enumerate(made):
                own = points[p * width : (p + 1) * width]
                codes[:, p], gap = book.nearest(own, book.first_guess(own) if before is None else before[:, p])
                error += gap
                if summed:
                    for at, x in enumerate(own):
                        sums[p, :, at] += np.bincount(codes[:, p], x.astype(float), size).astype(np.int64)
                    sums[p, :, width] += np.bincount(codes[:, p], minlength=size)
            n = batch.num_rows
            yield batch_of([("vec_id", batch.column("vec_id")), ("label", batch.column("label")), ("whole_", whole), ("code_", bytes_of(codes)), ("error", pa.array(error)), ("sums_", pa.nulls(n, pa.list_(pa.int64())))])
        if seen and summed:
            yield batch_of(
                [("vec_id", pa.nulls(1, pa.int64())), ("label", pa.nulls(1, pa.int64())), ("whole_", pa.nulls(1, pa.list_(pa.int32()))), ("code_", pa.nulls(1, pa.binary())), ("error", pa.nulls(1, pa.int64())), ("sums_", pa.array([sums.ravel()], pa.list_(pa.int64())))]
            )

    return rows.mapInArrow(run, ASSIGNED)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, column: str = "embedding") -> Fit:
    """Fit a codebook to each of ``parts`` equal consecutive parts of all vectors, and give every row its code.

    Each round writes its rows with their codes, for the next one starts there, and the table before it is deleted. Sums by
    part and entry leave a task as one row and are added up by Spark; the driver sees a codebook's size of numbers, whatever the rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    source = only(vectors, "vec_id", "label", column).withColumns({c: F.col(c).cast("long") for c in ("vec_id", "label")})
    rows = with_whole_numbers(source, column, "whole_")
    books = first_books(rows, parts, entries)
    if not books.shape[1]:
        return Fit(books, spark.createDataFrame([], ASSIGNED).drop("sums_"))
    before = None
    for k in range(rounds + 1):
        done = materialise(assign(rows, books, started=before is not None, summed=k < rounds), "codes")
        if before is not None:
            discard(spark, before)
        rows, before = done.df.filter("sums_ IS NULL"), done.path
        if k < rounds:
            found = done.df.filter("sums_ IS NOT NULL").select(F.posexplode("sums_").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
            added = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
            for r in found:
                added[r["at"]] = r["n"]
            added = added.reshape(*books.shape[:2], -1)
            books = np.stack([means(old, x[:, :-1], x[:, -1]) for old, x in zip(books, added, strict=True)])
    return Fit(books, rows.drop("sums_"))


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector of whole numbers that a code (two hex digits a part) stands for."""
    return np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(code), strict=True)])


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, column: str = "embedding") -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error, codebooks_sha256.

    A component x counts as floor(256 * x); one beyond 2**26 is an error, and so are vectors of different lengths or of one that
    ``parts`` doesn't divide. Rows whose vector is null or has null or non-finite components are dropped. A null vec_id is kept, and
    comes last where codebooks begin with the smallest ids; rows that share an id begin in the order of their vectors. Repeated rows
    count each for themselves. Null labels are one group of label_error. Fewer rows than entries: as many entries as rows. Other
    columns are ignored. No rows: no rows.
    """
    found = fit(vectors, parts, entries, rounds, column)
    digest = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    of_label = materialise(found.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_"), "label-errors").df
    rows = found.rows.join(of_label, F.col("label").eqNullSafe(F.col("label_")))
    return rows.select("vec_id", F.lower(F.hex("code_")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
