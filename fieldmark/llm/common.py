"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as ``bytes.split()`` takes it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Rows of one chunk when rows are numbered without a global sort.
CHUNK_BITS = 16


class Table(NamedTuple):
    """A written intermediate result and its place."""

    df: DataFrame
    path: str


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="fieldmark-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
    return _OWN[context.applicationId]


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns, by their exact names; where others differ from them in case or repeat them, the first exact one counts."""
    first = {n: df.columns.index(n) for n in names}
    return df.toDF(*[c if first.get(c) == i else f"other_{i}_" for i, c in enumerate(df.columns)]).select(*names)


def small_arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send texts to Python in batches of so many rows, unless the session asks for fewer: a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def materialise(df: DataFrame, tag: str) -> Table:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Table(spark.read.schema(df.schema).parquet(path), path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate result that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def str_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column's texts; a null text is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that what a step holds at a time stays small, whatever the batch size of the session."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to about so many bytes of text; a longer text may be one of its own."""
    for batch in batches:
        length = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // size, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def with_chunk(df: DataFrame, name: str = "chunk_") -> DataFrame:
    """Number runs of at most 65,536 neighbouring rows of an input partition; write the result before it is read twice."""
    return df.withColumn(name, F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))


def numbered(df: DataFrame, key: str, order: list[str], out: str, chunk: str = "chunk_") -> DataFrame:
    """Number the rows of each key from 0 without gaps, in as many tasks as there are chunks.

    ``df`` must be a written table that has the column ``chunk``. Counts are taken per chunk and key, added up over the chunks
    of a key, and a row's number is its chunk's sum plus its place in the chunk.
    """
    counts = df.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("k_"), F.col(chunk).alias("c_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("off_"))
    place = Window.partitionBy(key, chunk).orderBy(*order)
    return (
        df.withColumn("local_", F.row_number().over(place) - 1)
        .join(offsets, (F.col(key).eqNullSafe(F.col("k_"))) & (F.col(chunk) == F.col("c_")))
        .withColumn(out, (F.col("off_") + F.col("local_")).cast("long"))
        .drop("k_", "c_", "off_", "local_", chunk)
    )
