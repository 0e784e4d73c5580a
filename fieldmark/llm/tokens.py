"""Token ids in ORC files: written in the order of document ids, read back by stripes, pruned by row indexes and Bloom filters."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import only, shared_dir, small_arrow_batches, text_batches
from fieldmark.llm.packing import known_words
from fieldmark.llm.vectors import batch_of

STORED = "part int, at long, doc_id long, n_tokens int, ids array<int>"
#: Parts whose sizes are added up in one task.
RUN = 1000


def encoded(texts: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The ids of each text and ``end_id``, with the task's number and the ids before the text in it; order is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = known_words(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in text_batches(batches):
            ids = known.of_all(batch.column(batch.schema.get_field_index("text")))
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield batch_of([("part", pa.array(np.full(len(ids), part, np.int32))), ("at", pa.array(at + ends[:-1])), ("doc_id", batch.column("doc_id")), ("n_tokens", pa.array(np.diff(ends).astype(np.int32))), ("ids", ids)])
            at += int(ends[-1])

    return texts.mapInArrow(run, STORED)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, stripe_bytes: int = 64 << 20, index_rows: int = 1000, false_positives: float = 0.01) -> None:
    """Write the ids of every document to ORC files under ``path``, in ascending order of doc_id over all files.

    Documents go to ranges of doc_id first and are encoded there, so texts are sent once and ids never. Repeated ids are in the
    order of the rows read, which also splits a range of one id; null ids come first. Integers have ORC's run-length encoding;
    each stripe has an index entry for ``index_rows`` rows (1,000 at least), with bounds and a Bloom filter of their doc_ids.
    """
    small_arrow_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row_").asc()]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = encoded(sorted_rows.select("doc_id", "text"), tokenizer, end_id).write.option("compression", "zstd")
    options = {"orc.stripe.size": stripe_bytes, "orc.rows.between.memory.checks": 100, "orc.row.index.stride": index_rows, "orc.create.index": True, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives}
    writer.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(part, at, doc_id, n_tokens, ids) of all documents, or of these: stripes and index entries without them are passed over."""
    rows = spark.read.schema(STORED).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def starts_of_parts(rows: DataFrame) -> DataFrame:
    """(part_, before_): the ids in all parts before each. Only the largest place of a part is read from the files."""
    size = rows.groupBy(F.col("part").alias("part_")).agg(F.max(F.col("at") + F.col("n_tokens")).alias("size")).withColumn("run_", F.floor(F.col("part_") / RUN))
    runs = size.groupBy("run_").agg(F.sum("size").alias("size"))
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.select(F.col("run_").alias("r_"), F.coalesce(F.sum("size").over(before().orderBy("run_")), F.lit(0)).alias("of_runs"))
    within = size.withColumn("of_parts", F.coalesce(F.sum("size").over(before("run_").orderBy("part_")), F.lit(0)))
    return within.join(sums, F.col("run_") == F.col("r_")).select("part_", (F.col("of_runs") + F.col("of_parts")).alias("before_"))


def checksums(rows: DataFrame) -> DataFrame:
    """(part, at, doc_id, n_tokens, ids_crc32) from the ids themselves, as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy().tolist()
            size = np.diff(cuts)
            if not np.array_equal(size, batch.column("n_tokens").to_numpy(zero_copy_only=False)):
                raise ValueError("the stored number of ids and the ids that were read differ")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield batch_of([("part", batch.column("part")), ("at", batch.column("at")), ("doc_id", batch.column("doc_id")), ("n_tokens", pa.array(size.astype(np.int64))), ("ids_crc32", pa.array(sums, pa.int64()))])

    return rows.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write all documents' ids to ORC files and return what the files hold: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, in the order of the files. A null text is empty and has the end id
    alone; null doc_ids come first; rows that share an id follow one another. Strings of special tokens in a text are ordinary
    text. Without ``path`` the files are in the shared folder. Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    at = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, at, end_id)
    rows = read_tokens(spark, at)
    found = checksums(rows).join(starts_of_parts(rows), F.col("part") == F.col("part_"))
    return found.select("doc_id", (F.col("before_") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
