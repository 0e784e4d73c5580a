"""SimHash near-duplicates: pigeonhole blocks of 64-bit fingerprints, exact Hamming distances, components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only, small_arrow_batches, small_batches, utf8_column
from fieldmark.llm.components import connected_components

#: Every shingle's hash has this seed.
SEED = 42
#: Bits of the blocks into which a fingerprint is split; of these, all but ``distance`` must be equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Blocks with more fingerprints than this are split by finer blocks; those hold 2 ** (distance * FINE) fingerprints at most.
CROWD = 1024
FINE = 4
#: Fingerprints that a worker keeps by text, so that copies are hashed once.
KNOWN_TEXTS = 20_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """Words between ASCII white space, A-Z in lower case; a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(ends) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; eight one-byte counters to a word, at most 255 hashes at a time."""
    n = len(hashes)
    pad = -n % 255
    rows = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255)
    ones = np.uint64(0x0101010101010101)
    out = 0
    for i in range(8):
        packed = ((rows >> np.uint64(i)) & ones).sum(axis=1, dtype=np.uint64)
        counts = packed.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # little-endian: byte j counts bit 8 j + i
        for j in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(j) + i)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long of the same bits."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in small_batches(batches):
            values = []
            for text in utf8_column(batch, "text"):
                name = xxhash.xxh128_digest(text)
                fp = known.get(name)
                if fp is None:
                    if len(known) >= KNOWN_TEXTS:
                        known.clear()
                    known[name] = fp = fingerprint(text)
                values.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(hashed, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(blocks: list[int], distance: int) -> list[int]:
    """The bits kept when ``distance`` of the blocks are left out, for each choice."""
    return [_signed(sum(kept)) for kept in combinations(blocks, len(blocks) - distance)]


def _blocks(widths: tuple[int, ...]) -> list[int]:
    at, out = 0, []
    for w in widths:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def _keys(masks: list[int]) -> Column:
    fp = F.col("fp")
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))


def star_links(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links within ``distance`` reduced to one tree for each component; visits each fingerprint once against those not reached yet."""
    left = np.unique(fps)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                for other in left[near]:
                    yield int(one), int(other)
                front.extend(left[near])
                left = left[~near]


def _links(groups: DataFrame, distance: int) -> DataFrame:
    """Links inside each group of an array column ``fps``."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            pairs = [p for fps in batch.column(0).to_pylist() for p in star_links(np.array(fps, np.int64).view(np.uint64), distance)]
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return groups.select("fps").mapInArrow(link, "a long, b long")


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links that join exactly the fingerprints that differ in ``distance`` bits or fewer into the same components.

    ``fps`` has distinct fingerprints. Two that are so close are equal in all but ``distance`` blocks, so they meet under at least
    one choice of blocks. A choice keeps 32 bits or more, so few others meet there, except for families of near copies: blocks
    crowded by these are split once more by every choice of fine blocks, each of which holds 4,096 fingerprints at most. A group's
    links are reduced to trees before they leave its task.
    """
    blocks = _blocks(BLOCKS)
    masks = _masks(blocks, distance)
    keyed = fps.select("fp", _keys(masks).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("x.k").alias("k"))
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    met = materialise(keyed.join(sizes.select(F.col("t").alias("t_"), F.col("k").alias("k_"), "n"), (F.col("t") == F.col("t_")) & (F.col("k") == F.col("k_"))).select("fp", "t", "k", "n"), "blocks").df
    cold = met.filter(F.col("n") <= CROWD).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    fine = []
    for t, mask in enumerate(masks):
        bits = [i for i in range(64) if not (mask >> i) & 1]
        parts = [sum(1 << i for i in bits[at : at + FINE]) for at in range(0, len(bits), FINE)]
        same = (mask % (1 << 64)) if mask < 0 else mask
        kept = F.array(*[F.lit(_signed(same | sum(c))) for c in combinations(parts, len(parts) - distance)])
        fine.append((t, kept))
    choice = F.coalesce(*[F.when(F.col("t") == t, kept) for t, kept in fine])
    hot = met.filter(F.col("n") > CROWD).select("fp", "t", F.posexplode(choice).alias("c", "mask")).select("fp", "t", "c", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    hot = hot.groupBy("t", "c", "k").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return _links(cold, distance).unionByName(_links(hot, distance)).distinct()


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Links join fingerprints that differ in ``distance`` bits or fewer, equal ones included. A null or wordless text has fingerprint
    zero and is linked like any other. Repeated rows keep a row each. A null doc_id is never the smallest, so component_id is
    null only where a component has no other. Other columns are ignored. No rows: no rows.
    """
    small_arrow_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    rows = materialise(fingerprints(docs), "fingerprints").df
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_")), "classes").df
    roots = connected_components(near_links(classes.select("fp"), distance))
    member = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "first_")
    heads = member.groupBy("root").agg(F.min("first_").alias("component_")).withColumnRenamed("root", "root_")
    joined = materialise(member.join(heads, F.col("root") == F.col("root_")).select(F.col("fp").alias("fp_"), "component_"), "members").df
    named = classes.join(joined, F.col("fp") == F.col("fp_"), "left").select(F.col("fp").alias("fp_"), F.coalesce("component_", "first_").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("fp_")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
