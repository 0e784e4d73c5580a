"""Polynomial hashes of byte strings, and counts that are dealt by shards of a key and kept in files that all executors map."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import shared_dir

U64 = np.uint64

def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1


BASE = _odd(1)
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            self.table = np.concatenate([self.table, self.table * U64(pow(self.base, len(self.table), 1 << 64))])
        return self.table[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)
#: Places that are hashed at a time: what is held of them stays in a core's cache.
TILE = 1 << 15


def running_sums(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Sums of the symbols (their numbers in the table, if there is one) times powers of the base, before each place and after the last."""
    n = len(data)
    sums, up = np.zeros(n + 1, U64), UP.upto(n)
    for a in range(0, n, TILE):
        part = data[a : a + TILE]
        own = sums[a + 1 : a + 1 + len(part)]
        np.cumsum((part if table is None else table[part]) * up[a : a + TILE], out=own)
        own += sums[a]
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


# --- files that all executors see -------------------------------------------------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def save(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays to one file, under another name first, so that a file is whole or absent whatever happens to its task."""
    files, path = filesystem(uri)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with files.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    try:
        files.move(own, path)
    except OSError:  # some stores don't rename onto a file; another attempt of this task has written the same one
        if not files.get_file_info(path).is_file:
            raise
        files.delete_file(own)


#: Files that a worker keeps mapped, in a mounted folder (systems bound the mappings of a process) and as copies from a store.
MAPPED, COPIED = 8_000, 256


def most_open(folder: str) -> int:
    from pyarrow import fs

    return MAPPED if isinstance(filesystem(folder)[0], fs.LocalFileSystem) else COPIED


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped: in place if it is in a mounted folder, else from a copy that has no name any more."""
    from pyarrow import fs

    files, path = filesystem(uri)
    if not isinstance(files, fs.LocalFileSystem):
        handle, own = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, files.open_input_stream(path) as source:
            while data := source.read(1 << 22):
                out.write(data)
        data = np.memmap(own, np.uint8, "r")
        os.unlink(own)
    else:
        data = np.memmap(path, np.uint8, "r")
    data = np.asarray(data)  # a plain array over the mapped pages
    n = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + n].tobytes())
    return {name: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, size, at) in head.items()}


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, their summed counts, and any other column (the same for equal keys)."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + keys.dtype.type(1))) if len(keys) else np.zeros(0, np.int64)
    columns = [np.concatenate([p[i] for p in parts])[order] for i in range(1, len(parts[0]))]
    return keys[at], (np.add.reduceat(columns[0], at) if len(at) else columns[0]), *[c[at] for c in columns[1:]]


class Sums:
    """Counts by key that are merged as they grow."""

    def __init__(self, least: int = 2_000_000) -> None:
        self.least, self.parts = least, []
        self.size, self.merged = 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * self.merged + self.least:
            self.parts = [_merge(self.parts)]
            self.size = self.merged = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, ...] | None:
        return _merge(self.parts) if self.parts else None


BLOB = "shard long, a binary, b binary, c binary"


def packed(a: np.ndarray) -> bytes:
    """An integer array in few bytes: differences of neighbours, all their first bytes, then all second ones, and so on, compressed."""
    wide = a.astype(U64)
    planes = np.diff(wide, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(a).to_bytes(8, "little") + planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(8, n).T
    return np.cumsum(np.ascontiguousarray(planes).view(U64).ravel(), dtype=U64).astype(kind)


def blobs(shard: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard with its part of the columns; ``shard`` must ascend."""
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            data = [*[packed(c[a:b]) for c in columns], *[b""] * (3 - len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int64()), *[pa.array([x], pa.binary()) for x in data]], ["shard", "a", "b", "c"])


def by_shard(batches: Iterator[pa.RecordBatch], kinds: tuple[type, ...]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(shard, merged columns) of rows that are sorted by shard."""
    now, sums = None, Sums()
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.column(0)[i].as_py()
            if shard != now:
                if now is not None:
                    yield now, sums.result()
                now, sums = shard, Sums()
            sums.add(*[unpacked(batch.column(1 + k)[i].as_py(), kind) for k, kind in enumerate(kinds)])
    if now is not None:
        yield now, sums.result()


def power_of_two(n: float) -> int:
    """Bits of the least power of two that is n or more."""
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def spread(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(max(1, min(shards, 50_000)), "shard").sortWithinPartitions("shard")


# --- files by part ------------------------------------------------------------------------------------------------------------


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one."""
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    return folder


def filed(rows: DataFrame, texts: DataFrame, columns: list[str], write: Callable[[int, pa.Table], None]) -> int:
    """Send rows to their part and write one file for each part of ``texts``, if need be without rows; the number of files."""
    every = texts.select("part_").distinct()
    for c in columns:
        every = every.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    sent = rows.select("part_", *columns).unionByName(every).repartition("part_").sortWithinPartitions("part_", *[c for c in columns if c in ("kind", "hi", "lo", "row_")])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], 0
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and parts[a] != now:
                    write(int(now), pa.Table.from_batches(held))
                    done, held = done + 1, []
                now = parts[a]
                held.append(batch.slice(a, b - a))
        if held:
            write(int(now), pa.Table.from_batches(held))
            done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    return sent.mapInArrow(keep, "files long").agg(F.sum("files")).first()[0] or 0
