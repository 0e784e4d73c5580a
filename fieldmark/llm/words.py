"""Words of many texts at once: places and 64-bit hashes, from running sums over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from fieldmark.llm.common import utf8_column
from fieldmark.llm.shards import DOWN, U64, mix, running_sums

#: Bytes of text that are hashed at a time (longer texts are cut at white space), and that are handed on together.
CHUNK, GROUP = 2 << 20, 8 << 20
_BYTE = np.random.default_rng(2).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Words(NamedTuple):
    """For each word its hash, the row of its text, and its place in ``data``."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes


def hashes_at(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of these runs of bytes; A-Z count as a-z."""
    sums = running_sums(raw, _BYTE)
    h = (sums[ends] - sums[starts]) * DOWN.upto(len(raw) + 1)[starts]
    return mix(h + (ends - starts).astype(U64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words between ASCII white space; A-Z count as a-z. Equal hashes are taken for equal words."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    return hashes_at(raw, starts, ends), starts, ends


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, in runs of about GROUP bytes; a longer text is a run of its own."""
    for batch in batches:
        texts = utf8_column(batch, "text")
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= GROUP):
                size += len(texts[upto]) + 1
                upto += 1
            yield batch.slice(at, upto - at), texts[at:upto]
            at = upto


def words_of(texts: list[bytes]) -> Words:
    """The words of all texts, in order."""
    data = b" ".join(texts)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):  # a long text in pieces that end at white space
        end = min(len(data), at + 2 * CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        h, a, b = word_hashes(data[at:end])
        hashes.append(h)
        starts.append(a + at)
        ends.append(b + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return Words(join(hashes, U64), row, start, join(ends, np.int64), data)
