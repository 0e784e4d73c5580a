"""Vectors as whole numbers, and the nearest entry of a codebook by exponion search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Largest whole number of a component, either sign: beyond it, squared distances and products might not fit in 64 bits.
LARGEST = 1 << 26


def is_usable(vector: Column) -> Column:
    """True for a vector whose components are all there and finite."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))


def whole_numbers(vector: Column) -> Column:
    """array<int> of floor(256 * x), x as double; an error where a component is beyond ``LARGEST``."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    too_large = F.exists(whole, lambda x: (x > LARGEST) | (x < -LARGEST))
    return F.when(~too_large, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {SCALE}")))


def with_whole_numbers(rows: DataFrame, vector: str, out: str) -> DataFrame:
    """The usable rows, their vectors as whole numbers in ``out``."""
    return rows.filter(is_usable(F.col(vector))).withColumn(out, whole_numbers(F.col(vector))).drop(vector)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The column's vectors as rows; all must have ``width`` components."""
    if len(column) and np.any(np.diff(column.offsets.to_numpy()) != width):
        raise ValueError(f"every vector must have {width} components, as the first has")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def batch_of(columns: Sequence[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])


def bytes_of(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of numbers below 256 as bytes."""
    data = np.ascontiguousarray(rows, np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    """What ``bytes_of`` made, as a matrix again."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of columns of two matrices, component by component: these are few, the columns many."""
    out = np.zeros(points.shape[1], np.int64)
    for x, c in zip(points, entries, strict=True):
        gap = x - c
        gap *= gap
        out += gap
    return out


class Codebook:
    """The entries of one part, with every entry's list of all entries by their squared distance from it, ties to the lower index.

    ``nearest`` starts at an entry for each point. What is as near to the point as that entry, or nearer, is at most twice the
    point's distance from that entry away from it, by the triangle inequality: in squares of whole numbers, four times. Only the
    list's head within that radius is looked at, so the answer is exact and doesn't depend on where a point starts.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = np.asarray(entries, np.int64)
        self.columns = np.ascontiguousarray(self.entries.T)
        gaps = ((self.entries[:, None] - self.entries[None]) ** 2).sum(-1)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        along = self.entries.sum(1)
        self.along = np.argsort(along, kind="stable")
        self.marks = along[self.along]

    def first_guess(self, points: np.ndarray) -> np.ndarray:
        """Where points start that have no entry yet: an entry with about the same sum of components. ``points``: one a column."""
        return self.along[np.minimum(np.searchsorted(self.marks, points.sum(0)), len(self.along) - 1)]

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points (one a column) the index of the nearest entry, the lower one of equals, and the squared distance."""
        start = start.astype(np.int64)
        own = squared(points, self.columns[:, start])
        reach = np.zeros(len(start), np.int64)
        by_start = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[by_start], np.arange(len(self.entries) + 1))
        for entry, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                which = by_start[a:b]
                reach[which] = np.searchsorted(self.gaps[entry], 4 * own[which], side="right")
        far_first = np.argsort(-reach, kind="stable")
        points, start, best, index = points[:, far_first], start[far_first], own[far_first], start[far_first].copy()
        looking = np.searchsorted(-reach[far_first], -np.arange(int(reach.max(initial=0))), side="left")
        for place, n in enumerate(looking.tolist()):
            other = self.order[start[:n], place]
            gap = squared(points[:, :n], self.columns[:, other])
            better = (gap < best[:n]) | ((gap == best[:n]) & (other < index[:n]))
            best[:n][better], index[:n][better] = gap[better], other[better]
        out, distance = np.empty_like(index), np.empty_like(best)
        out[far_first], distance[far_first] = index, best
        return out, distance


def means(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry replaced by floor(sum / count) of its points, componentwise; one without points stays."""
    used = counts > 0
    out = entries.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out
