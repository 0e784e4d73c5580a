"""Hard-negative mining: product quantisation with stored residual norms bounds every score, exact scores decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only
from fieldmark.llm.vectors import Codebook, batch_of, bytes_of, codes_of, matrix, means, with_whole_numbers

#: Rows that codebooks are fitted to, and rows whose exact scores give the first bounds of an anchor's lists. Both only save work.
SAMPLE = 8192
#: Anchors of one pass over the index; entries of a codebook; components of a part; rounds of fitting.
ANCHORS, ENTRIES, WIDTH, ROUNDS = 2048, 256, 2, 4
#: Rows, and then pairs, that are scored at a time.
ROWS, PAIRS = 1024, 1 << 15
#: Stands for a null vec_id, which comes last among equal scores.
NO_ID = (1 << 63) - 1
INDEX = "row_ long, id_ long, label_ long, whole_ array<int>, code_ binary, residual_ double"


class Rules(NamedTuple):
    """Positives of an anchor, negatives of a positive, and the least and most of a negative's score in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90


def fit_books(sample: np.ndarray) -> list[np.ndarray]:
    """Codebooks of consecutive parts, fitted to a sample; any codebooks give the same results, good ones sooner."""
    books = []
    for at in range(0, sample.shape[1], WIDTH):
        points = sample[:, at : at + WIDTH]
        found, first = np.unique(points, axis=0, return_index=True)
        entries, columns = points[np.sort(first)[:ENTRIES]] if len(found) else points, np.ascontiguousarray(points.T)
        place = None
        for _ in range(ROUNDS):
            book = Codebook(entries)
            place, _ = book.nearest(columns, book.first_guess(columns) if place is None else place)
            sums = np.stack([np.bincount(place, x.astype(float), len(entries)) for x in columns], 1).astype(np.int64)
            entries = means(entries, sums, np.bincount(place, minlength=len(entries)))
        books.append(entries)
    return books


def indexed(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Every row with its code and the norm of what the code leaves, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(x) for x in books]
        for batch in batches:
            points = np.ascontiguousarray(matrix(batch.column("whole_"), sum(x.shape[1] for x in books)).T)
            codes, error, at = np.empty((batch.num_rows, len(books)), np.int64), np.zeros(batch.num_rows, np.int64), 0
            for p, book in enumerate(made):
                own = points[at : at + len(book.columns)]
                at += len(book.columns)
                codes[:, p], gap = book.nearest(own, book.first_guess(own))
                error += gap
            yield batch_of([*[(c, batch.column(c)) for c in ("row_", "id_", "label_", "whole_")], ("code_", bytes_of(codes)), ("residual_", pa.array(rounded_up(error)))])

    return rows.mapInArrow(run, INDEX)


def rounded_up(squares: np.ndarray) -> np.ndarray:
    """Square roots that are never too small."""
    return np.sqrt(squares.astype(float)) * (1 + 1e-9)


class Block(NamedTuple):
    """Rows of the index as arrays."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    code: np.ndarray
    residual: np.ndarray

    def at(self, which: np.ndarray | slice) -> Block:
        return Block(*[x[which] for x in self])


def block_of(batch: pa.RecordBatch, width: int, parts: int) -> Block:
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return Block(number("row_"), number("id_"), number("label_"), matrix(batch.column("whole_"), width), codes_of(batch.column("code_"), parts), number("residual_"))


class Lists:
    """The best ``most`` (score, id) of each group, higher scores first, then smaller ids.

    ``bound`` is a score that a row must reach to enter a group's list: its worst, once the list is full, or what is known before.
    """

    def __init__(self, groups: int, most: int, bound: np.ndarray) -> None:
        self.groups, self.most, self.bound = groups, most, bound.copy()
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        good = score >= self.bound[group]
        if not good.any():
            return
        group, score, ident = (np.concatenate([old, new[good]]) for old, new in zip((self.group, self.score, self.id), (group, score, ident), strict=True))
        by = np.lexsort((ident, -score, group))
        group = group[by]
        place = np.arange(len(by)) - np.searchsorted(group, group)
        keep = place < self.most
        self.group, self.score, self.id = group[keep], score[by][keep], ident[by][keep]
        full = place[keep] == self.most - 1
        self.bound[self.group[full]] = np.maximum(self.bound[self.group[full]], self.score[full])


class Anchors:
    """Anchors of one pass, in the order of their labels, with a look-up table of products for each part.

    ``tables[p][entry, anchor]`` is the product of the anchor's part and the entry, so a row's products with all anchors are sums of
    table rows. The product with what the code leaves is at most the anchor's norm times the stored norm, either sign, which bounds
    the true score on both sides.
    """

    def __init__(self, block: Block, books: list[np.ndarray]) -> None:
        self.block, self.books = block, books
        self.norm = rounded_up((block.whole**2).sum(1))
        largest = sum(int(np.abs(b).max(initial=0)) * b.shape[1] for b in books) * int(np.abs(block.whole).max(initial=0))
        self.kind = np.int32 if largest < 2**31 else np.int64
        self.tables: list[np.ndarray] = []

    def build(self) -> Anchors:
        """Make the tables, in the task that looks things up."""
        at = 0
        for book in self.books:
            self.tables.append(np.ascontiguousarray((book @ self.block.whole[:, at : at + book.shape[1]].T).astype(self.kind)))
            at += book.shape[1]
        return self

    def looked_up(self, code: np.ndarray, a: int, b: int) -> np.ndarray:
        """Approximate scores of rows with the anchors from a to b."""
        out = np.zeros((len(code), b - a), self.kind)
        for table, entry in zip(self.tables, code.T, strict=True):
            out += table[entry, a:b]
        return out

    def exact(self, rows: Block, row: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """True scores of pairs: (row, anchor, score), some at a time."""
        for at in range(0, len(row), PAIRS):
            r, q = row[at : at + PAIRS], anchor[at : at + PAIRS]
            yield r, q, np.einsum("ij,ij->i", rows.whole[r], self.block.whole[q])

    def same_label(self, rows: Block, lists: Lists) -> None:
        """Take rows into the lists of anchors of their label, the anchor's own row not."""
        for label in np.unique(rows.label):
            a, b = np.searchsorted(self.block.label, [label, label + 1]).tolist()
            of_label = rows.at(np.flatnonzero(rows.label == label))
            for lo in range(0, len(of_label.row) if b > a else 0, ROWS):
                part = of_label.at(slice(lo, lo + ROWS))
                highest = self.looked_up(part.code, a, b) + part.residual[:, None] * self.norm[a:b]
                row, anchor = np.nonzero((highest + 1 >= lists.bound[a:b]) & (part.row[:, None] != self.block.row[a:b]))
                for r, q, score in self.exact(part, row, anchor + a):
                    lists.add(q, score, part.id[r])

    def other_labels(self, rows: Block, lists: Lists, low: np.ndarray, high: np.ndarray) -> None:
        """Take rows of other labels into the lists of each anchor's windows: ``low`` to ``high`` by anchor and window."""
        n, windows = low.shape
        most = high.max(1)
        for lo in range(0, len(rows.row), ROWS):
            part = rows.at(slice(lo, lo + ROWS))
            least = np.maximum(low, lists.bound.reshape(n, windows)).min(1)
            near, slack = self.looked_up(part.code, 0, n), part.residual[:, None] * self.norm + 1
            row, anchor = np.nonzero((near + slack >= least) & (near - slack <= most) & (part.label[:, None] != self.block.label))
            for r, q, score in self.exact(part, row, anchor):
                pair, k = np.nonzero((score[:, None] >= low[q]) & (score[:, None] <= high[q]))
                lists.add(q[pair] * windows + k, score[pair], part.id[r[pair]])


def windows_of(positives: list[tuple[int, int, int]], anchors: int, rules: Rules) -> tuple[np.ndarray, ...]:
    """Lowest and highest score of each window, and the positive's id and score; a positive that isn't there has an empty window."""
    low, high = np.full((anchors, rules.positives), NO_ID), np.full((anchors, rules.positives), -NO_ID)
    ident, score = np.zeros((2, anchors, rules.positives), np.int64)
    for q, k, s, i in positives:
        low[q, k], high[q, k], ident[q, k], score[q, k] = -(-rules.least * s // 100), rules.most * s // 100, i, s
    return low, high, ident, score


def first_of(found: DataFrame, most: int) -> DataFrame:
    """Each group's first rows, with their place from 1."""
    place = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def listed(index: DataFrame, anchors: Anchors, lists: Lists, low: np.ndarray | None = None, high: np.ndarray | None = None) -> DataFrame:
    """(group, score, id): the lists of every task, of positives, or of windows if there are any."""
    width, parts, bound, groups, most = anchors.block.whole.shape[1], len(anchors.books), lists.bound, lists.groups, lists.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = Lists(groups, most, bound), anchors.build()
        for batch in batches:
            if low is None:
                mine.same_label(block_of(batch, width, parts), own)
            else:
                mine.other_labels(block_of(batch, width, parts), own, low, high)
        yield batch_of([("group", pa.array(own.group)), ("score", pa.array(own.score)), ("id", pa.array(own.id))])

    return index.mapInArrow(run, "group long, score long, id long")


def mined(index: DataFrame, anchors: Block, seeds: Block, books: list[np.ndarray], rules: Rules) -> DataFrame:
    """Hard negatives of a bounded number of anchors: one pass over the index for positives, one for the negatives in their windows."""
    spark, n, k = index.sparkSession, len(anchors.row), rules.positives
    made = Anchors(anchors, books)
    best, trial = Lists(n, k, np.full(n, -NO_ID)), Anchors(anchors, books).build()
    trial.same_label(seeds, best)  # its lists aren't kept: these rows come again
    positives = first_of(listed(index, made, Lists(n, k, best.bound)), k).select("group", "place", "score", "id").collect()  # at most k an anchor
    low, high, ident, score = windows_of([(r["group"], r["place"] - 1, r["score"], r["id"]) for r in positives], n, rules)
    best = Lists(n * k, rules.negatives, np.full(n * k, -NO_ID))
    trial.other_labels(seeds, best, low, high)
    found = first_of(listed(index, made, Lists(n * k, rules.negatives, best.bound), low, high), rules.negatives)
    pairs = pa.table({"group_": np.arange(n * k), "anchor_id": np.repeat(anchors.id, k), "positive_id": ident.ravel(), "positive_score": score.ravel()})
    out = found.join(spark.createDataFrame(pairs.to_pandas()), F.col("group") == F.col("group_"))
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select("anchor_id", named("positive_id").alias("positive_id"), F.col("place").alias("rank"), named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], rules: Rules = Rules(), column: str = "embedding") -> DataFrame:
    """Hard negatives for each anchor and each of its positives: anchor_id, positive_id, rank, negative_id and both scores.

    A score is the integer product of two vectors of floor(256 * x); higher scores come first, then smaller vec_ids. Positives are an
    anchor's first ``rules.positives`` other rows of its label, negatives the first ``rules.negatives`` rows of other labels whose
    score is between ``rules.least`` and ``rules.most`` hundredths of the positive's (with a negative score there is none).

    ``is_anchor`` makes a condition of vec_id. Rows with a null label or vector, or a null or infinite component, take no part. A null
    vec_id comes last among equals and is no anchor. Rows are told apart by themselves: repeated rows are positives of one another,
    and repeated anchors have rows each. Components beyond 2**26 / 256 are an error, and so are vectors of different lengths.
    Other columns are ignored. No rows: no rows.

    Codes are made for all rows; codebooks are fitted to at most ``SAMPLE`` rows of least hash. Anchors go over the index some at a
    time, each pass with two bounded broadcasts; a task keeps the best rows of each list alone.
    """
    spark = vectors.sparkSession
    rows = only(vectors, "vec_id", "label", column).filter(F.col("label").isNotNull())
    rows = with_whole_numbers(rows, column, "whole_").select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id_"), F.col("label").cast("long").alias("label_"), "whole_")
    least = lambda df, *cols: df.orderBy(F.xxhash64("id_"), "label_").limit(SAMPLE).select(*cols)
    sample = [r[0] for r in least(rows, "whole_").collect()]
    empty = spark.createDataFrame([], RESULT)
    if not sample:
        return empty
    if len({len(x) for x in sample}) > 1:
        raise ValueError("vectors must have one length")
    books, width = fit_books(np.array(sample, np.int64)), len(sample[0])
    index = materialise(indexed(rows.withColumn("row_", F.monotonically_increasing_id()).select("row_", "id_", "label_", "whole_"), books), "negatives").df
    names = [c.split()[0] for c in INDEX.split(", ")]
    taken = lambda df: [block_of(b, width, len(books)) for b in df.select(*names).toArrow().combine_chunks().to_batches()]
    anchors = index.filter(is_anchor(F.col("id_")) & (F.col("id_") != NO_ID))
    passes = -(-anchors.count() // ANCHORS)
    [seeds] = taken(least(index, *names))
    parts = []
    for k in range(passes):
        for chosen in taken(anchors.filter(F.pmod(F.xxhash64("row_"), F.lit(passes)) == k).orderBy("label_", "row_")):
            parts.append(materialise(mined(index, chosen, seeds, books, rules), "negatives-found").path)
    return spark.read.schema(RESULT).parquet(*parts) if parts else empty

