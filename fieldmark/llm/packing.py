"""Packing of tokenised documents into sequences: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only, small_arrow_batches, text_batches
from fieldmark.llm.words import hashes_at

#: Words that a worker remembers; beyond so many it keeps those that came again.
KNOWN_WORDS = 1_500_000
#: Punctuation behind a word's last letter or digit, and the same with a space between them.
STOPS, APART = r"([a-z0-9ß-öø-ÿ])([!-/:-@\[-`{-~]+(?:[\x20\x09-\x0D]|$))", r"\1 \2"
#: Words of lower-case letters that are the same in every normal form.
LETTERS = "^[a-zß-öø-ÿ]+$"


@cache
def tokenizer_of(path: str):
    """The tokenizer, and for each id whether it ends a word; read once by each worker."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    vocabulary = tokenizer.get_vocab()
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tokenizer, ends_word


def letters_of_bytes() -> np.ndarray:
    """The letter by which the model knows each byte: printable ones are their own, the others follow from U+0100. Spaces stay."""
    own = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
    out = np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u4")
    out[32] = 32
    return out


class WordIds:
    """Ids of words between white space, asked of the tokenizer once and then looked up by 64-bit hash.

    The tokenizer drops white space, never joins characters across it and takes A-Z as a-z, so a text's ids are those of its words in
    turn. It also takes a run of letters and a run of punctuation each for itself, so punctuation that ends a word is a word of its
    own here. Each text's ids have ``end_id`` behind them.
    """

    def __init__(self, path: str, end_id: int) -> None:
        self.tokenizer, self.ends_word = tokenizer_of(path)
        self.letters = letters_of_bytes()
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of each word, by hash
        #: Word i has ids[cuts[i]:cuts[i + 1]]; word 0 is the end. again: whether it came in a second batch.
        self.count, self.again = 1, np.zeros(1 << 16, bool)
        self.cuts, self.ids = np.zeros(1 << 16, np.int32), np.full(1 << 18, end_id, np.int32)
        self.cuts[1] = 1

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, words: pa.StringArray) -> np.ndarray:
        """A list of ids for each word. Plain letters go to the model itself, other runs of letters to the tokenizer in one call for many."""
        data, plain = words.cast(pa.binary()).to_numpy(zero_copy_only=False), pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        out, tokenize = np.empty(len(data), object), self.tokenizer.model.tokenize
        names = self.letters[np.frombuffer(b" ".join(data[plain]), np.uint8)].tobytes().decode("utf-32-le").split(" ")
        for i, w in zip(np.flatnonzero(plain).tolist(), names):
            out[i] = [t.id for t in tokenize(w)]
        others = {i: data[i].decode("utf-8", "replace") for i in np.flatnonzero(~plain).tolist()}
        runs, rest = [i for i, w in others.items() if w.isalpha()], [i for i, w in others.items() if not w.isalpha()]
        for at in range(0, len(runs), 1000):
            some = runs[at : at + 1000]
            ids = self.whole([" ".join(others[i] for i in some)])[0]
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(some):
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = ids[a:b]
            else:  # a letter that is more than a letter in lower case
                rest += some
        for i, ids in zip(rest, self.whole([others[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def learn(self, words: pa.StringArray) -> None:
        """Remember new words under the next numbers."""
        found = self.ask(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        first, used = self.count, int(self.cuts[self.count])
        self.count, total = first + len(found), used + int(size.sum())
        if self.count >= len(self.cuts):
            self.cuts, self.again = (np.concatenate([x[: first + 1], np.zeros(self.count, x.dtype)]) for x in (self.cuts, self.again))
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(total, np.int32)])
        self.cuts[first + 1 : self.count + 1] = used + np.cumsum(size)
        self.ids[used:total] = np.fromiter(chain.from_iterable(found), np.int32, total - used)
        self.again[first : self.count] = False

    def lists(self) -> pa.ListArray:
        """The ids of each number."""
        return pa.ListArray.from_arrays(pa.array(self.cuts[: self.count + 1]), pa.array(self.ids[: self.cuts[self.count]]))

    def forget(self) -> None:
        """Keep the words that came again since the last time, or none if these are many too."""
        kept = np.flatnonzero(self.again[: self.count])
        kept = np.append(0, kept if len(kept) <= KNOWN_WORDS // 2 else kept[:0])
        ids, renumbered = self.lists().take(pa.array(kept)), np.zeros(self.count, np.int32)
        renumbered[kept] = np.arange(len(kept))
        number = renumbered[self.number]
        self.hash, self.number = self.hash[number > 0], number[number > 0]
        self.count = len(kept)
        self.cuts[: self.count + 1] = ids.offsets.to_numpy()
        self.ids[: len(ids.values)] = ids.values.to_numpy()
        self.again[: self.count] = False

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ascending hashes, and which of them are there."""
        at = np.searchsorted(self.hash, hashes)
        return at, self.hash[np.minimum(at, len(self.hash) - 1)] == hashes if len(self.hash) else np.zeros(len(hashes), bool)

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """The numbers of different words; those that are new are asked for."""
        _, cuts, data = words.buffers()
        cuts = np.frombuffer(cuts, np.int32)[: len(words) + 1].astype(np.int64)
        hashes = hashes_at(np.frombuffer(data if cuts[-1] else b"", np.uint8)[: cuts[-1]], cuts[:-1], cuts[1:])
        order = np.argsort(hashes)
        hashes = hashes[order]
        at, found = self.find(hashes)
        if len(self.hash) + np.count_nonzero(~found) > KNOWN_WORDS:
            self.forget()
            at, found = self.find(hashes)
        number = np.empty(len(words), np.int32)
        number[found] = self.number[at[found]]
        number[~found] = np.arange(np.count_nonzero(~found)) + self.count
        self.again[number[found]] = True
        self.learn(words.take(pa.array(order[~found])))
        self.hash, self.number = (np.insert(x, at[~found], new[~found]) for x, new in ((self.hash, hashes), (self.number, number)))
        out = np.empty_like(number)
        out[order] = number
        return out

    def of_all(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text and the end; a null text is empty."""
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.string()).fill_null("")), STOPS, APART))
        words, ends = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()[1:]
        number = self.numbers(words.dictionary)[words.indices.to_numpy()]
        ids = self.lists().take(pa.array(np.insert(number, ends, 0)))
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.append(0, ends + np.arange(len(ends)) + 1))), ids.values)


@cache
def known_words(tokenizer: str, end_id: int) -> WordIds:
    """What a worker knows of words' ids; its tasks share it."""
    return WordIds(tokenizer, end_id)


class Recipe(NamedTuple):
    """``repeats`` sequences, each of ``copies`` pieces for each of these lengths, one after another."""

    parts: tuple[tuple[int, int], ...]  # (length, copies)
    repeats: int


def patterns(bins: int, most: int = 3) -> np.ndarray:
    """Rows: how many lengths of each bin stand in a pattern of at most ``most`` documents that fills a sequence."""
    rows = []
    for k in range(1, most):
        for head in combinations_with_replacement(range(1, bins + 1), k):
            last = bins - sum(head)
            if last >= head[-1]:
                rows.append((*head, last))
    rows.append((bins,))
    out = np.zeros((len(rows), bins))
    for i, row in enumerate(rows):
        for b in row:
            out[i, b - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative x with the least |a x - b|, by accelerated projected gradients."""
    gram, target = a.T @ a, a.T @ b
    step = 1.0 / max(float(np.linalg.eigvalsh(a @ a.T)[-1]), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max(initial=0.0) < 1e-7 * (1 + new.max(initial=0.0)):
            return new
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, bins: int = 64) -> list[Recipe]:
    """Recipes that use every piece once. counts[i]: pieces of length i; the last index is the capacity.

    Lengths are rounded up to bins, repeat counts of the patterns are fitted to the binned histogram and rounded down, and each
    pattern is filled with lengths of its bins, the last one the longest that still fits. What is left over is packed longest
    first, each time with the longest that fits. Each step uses up a length or a pattern, so the work depends on the number of
    lengths and patterns and not on that of the documents.
    """
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    width = -(-capacity // bins)
    out: list[Recipe] = []

    def longest(low: int, high: int) -> int:
        """The greatest length in (low, high] of which pieces are left, or 0."""
        at = np.flatnonzero(left[low + 1 : high + 1])
        return int(at[-1]) + low + 1 if at.size else 0

    def use(parts: dict[int, int], repeats: int) -> None:
        for length, copies in parts.items():
            left[length] -= copies * repeats
        out.append(Recipe(tuple(parts.items()), repeats))

    def fill(parts: dict[int, int], room: int) -> None:
        """Add the longest lengths that fit until none does."""
        while room > 0 and (length := longest(0, room)):
            free = int(left[length]) - parts.get(length, 0)
            if free <= 0:
                below = [x for x in np.flatnonzero(left[: length]) if x and left[x] > parts.get(int(x), 0)]
                if not below:
                    return
                length = int(below[-1])
                free = int(left[length]) - parts.get(length, 0)
            n = min(free, room // length)
            parts[length] = parts.get(length, 0) + n
            room -= n * length

    def repeats_of(parts: dict[int, int]) -> int:
        return min(int(left[length]) // copies for length, copies in parts.items())

    binned = np.zeros(bins)
    np.add.at(binned, np.minimum((np.arange(1, capacity + 1) - 1) // width, bins - 1), left[1:])
    table = patterns(bins)
    fitted = np.floor(nnls(table.T, binned) + 1e-6).astype(np.int64)
    for row, repeats in sorted(zip(table, fitted, strict=True), key=lambda x: (-int(np.flatnonzero(x[0])[-1]), -int(x[1]))):
        todo = int(repeats)
        wanted = [b for b in np.flatnonzero(row)[::-1] for _ in range(int(row[b]))]
        while todo > 0:
            parts: dict[int, int] = {}
            room = capacity
            for b in wanted[:-1]:
                low, high = int(b) * width, min((int(b) + 1) * width, capacity)
                length = next((x for x in range(min(high, room), low, -1) if left[x] > parts.get(x, 0)), 0)
                if not length:
                    break
                parts[length] = parts.get(length, 0) + 1
                room -= length
            else:
                fill(parts, room)
                n = min(todo, repeats_of(parts)) if parts else 0
                if n:
                    use(parts, n)
                    todo -= n
                    continue
            break
    while length := longest(0, capacity):
        parts = {length: 1}
        fill(parts, capacity - length)
        use(parts, repeats_of(parts))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, bins: int = 64) -> DataFrame:
    """Tokenise all documents, cut those longer than ``capacity`` and put the pieces into as few sequences as it can.

    Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end
    id alone. Repeated rows are packed each for itself. The driver sees the histogram of lengths only, of ``capacity`` entries.
    Pieces of one length are numbered by input partition and place there, and a recipe takes a range of those numbers, so no
    sort or shuffle of the documents is needed. Other columns are ignored. No rows: no rows.
    """
    small_arrow_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part_ int, local_ long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part_", "local_"]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part = known_words(tokenizer_path, end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in text_batches(batches):
            rows: list[list] = [[] for _ in names]
            at: list[int] = []
            ids = known.of_all(batch.column(batch.schema.get_field_index("text")))
            data, cuts = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy().tolist()
            for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
                for piece, a in enumerate(range(start, end, capacity)):
                    cut = data[a : min(a + capacity, end)]
                    n = len(cut)
                    at.append(i)
                    for column, value in zip(rows[1:], (piece, a - start, n, zlib.crc32(cut), part, int(seen[n])), strict=True):
                        column.append(value)
                    seen[n] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(rows[1:], types, strict=True)]], names)

    pieces = materialise(docs.select(F.col("doc_id"), F.col("text")).mapInArrow(tokenise, schema), "pieces").df
    counts = pieces.groupBy("part_", "length").agg(F.count(F.lit(1)).alias("n_"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n_").alias("n_")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n_"]
    recipes = plan(histogram, bins)

    ranges: list[tuple[int, int, int, int, int]] = []  # length, first number, copies, first sequence, offset
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for recipe in recipes:
        offset = 0
        for length, copies in recipe.parts:
            ranges.append((length, int(taken[length]), copies, sequence, offset))
            taken[length] += copies * recipe.repeats
            offset += length * copies
        sequence += recipe.repeats
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    width = max(int(histogram.max()).bit_length(), 1)
    keys = (table[:, 0] << width) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("length", "number_"))
            row = table[np.searchsorted(keys, (length << width) + number, side="right") - 1]
            turn, slot = np.divmod(number - row[:, 1], row[:, 2])
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 3] + turn), pa.array(row[:, 4] + slot * length)], [*names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("part_").alias("p_"), F.col("length").alias("l_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("off_"))
    rows = pieces.join(offsets, (F.col("part_") == F.col("p_")) & (F.col("length") == F.col("l_"))).withColumn("number_", (F.col("off_") + F.col("local_")).cast("long"))
    out = schema.split(", piece")[0] + ", piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.select(*names[:5], "number_").mapInArrow(place, out)
