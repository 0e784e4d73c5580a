"""Language-model scores from an n-gram trie in Elias-Fano form, counted and built in shards and memory-mapped where it is asked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import only, small_arrow_batches
from fieldmark.llm.shards import BLOB, U64, Sums, blobs, by_shard, load, most_open, new_folder, power_of_two, save, spread
from fieldmark.llm.words import grouped, words_of

#: The token that ends a text, and stands before its first word.
END = U64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75
#: Tokens for which one shard of a level is made, and n-grams that a task counts before it hands them on.
SHARD_TOKENS, HELD = 2_000_000, 4_000_000


def token_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token hashes, the row of each token): words and one end for each text, in runs of about GROUP bytes of text."""
    for batch, texts in grouped(batches):
        words = words_of(texts)
        last = np.cumsum(np.bincount(words.row, minlength=len(texts)))  # each row's end goes behind its words
        yield batch, np.insert(words.hash, last, END), np.insert(words.row, last, np.arange(len(texts)))


# --- Elias-Fano -------------------------------------------------------------------------------------------------------------

#: Ranges of so many values are read in order instead of searched.
SHORT = 4
ALL, BYTES = ~U64(0), U64(0x0101010101010101)
_IN_BYTE = np.array([[[i for i in range(8) if b >> i & 1][r] if bin(b).count("1") > r else 8 for r in range(8)] for b in range(256)], np.int64)

class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with the ones and zeros before each word of these. All queries take arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str) -> None:
        self.low, self.high, self.ones, self.zeros, meta = (arrays[prefix + k] for k in ("low", "high", "ones", "zeros", "meta"))
        self.n, self.bits, self.buckets = map(int, meta)
        # the low bits as words that begin at every byte, so that values of up to 57 bits are read at once
        self.at_byte = np.ndarray((max(self.low.nbytes - 7, 0),), "<u8", self.low, strides=(1,))

    @staticmethod
    def build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        n = len(values)
        values = values.astype(U64)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & U64((1 << bits) - 1)
        packed = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            at = np.arange(n, dtype=U64) * U64(bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            packed[word[first]] = np.bitwise_or.reduceat(low << shift, first) if n else 0
            over = np.flatnonzero(shift + U64(bits) > 64)  # one value at most runs over the end of each word
            packed[word[over] + 1] |= low[over] >> (U64(64) - shift[over])
        places = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        flags = np.zeros(-(-size // 64) * 64 + 64, bool)
        flags[places] = True
        high = np.packbits(flags, bitorder="little").view(U64)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.uint32) - np.bitwise_count(high)
        zeros = (np.arange(len(high)) * 64 - ones).astype(np.uint32)
        return {f"{prefix}low": packed, f"{prefix}high": high, f"{prefix}ones": ones.astype(np.uint32), f"{prefix}zeros": zeros, f"{prefix}meta": np.array([n, bits, (top >> bits) + 1], np.int64)}

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the rank-th one (or zero) in the high bits; ``before`` has how many stand before each word."""
        word = np.searchsorted(before, rank.astype(np.uint32), side="right") - 1
        left = (rank - before[word]).astype(U64)
        x = ~self.high[word] if flip else self.high[word]
        # ones of each byte and of those before it, then the first byte with more than are left
        sums = x - ((x >> U64(1)) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * BYTES
        at = ((((left * BYTES) | U64(0x8080808080808080)) - sums) & U64(0x8080808080808080)) >> U64(7)
        at = (at * BYTES) >> U64(56) << U64(3)
        left -= (sums << U64(8)) >> at & U64(255)
        return (word << 6) + at.astype(np.int64) + _IN_BYTE[((x >> at) & U64(255)).astype(np.int64), left.astype(np.int64)]

    def _next(self, place: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the next one (or zero) of the high bits after each place; there must be one."""
        word, shift = place >> 6, (place & 63).astype(U64)
        x = (~self.high[word] if flip else self.high[word]) & (ALL << U64(1) << shift)
        todo = np.flatnonzero(x == 0)
        while len(todo):
            word[todo] += 1
            own = self.high[word[todo]]
            x[todo] = ~own if flip else own
            todo = todo[x[todo] == 0]
        return (word << 6) + np.bitwise_count((x & (~x + U64(1))) - U64(1))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        if self.bits <= 57:
            at = i * self.bits
            return (self.at_byte[at >> 3] >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)
        at = i.astype(U64) * U64(self.bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        x = self.low[word] >> shift
        over = shift + U64(self.bits) > 64
        x = x | np.where(over, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return x & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        return (self._select(i, self.ones, False) - i).astype(U64) << U64(self.bits) | self._low(i)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and at the places after them."""
        one = self._select(i, self.ones, False)
        return ((x - j).astype(U64) << U64(self.bits) | self._low(j) for x, j in ((one, i), (self._next(one, False), i + 1)))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it isn't in the sequence."""
        return self.find_in(values, np.zeros(len(values), np.int64), np.full(len(values), self.n, np.int64))

    def before(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the value before each place, 0 if there is none; where in the high bits the place itself is, if it is one)."""
        first = begin == 0
        if first.all():
            return np.zeros(len(begin), U64), self._select(np.zeros(len(begin), np.int64), self.ones, False)
        i = np.maximum(begin - 1, 0)
        one = self._select(i, self.ones, False)
        value = np.where(first, U64(0), (one - i).astype(U64) << U64(self.bits) | self._low(i))
        here = one.copy()
        on = np.flatnonzero(~first & (begin < self.n))
        here[on] = self._next(one[on], False)
        return value, here

    def find_in(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, here: np.ndarray | None = None) -> np.ndarray:
        """The place of each value from ``begin`` to before ``end``, where the sequence must rise; -1 where it isn't there.

        Short ranges are read in order (``here``: where in the high bits they begin, if that is known); in longer ones a search by
        halves goes over the values with the same high bits.
        """
        out = np.full(len(values), -1, np.int64)
        values = values.astype(U64)
        todo = np.flatnonzero((end > begin) & (end - begin <= SHORT))
        at = begin[todo]
        place = here[todo] if here is not None else self._select(at, self.ones, False) if len(todo) else at
        while len(todo):
            found = (place - at).astype(U64) << U64(self.bits) | self._low(at)
            hit = found == values[todo]
            out[todo[hit]] = at[hit]
            on = np.flatnonzero((found < values[todo]) & (at + 1 < end[todo]))
            todo, at = todo[on], at[on] + 1
            place = self._next(place[on], False) if len(on) else on
        high = (values >> U64(self.bits)).astype(np.int64)
        todo = np.flatnonzero((end - begin > SHORT) & (high < self.buckets))
        if not len(todo):
            return out
        high, want = high[todo], values[todo] & U64((1 << self.bits) - 1)
        start = np.full(len(todo), -1, np.int64)  # the zero before the bucket
        some = high > 0
        start[some] = self._select(high[some] - 1, self.zeros, True)
        stop = np.where(self.high[0] & U64(1) == 0, 0, self._next(np.zeros(1, np.int64), True)[0]) + np.zeros(len(todo), np.int64)
        stop[some] = self._next(start[some], True)
        low, top = np.maximum(start + 1 - high, begin[todo]), np.minimum(stop - high, end[todo])
        last = top.copy()
        at = np.flatnonzero(low < top)
        while len(at):
            middle = (low[at] + top[at]) >> 1
            less = self._low(middle) < want[at]
            low[at] = np.where(less, middle + 1, low[at])
            top[at] = np.where(less, top[at], middle)
            at = at[low[at] < top[at]]
        here = np.flatnonzero(low < last)
        here = here[self._low(low[here]) == want[here]]
        out[todo[here]] = low[here]
        return out


# --- the model --------------------------------------------------------------------------------------------------------------


class Shards:
    """The files of words or of a level, by number; ``index`` has for each its first key, the ids before it and how many it has."""

    def __init__(self, folder: str, name: str) -> None:
        self.folder, self.name, self.files, self.own, self.most = folder, name, {}, None, most_open(folder)

    def __reduce__(self):
        return Shards, (self.folder, self.name)

    def write_index(self, rows: list) -> None:
        """``rows``: (shard, first key, n) of the files."""
        rows = sorted(rows)
        n = np.array([r[2] for r in rows], np.int64)
        save(f"{self.folder}/{self.name}-index", shard=np.array([r[0] for r in rows], np.int64), first=np.array([r[1] for r in rows], np.int64), n=n, offset=np.cumsum(n) - n)

    @property
    def index(self) -> dict[str, np.ndarray]:
        if self.own is None:
            self.own = load(f"{self.folder}/{self.name}-index")
        return self.own

    def file(self, k: int) -> dict:
        """The k-th file, with its sequences opened."""
        if k not in self.files:
            if len(self.files) >= self.most:
                self.files.clear()
            f = load(f"{self.folder}/{self.name}-{int(self.index['shard'][k])}")
            self.files[k] = f | {x: EliasFano(f, f"{x}_") for x in ("hash", "count", "node", "pointer") if f"{x}_meta" in f}
        return self.files[k]

    def overlapping(self, first: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(k, from, to) of the files that have the ids from ``first`` on; places are those in the file."""
        at, size = self.index["offset"], self.index["n"]
        for k in range(int(np.searchsorted(at, first, side="right")) - 1, len(at)):
            if k >= 0 and at[k] < first + n and first < at[k] + size[k]:
                yield k, max(first - int(at[k]), 0), min(first + n - int(at[k]), int(size[k]))
            elif at[k] >= first + n:
                break

    def counts(self, first: int, n: int) -> np.ndarray:
        """The counts of ids in a row."""
        out = np.ones(n, np.int64)
        for k, a, b in self.overlapping(first, n):
            sums = self.file(k)["count"].access(np.arange(max(a - 1, 0), b)).astype(np.int64)
            at = int(self.index["offset"][k]) + a - first
            out[at : at + b - a] = np.diff(sums, prepend=0) if a == 0 else np.diff(sums)
        return out


class Vocabulary(Shards):
    """Hashes of all training words, by their top bits, and their counts; a word's id is its place."""

    def __init__(self, folder: str, shift: int) -> None:
        super().__init__(folder, "words")
        self.shift = shift

    def __reduce__(self):
        return Vocabulary, (self.folder, self.shift)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, id or -1) of sorted distinct hashes."""
        counts, ids = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        tops = (hashes >> U64(self.shift)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(tops)) + 1).tolist(), len(hashes)]
        shards = self.index["shard"]
        for a, b in zip(cuts, cuts[1:]):
            k = int(np.searchsorted(shards, tops[a])) if a < b else len(shards)
            if k == len(shards) or shards[k] != tops[a]:
                continue
            f = self.file(k)
            at = f["hash"].find(hashes[a:b] & U64((1 << self.shift) - 1))
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            before = np.where(at > 0, f["count"].access(np.maximum(at - 1, 0)).astype(np.int64), 0)
            counts[a + hit] = f["count"].access(at).astype(np.int64) - before
            ids[a + hit] = at + self.index["offset"][k]
        return counts, ids


class Level(Shards):
    """n-grams of one length. A context's successors stand between its pointer and the next one's; to keep a file's nodes monotone,
    words are stored plus the last node before the context, and looked for relative to it."""

    def find(self, context: np.ndarray, word: np.ndarray, scored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, log10 of its probability, log10 of the context's share for other words) of pairs; -1 is no context and no word.

        The logarithms are zero where they aren't asked for.
        """
        node, prob, rest = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word))
        which = np.where(context >= 0, np.searchsorted(self.index["first"], context, side="right") - 1, -1)
        for k in np.unique(which[which >= 0]).tolist():
            f = self.file(k)
            at = np.flatnonzero(which == k)
            own = context[at] - self.index["first"][k]
            at, own = at[own < len(f["rest"])], own[own < len(f["rest"])]
            if scored:
                rest[at] = f["rest_book"][f["rest"][own]]
            at, own = at[word[at] >= 0], own[word[at] >= 0]
            if len(own) and (own[1:] >= own[:-1]).all():  # in order already
                edge = np.diff(own, prepend=own[0] - 1) != 0
                asked, back = own[edge], np.cumsum(edge) - 1
            else:
                asked, back = np.unique(own, return_inverse=True)
            begin, end = (x.astype(np.int64) for x in f["pointer"].pairs(asked))
            if not f["node"].n or not len(asked):
                continue
            base, here = f["node"].before(begin)
            found = f["node"].find_in(base[back] + word[at].astype(U64), begin[back], end[back], here[back])
            hit = found >= 0
            node[at[hit]] = found[hit] + self.index["offset"][k]
            if scored:
                prob[at[hit]] = f["prob_book"][f["prob"][found[hit]]]
        return node, prob, rest

    def last_words(self, first: int, n: int) -> np.ndarray:
        """The last words of n-grams whose ids stand in a row."""
        out = np.zeros(n, np.int64)
        for k, a, b in self.overlapping(first, n):
            f = self.file(k)
            nodes, pointers = (f[x].access(np.arange(f[x].n)).astype(np.int64) for x in ("node", "pointer"))
            base = np.where(pointers[:-1] > 0, nodes[np.maximum(pointers[:-1] - 1, 0)], 0)
            at = int(self.index["offset"][k]) + a - first
            out[at : at + b - a] = (nodes - np.repeat(base, np.diff(pointers)))[a:b]
        return out


class Model:
    """Everything a worker asks; made of paths, files are mapped when first used."""

    def __init__(self, folder: str, shift: int, tokens: int, words: int, orders: int) -> None:
        self.parts = (folder, shift, tokens, words, orders)
        self.folder, self.tokens, self.words = folder, tokens, words
        self.vocabulary = Vocabulary(folder, shift)
        self.levels = [Level(folder, f"level{i}") for i in range(2, orders + 1)]
        self.floor = tokens + words + 1

    def __reduce__(self):
        return Model, self.parts

    def read(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back, unique = pd.factorize(hashes)
        order = np.argsort(unique)
        counts, ids = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        counts[order], ids[order] = self.vocabulary.look_up(unique[order])
        return counts[back], ids[back]

    def first(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / self.floor)

    def walk(self, row: np.ndarray, counts: np.ndarray, ids: np.ndarray, end_id: int, scored: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(the context before each token that a further level would have, -1 if none; log10 probability of each token, if asked for)."""
        start = np.diff(row, prepend=-1) != 0
        context = np.where(start, end_id, np.concatenate([[-1], ids[:-1]]))
        total = self.first(counts)
        for level in self.levels:
            if (int(context.max(initial=0)) + 2) * (self.words + 1) < 1 << 63:
                contexts, own = None, context + 1
            else:
                contexts, own = np.unique(context, return_inverse=True)
            pairs, back = np.unique(own * (self.words + 1) + ids + 1, return_inverse=True)
            c, w = np.divmod(pairs, self.words + 1)
            node, prob, rest = level.find(c - 1 if contexts is None else contexts[c], w - 1, scored)
            node = node[back]
            if scored:
                total = np.where(node >= 0, prob[back], total + rest[back])
            context = np.where(start, -1, np.concatenate([[-1], node[:-1]]))
        return context, total


def quantised(values: np.ndarray, levels: int | None = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): equal shares of the values, each by its mean; up to ``levels`` values are kept as they are, all if it is None."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    order = np.sort(values)
    book = order[np.flatnonzero(np.diff(order, prepend=-np.inf))]
    if levels is None or len(book) <= levels:
        return np.searchsorted(book, values).astype(np.uint8 if levels else np.uint32), book
    edges = order[np.linspace(0, len(order) - 1, levels + 1).astype(np.int64)][1:-1]
    codes = np.searchsorted(np.unique(edges), values, side="right")
    sums, n = np.bincount(codes, values, levels), np.bincount(codes, minlength=levels)
    return codes.astype(np.uint8), sums / np.maximum(n, 1)


FILE = "shard long, first long, n long, total long"


def _file_row(*values: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in values], ["shard", "first", "n", "total"])


def train(docs: DataFrame, order: int = 3, levels: int | None = 256) -> Model:
    """A model of all texts of ``docs``, with all their words and n-grams; the driver sees a row of numbers for each file.

    Words are counted by hash; then, level by level, the contexts of the level before are looked up for every token and the
    n-grams counted, first in each task and then by ranges of contexts, of which each has at most as many successors as there are
    words. An n-gram's probability is its discounted share of its context, plus the context's share for the rest times the
    probability that the level before gives; words that stand nowhere in training count as one more word. Two words are taken for
    one if their 64-bit hashes agree. ``levels``: values to which a file's probabilities are quantised, None for all of them.
    """
    folder = new_folder(docs.sparkSession, "ngrams")
    texts = docs.select(F.col("text"))
    bits = power_of_two(max(8, texts.rdd.getNumPartitions() // 2))
    shift = 64 - bits

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for _, hashes, _ in token_chunks(batches):
            sums.add(*np.unique(hashes, return_counts=True))
        if found := sums.result():
            yield from blobs((found[0] >> U64(shift)).astype(np.int64), found[0], found[1].astype(np.int64))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in by_shard(batches, (U64, np.int64)):
            sequences = EliasFano.build(keys & U64((1 << shift) - 1), "hash_") | EliasFano.build(np.cumsum(counts), "count_")
            save(f"{folder}/words-{shard}", **sequences)
            yield _file_row(shard, 0, len(keys), int(counts.sum()))

    rows = spread(texts.mapInArrow(count_words, BLOB), 1 << bits).mapInArrow(write_words, FILE).collect()
    Vocabulary(folder, shift).write_index([(r["shard"], r["first"], r["n"]) for r in rows])
    words = contexts = sum(r["n"] for r in rows)
    model = Model(folder, shift, sum(r["total"] for r in rows), words, 1)
    for level in range(2, order + 1):
        contexts = _add_level(texts, model, level, contexts, levels)
        model = Model(folder, shift, model.tokens, words, level)
    return model


def end_id(model: Model) -> int:
    return int(model.read(np.array([END], U64))[1][0])


def _add_level(texts: DataFrame, model: Model, level: int, contexts: int, levels: int | None) -> int:
    """Write the files of a level; the number of its n-grams."""
    words = model.words
    if contexts * words >= 1 << 64:
        raise OverflowError("a context and a word don't fit in 64 bits")
    span = max(1, contexts // (1 << power_of_two(model.tokens / SHARD_TOKENS)))  # contexts of a shard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, sums = end_id(model), Sums(HELD)

        def handed_on() -> Iterator[pa.RecordBatch]:
            if result := sums.result():
                key, n = result
                shard = (key // U64(words)).astype(np.int64) // span
                yield from blobs(shard, key - shard.astype(U64) * U64(span * words), n)

        for _, hashes, row in token_chunks(batches):
            counts, ids = model.read(hashes)
            context, _ = model.walk(row, counts, ids, end, scored=False)
            known = context >= 0
            sums.add(*np.unique(context[known].astype(U64) * U64(words) + ids[known].astype(U64), return_counts=True))
            if sums.size > HELD:
                yield from handed_on()
                sums = Sums(HELD)
        yield from handed_on()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (key, n) in by_shard(batches, (U64, np.int64)):
            first = shard * span
            size = min(span, contexts - first)
            own, word = (key // U64(words)).astype(np.int64), (key % U64(words)).astype(np.int64)
            total = (model.levels[-1] if level > 2 else model.vocabulary).counts(first, size)
            share = np.maximum(n - DISCOUNT, 0) / total[own]
            rest = np.clip(1 - np.bincount(own, share, size), 1e-9, 1)
            prob, prob_book = quantised(np.log10(share + rest[own] * 10.0 ** _lower(model, level, first, size, own, word)), levels)
            code, rest_book = quantised(np.log10(rest), levels)
            pointers = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=size))])
            last = np.flatnonzero(np.diff(own, append=-1))  # each context's last successor
            base = np.repeat(np.cumsum(word[last]) - word[last], np.diff(last, prepend=-1))
            sequences = EliasFano.build(base + word, "node_") | EliasFano.build(pointers, "pointer_")
            save(f"{model.folder}/level{level}-{shard}", prob=prob, prob_book=prob_book, rest=code, rest_book=rest_book, **sequences, **EliasFano.build(np.cumsum(n), "count_"))
            yield _file_row(shard, first, len(key), int(n.sum()))

    rows = spread(texts.mapInArrow(count, BLOB), -(-contexts // span) if contexts else 1).mapInArrow(build, FILE).collect()
    Level(model.folder, f"level{level}").write_index([(r["shard"], r["first"], r["n"]) for r in rows])
    return sum(r["n"] for r in rows)


def _lower(model: Model, level: int, first: int, size: int, own: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probability of each word after its context without the context's first word; contexts stand in a row."""
    unique, back = np.unique(word, return_inverse=True)
    total = model.first(_counts_of(model.vocabulary, unique))[back]
    if level == 3:
        context = model.levels[0].last_words(first, size)[own]
        order = np.argsort(context)  # neighbours in a file are asked for together
        node, prob, rest = model.levels[0].find(context[order], word[order])
        out = np.empty(len(word))
        out[order] = np.where(node >= 0, prob, total[order] + rest)
        return out
    return total


def _counts_of(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The counts of words by sorted ids."""
    out = np.ones(len(ids), np.int64)
    offset = vocabulary.index["offset"]
    which = np.searchsorted(offset, ids, side="right") - 1
    for k in np.unique(which).tolist():
        at = np.flatnonzero(which == k)
        own, f = ids[at] - offset[k], vocabulary.file(k)
        before = np.where(own > 0, f["count"].access(np.maximum(own - 1, 0)).astype(np.int64), 0)
        out[at] = f["count"].access(own).astype(np.int64) - before
    return out


def score_documents(docs: DataFrame, order: int = 3, folds: int = 7, held_fold: int = 2, levels: int | None = 256) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents whose crc32(doc_id as text) mod ``folds`` isn't ``held_fold``. A null text is an end alone; a
    null doc_id counts as the text "". Repeated rows count and are scored each for itself. Other columns are ignored. Without
    training documents every token is unknown and has probability one. No rows: no rows.
    """
    small_arrow_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    if order not in (1, 2, 3):
        raise ValueError("orders 1 to 3 are supported")
    ids = docs.schema["doc_id"].dataType.simpleString()
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds == held_fold
    rows = docs.select(F.col("doc_id"), held.alias("held_out"), F.col("text"))
    model = train(rows.filter(~F.col("held_out")).select("text"), order, levels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id(model)
        for batch, hashes, row in token_chunks(batches):
            counts, word_ids = model.read(hashes)
            _, logs = model.walk(row, counts, word_ids, end)
            n = batch.num_rows
            sums = [np.bincount(row, x, n) for x in (model.first(counts), logs)]
            whole = [np.bincount(row, minlength=n), np.bincount(row, counts > 0, n).astype(np.int64), np.full(n, model.tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.astype(np.int64)) for x in whole], *[pa.array(x) for x in sums]], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(score, f"doc_id {ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
