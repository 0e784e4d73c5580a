"""Removal of long repeated strings: Burrows-Wheeler interval expansion, bounded by the length, over the texts around anchors.

A symbol is a byte or a word, a window a string of ``length`` symbols. A window is filed under its anchor, the few symbols in it with
the least hash, so equal windows have the same anchor at the same place. Neighbouring windows of one anchor and one block of offsets
share a core of ``length - block + 1`` symbols; such a run with its context, the symbols from its first window's start to its last
window's end, is the unit of work:

1. cores are counted by hash, a filter: a core that stands once has no repeated window.
2. the contexts of cores that stand twice or more meet by core; one that stands twice itself enters once, with weight two. As all of
   a core's contexts share it, it becomes one symbol there, and a window is ``block`` symbols. Suffixes are sorted, and the expansion
   of the transform's intervals finds the windows that stand twice. Cores all of whose contexts stand twice need neither.
3. each text looks up the windows of its runs in what 2 has found, and loses the symbols that are covered.

Texts are written once with the number of their part and read three times; only hashes and contexts of repeated cores are shuffled.
What a part has to look up is shuffled to it and kept in one file, so a task opens the files of its own parts and no others; a file
that is missing is an error. In step 2 cores are told apart by 128 bits, in step 3 contexts and windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only, small_arrow_batches, utf8_column
from fieldmark.llm.shards import DOWN, TILE, U64, filed, load, mix, new_folder, running_sums, save
from fieldmark.llm.words import Words, words_of

#: Bits of an anchor's hash that decide; the others hold its place, so the first of equals wins.
PLACE_BITS = 24
#: Bytes of text that are worked on at a time; places must fit in PLACE_BITS.
CHUNK = 2 << 20
#: Contexts that are sorted together. Windows of cores with over CROWD distinct contexts are counted one by one instead, by 128 bits,
#: for the contexts of one core can't be dealt to several tasks; the windows found are the same.
SHARD_CONTEXTS, CROWD = 800, 10_000
_BYTE = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)


class Windows(NamedTuple):
    """Strings of ``length`` bytes, or of ``length`` words between ASCII white space, A-Z in lower case."""

    length: int
    words: bool = False

    @property
    def anchor(self) -> int:
        return min(4 if self.words else 32, self.length)

    @property
    def block(self) -> int:
        """Offsets of a block: a part of those that an anchor can have in a window."""
        return -(-(self.length - self.anchor + 1) // (2 if self.words else 4))

    @property
    def core(self) -> int:
        return self.length - self.block + 1


# --- suffixes ---------------------------------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in the order of their first ``depth`` symbols or more, by doubling."""
    n = len(codes)
    one = rank = codes.astype(np.int64)
    known, width = 1, max(int(rank.max(initial=0)).bit_length(), 1)
    while known < depth and width * (known + 1) <= 63:  # pack symbols while they fit
        rank = rank << width
        rank[: max(n - known, 0)] |= one[known:]
        known += 1
    order = np.argsort(rank)
    while True:
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(rank[order[1:]] != rank[order[:-1]])
        rank = new
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - known] += rank[known:] + 1
        order = np.argsort(key)
        rank = key
        known *= 2


def repeated_places(codes: np.ndarray, length: int) -> np.ndarray:
    """For each place whether the ``length`` symbols from there also stand at another place; symbol 0 ends strings.

    Places within ``length`` of an end may be marked though they have no such string. Breadth first by the length of a string w, all
    its suffix intervals are extended backwards by each symbol c that the transform shows before them; where the interval of cw
    ends at a border that has no common-prefix length yet, the border's is that of w, and cw is extended in its turn. Borders left
    after ``length`` rounds have common prefixes of ``length`` or more.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, bool)
    order = suffix_order(codes, length)
    before = codes[order - 1]  # the transform
    by = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int64)  # where the suffix with the symbol before it stands
    forward[by] = np.arange(n)
    same = before[by[1:]] == before[by[:-1]]
    earlier, later = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    earlier[by[1:][same]] = by[:-1][same]
    later[by[:-1][same]] = by[1:][same]
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for depth in range(length):
        size = high - low + 1
        own = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + low[own]
        if depth:
            inner = before[at] != 0
            at, own = at[inner], own[inner]
        first, last = earlier[at] < low[own], later[at] > high[own]
        key = own * n + forward[at]
        low, high = np.sort(key[first]) % n, np.sort(key[last]) % n
        new = open_[high + 1]
        low, high = low[new], high[new]
        open_[high + 1] = False
        if not len(low):
            break
    out = np.zeros(n, bool)
    left = np.flatnonzero(open_)
    out[order[left]] = out[order[left - 1]] = True
    return out


# --- runs -------------------------------------------------------------------------------------------------------------------


class Runs(NamedTuple):
    """Windows that start from ``first`` to ``last``, their core's start, and the hashes of core and context."""

    first: np.ndarray
    last: np.ndarray
    core_at: np.ndarray
    core: np.ndarray
    context: np.ndarray


class Text(NamedTuple):
    """Symbols (bytes, or hashes of words) and running sums for hashes of strings of them."""

    data: np.ndarray
    sums: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * DOWN.upto(len(self.data) + 1)[start] + (end - start).astype(U64))

    def strings(self, start: np.ndarray, end: np.ndarray) -> list[memoryview]:
        """The bytes of these strings, in place."""
        raw, k = memoryview(self.data.view(np.uint8)), self.data.itemsize
        return [raw[a:b] for a, b in zip((start * k).tolist(), (end * k).tolist(), strict=True)]

    def digests(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        return [xxhash.xxh3_128_digest(x) for x in self.strings(start, end)]


def read_text(data: np.ndarray) -> Text:
    return Text(data, running_sums(data, None if data.dtype == U64 else _BYTE))


def anchors_of(text: Text, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor): the starts of windows whose anchor is another one than that of the window before, and these anchors."""
    n, width, span = len(text.data) - w.length + 1, w.anchor, w.length - w.anchor + 1
    down, low = DOWN.upto(len(text.data)), U64((1 << PLACE_BITS) - 1)
    starts, anchors, before = [], [], np.zeros(0, U64)
    for a in range(0, n, TILE):
        b = min(a + TILE, n) + span - 1
        h = mix((text.sums[a + width : b + width] - text.sums[a:b]) * down[a:b])
        least, k = (h & ~low) | np.arange(a, b, dtype=U64), 1
        while 2 * k <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if span > k:
            least = np.minimum(least[: k - span], least[span - k :])
        new = np.flatnonzero(np.diff(least, prepend=before if a else ~least[:1]))
        starts.append(new + a)
        anchors.append(least[new] & low)
        before = least[-1:]
    return np.concatenate(starts), np.concatenate(anchors).astype(np.int64)


def runs_of(text: Text, ends: np.ndarray, w: Windows) -> Runs:
    """The runs of all windows that lie within one document; documents stand end to end."""
    n, length, block = len(text.data), w.length, w.block
    ends = np.asarray(ends, np.int64)
    begins = np.append(np.zeros(1, np.int64), ends[:-1])[: len(ends)]
    holds = ends - begins >= length
    begins, ends = begins[holds], ends[holds]
    if not len(ends):
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty, empty.astype(U64), empty.astype(U64))
    at, anchors = anchors_of(text, w)
    # stretches of starts with one anchor in one document
    first = np.unique(np.concatenate([at, begins, ends - length + 1]))
    first, last = first[first <= n - length], np.append(first[1:], n - length + 1)[: np.count_nonzero(first <= n - length)] - 1
    document = np.searchsorted(begins, first, side="right") - 1
    inside = (document >= 0) & (first <= ends[document] - length)
    first, last = first[inside], last[inside]
    anchor = anchors[np.searchsorted(at, first, side="right") - 1]
    # and with one block of offsets
    own, part = _expand(-((anchor - first) // block), -((anchor - last) // block))
    part = -part
    core_at = anchor[own] - block * part
    first, last = np.maximum(first[own], core_at - block + 1), np.minimum(last[own], core_at)
    core = mix(text.hashes(core_at, core_at + w.core) + part.astype(U64))
    context = mix(text.hashes(first, last + length) + core + (core_at - first).astype(U64) * U64(1_000_003))
    return Runs(first, last, core_at, core, context)


class Piece(NamedTuple):
    """Documents end to end, where they end, and the piece's place among the symbols of its texts."""

    text: Text
    ends: np.ndarray
    at: int


def pieces_of(texts: list[bytes], w: Windows, words: Words | None = None) -> list[Piece]:
    """A long document is cut into pieces that overlap by ``length - 1``, so that each window lies in one piece. ``words``: the texts', if known."""
    if w.words:
        words = words or words_of(texts)
        data, ends = words.hash, np.cumsum(np.bincount(words.row, minlength=len(texts)))
    else:
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    if len(data) <= CHUNK + w.length:
        return [Piece(read_text(data), ends, 0)]
    cuts = [(data[a : a + CHUNK + w.length - 1], a) for a in range(0, len(data) - w.length + 1, CHUNK)]
    return [Piece(read_text(x), np.array([len(x)]), a) for x, a in cuts]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(part, rows, their texts) in runs of one part and of about CHUNK bytes; a longer text is a run of its own."""
    for batch in batches:
        texts, parts = utf8_column(batch, "text"), batch.column(batch.schema.get_field_index("part_")).to_pylist()
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and parts[upto] == parts[at] and (upto == at or size + len(texts[upto]) <= CHUNK):
                size += len(texts[upto])
                upto += 1
            yield parts[at], batch.slice(at, upto - at), texts[at:upto]
            at = upto


# --- what is known of cores, contexts and windows -----------------------------------------------------------------------------


def place_in(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash, -1 if it isn't there."""
    if not len(sorted_):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, -1)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of all values in the ranges."""
    size = last - first + 1
    own = np.repeat(np.arange(len(first)), size)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]


def solve(contexts: list[tuple[int, int, np.ndarray, bool]], core: list, block: int) -> list[np.ndarray]:
    """For each context (symbols before the core, symbols after it, these symbols, whether it stands twice) and its core: which of its windows repeat."""
    if not contexts:
        return []
    names: dict = {}
    group = [names.setdefault(c, len(names)) for c in core]
    if contexts[0][2].dtype == np.uint8:
        symbols, width = np.concatenate([x[2] for x in contexts]).astype(np.int64), 256
    else:
        values, symbols = np.unique(np.concatenate([x[2] for x in contexts]), return_inverse=True)
        width = len(values)
    parts, starts, at, taken = [], [], 0, 0
    for (left, right, _, _), g in zip(contexts, group, strict=True):
        codes = symbols[taken : taken + left + right] + 1
        taken += left + right
        parts += [codes[:left], np.array([width + 1 + g]), codes[left:], np.zeros(1, np.int64)]
        starts.append(at)
        at += left + right + 2
    marks = repeated_places(np.concatenate(parts), block)
    marks = [marks[s : s + left + right + 2 - block] for s, (left, right, _, _) in zip(starts, contexts, strict=True)]
    return [np.ones(len(m), bool) if x[3] else m for m, x in zip(marks, contexts, strict=True)]


def _ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


PIECES = "part_ int, core long, core2 long, hi long, lo long, n long, left int, right int, data binary"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]
MARKS = "part_ int, kind int, hi long, lo long, first binary, last binary"


class Found:
    """Where the windows of a part's texts that stand twice are looked up: one file of cores and one of marks for each part."""

    def __init__(self, windows: Windows, folder: str, crowds: bool = False) -> None:
        self.windows, self.folder, self.crowds, self.part, self.files = windows, folder, crowds, None, ()

    def __reduce__(self):
        return Found, (self.windows, self.folder, self.crowds)

    def of(self, part: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(repeated cores, those that are crowded, marks)."""
        if part != self.part:
            cores, crowd = (load(f"{self.folder}/{x}-{part}")["core"] if x == "cores" or self.crowds else np.zeros(0, np.int64) for x in ("cores", "crowd"))
            self.part, self.files = part, (cores, crowd, load(f"{self.folder}/marks-{part}"))
        return self.files

    def ranges(self, part: int, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of starts of windows that stand twice."""
        cores, crowd, marks = self.of(part)
        text, length = piece.text, self.windows.length
        runs = runs_of(text, piece.ends, self.windows)
        core = runs.core.view(np.int64)
        crowded = place_in(crowd, core) >= 0
        few, many = np.flatnonzero((place_in(cores, core) >= 0) & ~crowded), np.flatnonzero(crowded)
        first, last = [], []
        if len(few):
            hit = self._look_up(marks, "context", text.digests(runs.first[few], runs.last[few] + length))
            few, hit = few[hit >= 0], hit[hit >= 0]
            own, k = _expand(marks["begin"][hit], marks["begin"][hit + 1] - 1)
            first.append(runs.first[few[own]] + marks["first"][k])
            last.append(runs.first[few[own]] + marks["last"][k])
        if len(many):
            _, start = _expand(runs.first[many], runs.last[many])
            start = start[self._look_up(marks, "window", text.digests(start, start + length)) >= 0]
            first.append(start)
            last.append(start)
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(first or empty), np.concatenate(last or empty)

    @staticmethod
    def _look_up(marks: dict[str, np.ndarray], name: str, digests: list[bytes]) -> np.ndarray:
        hi, lo = _longs(digests)
        at = place_in(marks[f"{name}_hi"], hi)
        seen = at >= 0
        seen[seen] = marks[f"{name}_lo"][at[seen]] == lo[seen]
        return np.where(seen, at, -1)


def find_repeats(texts: DataFrame, windows: Windows) -> Found:
    """Steps 1 and 2 for a written table of text and part_."""
    folder = new_folder(texts.sparkSession, "repeats")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, own in groups_of(batches):
            for piece in pieces_of(own, windows):
                core, n = np.unique(runs_of(piece.text, piece.ends, windows).core, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(core), part, np.int32)), pa.array(core.view(np.int64)), pa.array(n.astype(np.int64))], ["part_", "core", "n"])

    # a core has one row for each CHUNK of text at most
    seen = texts.select("part_", "text").mapInArrow(count, "part_ int, core long, n long")
    twice = seen.withColumn("n_", F.sum("n").over(Window.partitionBy("core"))).filter("n_ > 1").select("part_", "core")

    def write_cores(name: str):
        return lambda part, table: save(f"{folder}/{name}-{part}", core=np.unique(table["core"].drop_null().to_numpy()))

    filed(twice, texts, ["core"], write_cores("cores"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, own in groups_of(batches):
            known = load(f"{folder}/cores-{part}")["core"]
            for text, ends, _ in pieces_of(own, windows):
                runs = runs_of(text, ends, windows)
                few = np.flatnonzero(place_in(known, runs.core.view(np.int64)) >= 0)
                _, one, n = np.unique(runs.context[few], return_index=True, return_counts=True)
                if len(few):
                    few = few[one]
                    first, at, end = runs.first[few], runs.core_at[few], runs.last[few] + windows.length
                    upto = at + windows.core
                    core2 = np.array([xxhash.xxh3_64_intdigest(x) for x in text.strings(at, upto)], U64)
                    hi, lo = _longs(text.digests(first, end))
                    data = [b"".join(x) for x in zip(text.strings(first, at), text.strings(upto, end), strict=True)]
                    longs = (runs.core[few].view(np.int64), core2.view(np.int64), hi, lo, n.astype(np.int64))
                    arrays = [pa.array(np.full(len(few), part, np.int32)), *map(pa.array, longs), *[pa.array(x.astype(np.int32)) for x in (at - first, end - upto)], pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, PIECE_NAMES)

    pieces = materialise(texts.select("part_", "text").mapInArrow(gather, PIECES), "contexts").df

    # cores with so many rows are few: only for them contexts are told apart, which are dealt by context first
    large = materialise(pieces.groupBy(F.col("core").alias("core_")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("core_"), "large").df
    crowds = large.limit(1).count() > 0
    single = None
    if crowds:
        kinds = pieces.select("core", "core2", "hi", "lo").join(large, F.col("core") == F.col("core_"), "left_semi").distinct()
        crowded = kinds.groupBy(F.col("core").alias("core_")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("core_")
        crowded = materialise(crowded, "crowded").df
        filed(pieces.select("part_", "core").join(crowded, F.col("core") == F.col("core_"), "left_semi"), texts, ["core"], write_cores("crowd"))
        pieces = pieces.join(crowded, F.col("core") == F.col("core_"), "left_anti")

        def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, own in groups_of(batches):
                known = load(f"{folder}/crowd-{part}")["core"]
                for text, ends, _ in pieces_of(own, windows):
                    runs = runs_of(text, ends, windows)
                    crowd = place_in(known, runs.core.view(np.int64)) >= 0
                    if crowd.any():
                        _, start = _expand(runs.first[crowd], runs.last[crowd])
                        _, one, n = np.unique(text.hashes(start, start + windows.length), return_index=True, return_counts=True)
                        hi, lo = _longs(text.digests(start[one], start[one] + windows.length))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), part, np.int32)), pa.array(hi), pa.array(lo), pa.array(n.astype(np.int64))], ["part_", "hi", "lo", "n"])

        each = materialise(texts.select("part_", "text").mapInArrow(each_window, "part_ int, hi long, lo long, n long"), "windows").df
        often = each.groupBy(F.col("hi").alias("hi_"), F.col("lo").alias("lo_")).agg(F.sum("n").alias("n_")).filter("n_ > 1")
        single = each.join(often, (F.col("hi") == F.col("hi_")) & (F.col("lo") == F.col("lo_"))).select("part_", "hi", "lo").distinct()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = U64 if windows.words else np.uint8
        # (core, core2, hi, lo): [left, right, symbols, n, parts] for the core at hand, and for those whose suffixes are sorted together
        own: dict[tuple, list] = {}
        held: dict[tuple, list] = {}
        known: list[tuple] = []  # (hi, lo, parts, windows) of contexts that need no sorting
        core = None

        def settle() -> None:
            if all(x[3] > 1 for x in own.values()):
                known.extend((hi, lo, x[4], x[0] + x[1] + 2 - windows.block) for (_, _, hi, lo), x in own.items())
            else:
                held.update(own)
            own.clear()

        for batch in batches:
            part, *longs = (batch.column(i).to_numpy() for i in range(8))
            new = np.ones(batch.num_rows, bool)  # the first row of a context
            new[1:] = np.any([x[1:] != x[:-1] for x in longs[:4]], axis=0)
            new = np.flatnonzero(new)
            upto = np.append(new[1:], batch.num_rows)
            firsts = [x[new].tolist() for x in (*longs[:4], *longs[5:])]
            for a, b, n, *key, left, right, data in zip(new.tolist(), upto.tolist(), np.add.reduceat(longs[4], new).tolist() if len(new) else [], *firsts, batch.column(8).take(pa.array(new)).to_pylist(), strict=True):
                if key[:2] != core:
                    settle()
                    core = key[:2]
                    if len(held) >= SHARD_CONTEXTS or len(known) >= CROWD:
                        yield finish(held, known)
                        held.clear()
                        known.clear()
                seen = own.setdefault(tuple(key), [left, right, np.frombuffer(data, kind), 0, set()])
                seen[3] += n
                seen[4].update(part[a:b].tolist())
        settle()
        if held or known:
            yield finish(held, known)

    def finish(held: dict[tuple, list], known: list[tuple]) -> pa.RecordBatch:
        marks = solve([(x[0], x[1], x[2], x[3] > 1) for x in held.values()], [k[:2] for k in held], windows.block)
        zero, out = np.zeros(1, np.int32).tobytes(), [[] for _ in range(5)]
        found = [(hi, lo, parts, zero, np.int32(n - 1).tobytes()) for hi, lo, parts, n in known]
        for (_, _, hi, lo), (_, _, _, _, parts), own in zip(held, held.values(), marks, strict=True):
            if own.any():
                found.append((hi, lo, parts, *(x.astype(np.int32).tobytes() for x in _ranges(own))))
        for hi, lo, parts, first, last in found:
            for part in parts:
                for column, value in zip(out, (part, hi, lo, first, last), strict=True):
                    column.append(value)
        arrays = [pa.array(out[0], pa.int32()), pa.array([1] * len(out[0]), pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["part_", "kind", "hi", "lo", "first", "last"])

    dealt = pieces.select(*PIECE_NAMES).repartition("core", "core2").sortWithinPartitions("core", "core2", "hi", "lo")
    marks = dealt.mapInArrow(expand, MARKS)
    if single is not None:
        empty = F.lit(None).cast("binary")
        marks = marks.unionByName(single.select("part_", F.lit(2).alias("kind"), "hi", "lo", empty.alias("first"), empty.alias("last")))

    def write_marks(part: int, table: pa.Table) -> None:
        kind = table["kind"].fill_null(0).to_numpy()
        context, window = table.filter(kind == 1), table.filter(kind == 2)
        first, last = ([np.frombuffer(x, np.int32) for x in context[c].to_pylist()] for c in ("first", "last"))
        begin = np.cumsum([0, *map(len, first)]).astype(np.int64)
        both = [np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int64) for x in (first, last)]
        longs = {f"{name}_{c}": t[c].to_numpy().astype(np.int64) for name, t in (("context", context), ("window", window)) for c in ("hi", "lo")}
        save(f"{folder}/marks-{part}", begin=begin, first=both[0], last=both[1], **longs)

    filed(marks, texts, ["kind", "hi", "lo", "first", "last"], write_marks)
    return Found(windows, folder, crowds)


# --- the operator -------------------------------------------------------------------------------------------------------------


def _covered(found: Found, part: int, texts: list[bytes], read: Words | None = None) -> np.ndarray:
    """For each symbol of the texts, end to end, whether a window that stands twice covers it."""
    pieces = pieces_of(texts, found.windows, read)
    edge = np.zeros(pieces[-1].at + len(pieces[-1].text.data) + 1, np.int32)
    for piece in pieces:
        first, last = found.ranges(part, piece)
        np.add.at(edge, first + piece.at, 1)
        np.add.at(edge, last + piece.at + found.windows.length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 400, passage_words: int = 51, keep_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words and, if asked for, kept (binary).

    Every byte goes that lies in a string of ``length`` bytes which also starts at another place, of the same document or another;
    strings are judged on the texts given and never cross documents. n_passage_words has the words that lie in a run of
    ``passage_words`` words (A-Z as a-z) which also starts at another place; such passages are only counted, not removed, and 0 turns
    the count off. A null text is empty. Repeated rows repeat each other's strings, so those of ``length`` bytes or more lose all of
    them. Other columns are ignored. No rows: no rows.
    """
    small_arrow_batches(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    if length < 8 or 0 < passage_words < 8:
        raise ValueError("strings of 8 bytes, and of 8 words, or more are supported")
    texts = materialise(docs.withColumn("part_", F.spark_partition_id()), "texts").df
    bytes_ = find_repeats(texts, Windows(length))
    words = find_repeats(texts, Windows(passage_words, True)) if passage_words else None
    ids = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", *["kept"] * keep_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch, own in groups_of(batches):
            gone = _covered(bytes_, part, own)
            shared = np.zeros(len(own), np.int64)
            if words:
                read = words_of(own)
                shared = np.bincount(read.row, _covered(words, part, own, read), len(own)).astype(np.int64)
            columns: list[list] = [[] for _ in names[1:]]
            at = 0
            for text, n in zip(own, shared.tolist(), strict=True):
                mask = gone[at : at + len(text)]
                at += len(text)
                removed = int(np.count_nonzero(mask))
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + bool(removed and mask[0])
                kept = text if not removed else np.frombuffer(text, np.uint8)[~mask].tobytes()
                for column, value in zip(columns, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), n, kept), strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    schema = f"doc_id {ids}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", kept binary" * keep_text
    return texts.select("doc_id", "text", "part_").mapInArrow(remove, schema)
