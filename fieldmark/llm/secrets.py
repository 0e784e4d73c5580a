"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import only, small_batches, str_column

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")
# Fixed patterns of the scan's contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
PART = re.compile(r"[^=/]{20,}")

#: Regular expressions of strings that are no secrets though they look random: numbers, dates and times, UUIDs, repeated characters,
#: runs of the alphabet, placeholders.
ALLOWED = (
    r"[0-9_=+/-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(.)\1+",
    r"(?i).*(abcdefghij|0123456789|example|placeholder|changeme|your[_-]?(key|token|secret)|xxxxxx).*",
    r"[A-Za-z]+([-/_][A-Za-z]+)+",
)


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``window`` characters; a window counts from the bits that its candidate's character class asks for.

    Classes: hex (16 signs), alpha (letters only), alnum (letters and digits), base64 (these with ``+/=_-``). A window of 20 holds
    log2(20) = 4.32 bits at most, and of 16 signs 4.0; words of natural languages repeat letters and stay below the alpha limit.
    """

    window: int = 20
    bits: tuple[tuple[str, float], ...] = (("hex", 3.0), ("alpha", 4.1), ("alnum", 3.6), ("base64", 3.7))
    allowed: Sequence[str] = field(default=ALLOWED)


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if s.isalpha():
        return "alpha"
    return "alnum" if s.isalnum() else "base64"


def entropy_spans(s: str, window: int, least: float) -> list[tuple[int, int]]:
    """Runs of overlapping or touching windows with at least that entropy; counts are kept up as the window moves by one sign."""
    if len(s) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and math.log2(window) - total / window >= least:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


class Scanner:
    """Finds the spans of one text: (start, kind's place in KINDS, end)."""

    def __init__(self, rule: EntropyRule) -> None:
        self.window, self.bits = rule.window, dict(rule.bits)
        self.allowed = [re.compile(x) for x in rule.allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """Spans in candidates; of one that is on the allow-list, in its parts between ``=`` and ``/`` that are not by themselves."""
        out = []
        for m in CANDIDATE.finditer(text):
            parts = [(m.start(), m[0])]
            if self.is_allowed(m[0]):
                parts = [(m.start() + p.start(), p[0]) for p in PART.finditer(m[0]) if p[0] != m[0] and not self.is_allowed(p[0])]
            for at, s in parts:
                out += [(at + a, 3, at + b) for a, b in entropy_spans(s, self.window, self.bits[char_class(s)])]
        return out

    def is_allowed(self, s: str) -> bool:
        return any(x.fullmatch(s) for x in self.allowed)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, rule: EntropyRule = EntropyRule(), redact: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and found (array of kind, start, end, value).

    ``redact``: if given, a column ``redacted`` has the text in which that string stands in place of each run of overlapping spans.
    ``carry``: columns to hand on as they are. Places are code points, ends exclusive. A null text is empty and has no spans; its redacted text is null. Repeated rows are
    scanned each for itself. Other columns are ignored. No rows: no rows.
    """
    docs = only(docs, "doc_id", "text", *carry)
    span = "kind: string, start: long, end: long, value: string"
    also = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {also}n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<{span}>>, redacted string"
    out_schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))), ("redacted", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rule)
        for batch in small_batches(batches):
            columns: list[list] = [[] for _ in out_schema]
            nulls = batch.column(1).is_null().to_pylist()
            for text, null in zip(str_column(batch, "text"), nulls, strict=True):
                base = scanner.base(text)
                spans = sorted(base + scanner.entropy(text))
                kinds = [k for _, k, _ in base]
                found = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), found, None if redact is None or null else replaced(text, spans, redact))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *arrays], ["doc_id", *carry, *out_schema.names])

    rows = docs.select(F.col("doc_id"), F.col("text"), *carry).mapInArrow(scan, schema)
    return rows if redact is not None else rows.drop("redacted")


def replaced(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    parts, at = [], 0
    end = -1
    for a, _, b in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        parts += [text[at:a], by]
        at = end = b
    return "".join([*parts, text[at:]])
