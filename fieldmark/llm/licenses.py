"""License scan: phrases, and an exact set-similarity join of licence templates with text blocks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only, small_batches, utf8_column

# Fixed phrases and labels of the scan's contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices, and grants and whole texts of well-known licences, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Lower-cases A-Z and makes a space of every byte that no word has.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class BlockRules:
    """A block of a template of n words is any ``ceil(n * stretch)`` words in a row; it is found from ``containment`` of the template's set."""

    containment: float = 0.8
    stretch: float = 1.25


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Template:
    """The set of a template's words, and how many of them a block must hold."""

    def __init__(self, label: str, text: str, rules: BlockRules) -> None:
        self.label, words = label, words_of(text.encode())
        self.tokens = frozenset(words)
        self.n = len(self.tokens)
        self.need = max(1, math.ceil(rules.containment * self.n - 1e-9))
        self.length = math.ceil(len(words) * rules.stretch)

    def blocks(self, hits: Sequence[tuple[int, bytes]]) -> Iterator[tuple[int, int, float]]:
        """(first word, end, containment) of maximal runs of overlapping blocks that hold enough; ``hits``: places of the template's words."""
        counts: dict[bytes, int] = {}
        left, run = 0, None
        for p, w in hits:
            counts[w] = counts.get(w, 0) + 1
            while hits[left][0] <= p - self.length:
                old = hits[left][1]
                counts[old] -= 1
                if not counts[old]:
                    del counts[old]
                left += 1
            if len(counts) >= self.need:
                start, share = hits[left][0], len(counts) / self.n
                if run and start < run[1]:
                    run = (run[0], p + 1, max(run[2], share))
                else:
                    if run:
                        yield run
                    run = (start, p + 1, share)
        if run:
            yield run


def token_index(rows: DataFrame, templates: Sequence[Template], vocabulary: Sequence[bytes]) -> tuple[DataFrame, DataFrame]:
    """(token, template, rank, n, need) of each template's prefix, and (template, tokens) of all.

    Tokens are numbered in ``vocabulary``; the order is that of their frequency in all documents (column ``tokens`` of ``rows``), rarest
    first. A text that holds ``need`` of n words has one of the first n - need + 1.
    """
    spark = rows.sparkSession
    seen = {r["token"]: r["n"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # words of templates at most
    number = {w: i for i, w in enumerate(vocabulary)}
    prefix, whole = [], []
    for k, t in enumerate(templates):
        order = sorted((number[w] for w in t.tokens), key=lambda i: (seen.get(i, 0), i))
        prefix += [(i, k, rank, t.n, t.need) for rank, i in enumerate(order[: t.n - t.need + 1])]
        whole.append((k, order))
    return spark.createDataFrame(prefix, "token int, template int, rank int, n int, need int"), spark.createDataFrame(whole, "template int, all_ array<int>")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, rules: BlockRules = BlockRules(), broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    A set-similarity join of documents and templates, of which there may be any number: documents and templates that share a word of
    a template's prefix meet; a pair goes on if the rarest word they share leaves enough others (position), the document has words
    enough (length), and their sets share enough. Only texts of such pairs are read again, for the blocks of those templates.
    blocks: (label, template's place, first word, end, containment) of every run of overlapping blocks that holds enough of a
    template. score: 1 where a phrase stands, else the highest containment found, else 0. A null or empty text has no words and
    no labels. Repeated rows are scanned each for itself; rows are told apart by doc_id and text. Other columns are ignored. No rows: no rows.
    """
    docs = only(docs, "doc_id", "text").withColumn("text_", F.xxhash64("text"))
    ready = [Template(label, text, rules) for label, text in templates]
    vocabulary = sorted({w for t in ready for w in t.tokens})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = docs.schema["doc_id"].dataType.simpleString()
    phrase = re.compile(rb"(?<![^ ])(?:" + b"|".join(p.encode() for p in PHRASES) + rb")(?![^ ])")
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("tokens", pa.list_(pa.int32()))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns: list[list] = [[] for _ in fields]
            for text in utf8_column(batch, "text"):
                words = words_of(text)
                joined = b" ".join(words)
                found, word, at = [], 0, 0
                for m in phrase.finditer(joined):
                    word, at = word + joined.count(b" ", at, m.start()), m.start()
                    found.append((word, PHRASES[m[0].decode()]))
                base = ",".join(sorted({label for _, label in found}))
                tokens = sorted(number[w] for w in number.keys() & set(words))
                for column, value in zip(columns, (len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, base, tokens), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]], ["doc_id", "text_", *[n for n, _ in fields]])

    schema = f"doc_id {ids}, text_ long, n_words long, n_base long, first_word long, last_word long, base_labels string, tokens array<int>"
    rows = materialise(docs.select("doc_id", "text", "text_").mapInArrow(read, schema), "licences").df
    prefix, whole = token_index(rows, ready, vocabulary)
    key = ["doc_id", "text_"]
    meet = rows.filter(F.size("tokens") > 0).dropDuplicates(key).select(*key, "n_words", "tokens", F.explode("tokens").alias("token"))
    meet = meet.join(F.broadcast(prefix) if sum(t.n for t in ready) <= broadcast_rows else prefix, "token")
    pairs = meet.groupBy(*key, "template", "n", "need", "n_words", "tokens").agg(F.min("rank").alias("rank")).filter((F.col("n") - F.col("rank") >= F.col("need")) & (F.col("n_words") >= F.col("need")))
    pairs = pairs.join(F.broadcast(whole) if len(ready) <= broadcast_rows // 100 else whole, "template").filter(F.size(F.array_intersect("tokens", "all_")) >= F.col("need"))
    pairs = materialise(pairs.groupBy(F.col("doc_id").alias("d_"), F.col("text_").alias("t_")).agg(F.collect_set("template").alias("templates")), "pairs").df
    few = pairs.count() <= broadcast_rows
    same = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("text_") == F.col("t_"))
    texts = docs.join(F.broadcast(pairs) if few else pairs, same).dropDuplicates(key).select(*key, "text", "templates")
    block = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text, asked in zip(utf8_column(batch, "text"), batch.column(3).to_pylist(), strict=True):
                words, blocks = words_of(text), []
                for k in sorted(asked):
                    t = ready[k]
                    hits = [(i, w) for i, w in enumerate(words) if w in t.tokens]
                    blocks += [{"label": t.label, "template": k, "first_word": a, "end_word": b, "containment": s} for a, b, s in t.blocks(hits)]
                out.append(blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, block)], ["d_", "t_", "blocks"])

    found = texts.mapInArrow(verify, f"d_ {ids}, t_ long, blocks array<struct<label: string, template: int, first_word: long, end_word: long, containment: double>>")
    found = materialise(found.filter(F.size("blocks") > 0), "blocks").df
    out = rows.join(F.broadcast(found) if few else found, same, "left")
    named = F.array_sort(F.array_distinct(F.concat(F.split("base_labels", ","), F.coalesce(F.transform("blocks", lambda b: b["label"]), F.array().cast("array<string>")))))
    labels = F.array_join(F.filter(named, lambda x: x != ""), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType)).alias("blocks"))
