"""Providers that are read by scope, change date and offset: a partitioned source whose date cursor moves when a read is complete."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DAY = datetime.timedelta(days=1)
#: Fixed value: providers refuse to page past so many rows of one question.
MOST_OFFSET = 100_000


class Page(NamedTuple):
    """One answer: its rows, and whether the provider says that nothing follows (a bool, a string of one, or None if it doesn't say)."""

    rows: list[tuple]
    ended: object = None


class Question(NamedTuple):
    """What a page is asked of: a scope (a county, a box) and the days of change from ``since`` to ``until``; no ``since``: all before."""

    scope: str
    since: str | None
    until: str


class Provider(NamedTuple):
    """How a provider is asked. ``fetch(question, offset, n)`` gives a page; ``count(question)``, if there is one, how many rows it has.

    ``silence_ends``: whether an answer that doesn't say if it was the last one was. ``earliest``: the first day that rows can have.
    """

    fetch: Callable[[Question, int, int], Page]
    count: Callable[[Question], int] | None = None
    page: int = 500
    most_offset: int = MOST_OFFSET
    silence_ends: bool = True
    earliest: str = "1970-01-01"


class TooMany(Exception):
    """A question has more rows than may be paged through, and its days can't be divided further: what is past them can't be read."""


def is_last(page: Page, silence_ends: bool) -> bool:
    """A page without rows is the last, whatever it says."""
    if not page.rows:
        return True
    return silence_ends if page.ended is None else str(page.ended).strip().lower() == "true"


def pages(provider: Provider, question: Question) -> Iterator[tuple]:
    """All rows of a question; an error, not an end, where the provider would page no further."""
    at = 0
    while True:
        n = min(provider.page, provider.most_offset - at)
        if n <= 0:
            raise TooMany(f"{question} has more than {provider.most_offset} rows")
        page = provider.fetch(question, at, n)
        yield from page.rows
        if is_last(page, provider.silence_ends):
            return
        at += n


def divided(provider: Provider, question: Question) -> list[Question]:
    """Questions of fewer days that together ask the same, each with no more rows than may be paged through.

    Days are halved while there are too many rows; one day with too many is an error. Without a count nothing is divided.
    """
    if provider.count is None:
        return [question]
    out, todo = [], [question]
    while todo:
        q = todo.pop()
        if provider.count(q) <= provider.most_offset:
            out.append(q)
            continue
        first, last = (datetime.date.fromisoformat(x) for x in (q.since or provider.earliest, q.until))
        if first >= last:
            raise TooMany(f"{q} is one day with more than {provider.most_offset} rows")
        middle = first + (last - first) // 2
        todo += [q._replace(since=(middle + DAY).isoformat()), q._replace(until=middle.isoformat())]
    return out


class Slice(InputPartition):
    def __init__(self, question: Question) -> None:
        super().__init__(question)
        self.question = question


def saved(path: str | None) -> dict[str, str]:
    """Dates by scope up to which everything was read; none without a file."""
    if path is None or not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def windowed_source(name: str, schema: str, provider: Provider, scopes: Sequence[str], today: Callable[[], str], cursor: str | None = None) -> type[DataSource]:
    """A source to register, for batches and streams: a partition for each scope, and for each part of its days where it has many rows.

    A stream's offset has a date for each scope: everything changed up to that day was read. A micro-batch reads from those dates
    (that day again, for it may not have been over) to today, and they move only when all its pages were read and stored: one
    page that fails, or a query that is stopped, leaves them. A scope that is new starts from the beginning while others go on.
    Rows of a date that is read again come again, so the sink must be idempotent.

    ``cursor``: a file for those dates, which also outlives the checkpoint; ``commit`` replaces it whole. The option ``full`` ignores it.
    A batch read takes everything up to today, or from the option ``since``.
    """

    def slices(start: dict[str, str], end: dict[str, str]) -> list[Slice]:
        return [Slice(q) for scope, until in sorted(end.items()) if start.get(scope) != until for q in divided(provider, Question(scope, start.get(scope), until))]

    class Stream(DataSourceStreamReader):
        def __init__(self, full: bool) -> None:
            self.first = {} if full else saved(cursor)

        def initialOffset(self) -> dict:
            return self.first

        def latestOffset(self) -> dict:
            return dict.fromkeys(scopes, today())

        def partitions(self, start: dict, end: dict) -> list[Slice]:
            return slices(start, end)

        def read(self, partition: Slice) -> Iterator[tuple]:
            return pages(provider, partition.question)

        def commit(self, end: dict) -> None:
            if cursor is not None:
                with open(f"{cursor}.new", "w") as f:
                    json.dump(saved(cursor) | end, f)
                os.replace(f"{cursor}.new", cursor)

    class Batch(DataSourceReader):
        def __init__(self, since: str | None) -> None:
            self.since = since

        def partitions(self) -> list[Slice]:
            return slices({s: self.since for s in scopes} if self.since else {}, dict.fromkeys(scopes, today()))

        def read(self, partition: Slice) -> Iterator[tuple]:
            return pages(provider, partition.question)

    class Windowed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> Stream:
            return Stream(str(self.options.get("full", "false")).lower() == "true")

        def reader(self, schema) -> Batch:
            return Batch(self.options.get("since"))

    return Windowed
