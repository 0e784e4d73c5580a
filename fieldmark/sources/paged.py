"""Providers that are read page by page as streaming sources with an offset, and the manners to ask them with."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# Answers after which a request is made again, and the longest wait that a provider may ask for.
RETRY = (408, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)
LONGEST_WAIT_S = 60.0


class Refused(Exception):
    """An answer with an error status; ``wait``: seconds that it asks to wait, if any."""

    def __init__(self, status: int, wait: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


def polite(ask: Callable, per_second: float = 1.0, tries: int = 5, first_wait: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``ask`` with requests spaced in time, and made again after some statuses, each wait twice the one before or as long as asked."""
    last = [-1e9]

    def asked(*args, **more):
        for k in range(tries):
            sleep(max(0.0, last[0] + 1 / per_second - clock()))
            last[0] = clock()
            try:
                return ask(*args, **more)
            except Refused as e:
                if e.status not in RETRY or k == tries - 1:
                    raise
                sleep(min(LONGEST_WAIT_S, e.wait if e.wait is not None else first_wait * 2**k))
        return None

    return asked


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[tuple]], page: int = 200, most: int = 5000) -> type[DataSource]:
    """A source to register: ``fetch(above, n)`` gives up to n rows whose first field, the id, is over ``above``, in order of ids.

    A micro-batch reads pages until one is short or ``most`` rows are read; the offset is the last id, kept by the checkpoint once the
    batch is done, so a batch that failed is read again and one that was done is not. Rows arrive once if the sink is idempotent.
    """

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"id": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows: list[tuple] = []
            at = start["id"]
            while len(rows) < most:
                got = fetch(at, min(page, most - len(rows)))
                rows += got
                at = got[-1][0] if got else at
                if len(got) < page:
                    break
            return iter(rows), {"id": at}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            at = start["id"]
            while at < end["id"]:
                got = [r for r in fetch(at, page) if r[0] <= end["id"]]
                if not got:
                    return
                yield from got
                at = got[-1][0]

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema) -> Reader:
            return Reader()

    return Paged
