"""Paged services as a data source (SRC-17, SRC-18's paging): pages are the partitions of a batch, and the offsets of a stream; a page that fails is asked for again, with growing pauses, where it is read.

What asks is the caller's: fetch(page) -> rows of that page (an empty list or None: no such page yet; pages have no gaps) runs on the executors, so tests and other services need no network here.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from auditlake.session import ship

Fetch = Callable[[int], Iterable[tuple] | None]


class Pages(InputPartition):
    """Pages first to last, the latter not included."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def asked(fetch: Fetch, page: int, tries: int, pause: float) -> list[tuple]:
    """The rows of a page; after the last try the error is the task's, which Spark tries again elsewhere."""
    for n in range(tries):
        try:
            return [tuple(r) for r in fetch(page) or ()]
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)
    return []


def _dealt(first: int, last: int, tasks: int) -> list[InputPartition]:
    step = max(1, -(-(last - first) // max(1, tasks)))
    return [Pages(k, min(last, k + step)) for k in range(first, last, step)]


class _Batch(DataSourceReader):
    def __init__(self, fetch: Fetch, first: int, last: int, tasks: int, tries: int, pause: float):
        self.fetch, self.first, self.last, self.tasks, self.tries, self.pause = fetch, first, last, tasks, tries, pause

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.first, self.last, self.tasks) or [Pages(self.first, self.first)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            yield from asked(self.fetch, page, self.tries, self.pause)


class _Stream(DataSourceStreamReader):
    """The offset is the number of the next page. A micro-batch takes the pages that are there, in `tasks` tasks. Trigger.AvailableNow asks once for the end of what is there, so a run reads all of it
    only if no `most` bounds the pages of a micro-batch.

    The end is found in steps that double and are then halved: the driver asks for few pages, not for each."""

    def __init__(self, fetch: Fetch, first: int, most: int | None, tasks: int, tries: int, pause: float):
        self.fetch, self.first, self.most, self.tasks, self.tries, self.pause, self.next = fetch, first, most, tasks, tries, pause, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        low = self.first if self.next is None else self.next  # all pages before it are there
        step, high = 1, None if self.most is None else low + self.most  # a page that is not there, or the bound
        while high is None or low < high:
            at = low + step - 1 if high is None else min(low + step - 1, high - 1)
            if asked(self.fetch, at, self.tries, self.pause):
                low, step = at + 1, 2 * step
            else:
                high, step = at, 1
                while low < high:
                    at = (low + high) // 2
                    low, high = (at + 1, high) if asked(self.fetch, at, self.tries, self.pause) else (low, at)
        self.next = low
        return {"page": low}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.next = max(self.next or 0, end["page"])  # after a restart the stream goes on from here
        return _dealt(start["page"], end["page"], self.tasks)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            yield from asked(self.fetch, page, self.tries, self.pause)

    def commit(self, end: dict) -> None:
        pass


def paged(name: str, columns: str, fetch: Fetch) -> type[DataSource]:
    """A data source for spark.dataSource.register: format(name), with the options first, last (page after the last; batch only), tasks, most (pages of a micro-batch; stream only, by default all that are
    there), tries and pause (seconds)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def _of(self, option: str, default: float) -> float:
            return float(self.options.get(option, default))

        def reader(self, schema: object) -> DataSourceReader:
            return _Batch(fetch, int(self._of("first", 0)), int(self._of("last", 0)), int(self._of("tasks", 8)), int(self._of("tries", 3)), self._of("pause", 1.0))

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            most = self.options.get("most")
            return _Stream(fetch, int(self._of("first", 0)), None if most is None else int(most), int(self._of("tasks", 8)), int(self._of("tries", 3)), self._of("pause", 1.0))

    return Paged


def read_pages(spark: SparkSession, name: str, columns: str, fetch: Fetch, pages: int, **options: object) -> DataFrame:
    """The rows of pages 0 to `pages`."""
    ship(spark)
    spark.dataSource.register(paged(name, columns, fetch))
    return spark.read.format(name).options(last=pages, **options).load()


def stream_pages(spark: SparkSession, name: str, columns: str, fetch: Fetch, **options: object) -> DataFrame:
    ship(spark)
    spark.dataSource.register(paged(name, columns, fetch))
    return spark.readStream.format(name).options(**options).load()
