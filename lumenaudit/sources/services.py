"""Services with pages as data sources: `spark.read.format(...)` and `spark.readStream.format(...)` over a client the caller gives.

Two kinds. `searches` reads rows of a search console day by day: a partition a day, filters on day and key go into the
requests, and as a stream the offset is the last day that is complete. `feed` reads a numbered feed (captures, say) by
ranges of numbers, as a table up to what is there now or as a stream from where its checkpoint ended. A page is asked for
again if it fails, alone; a task that is lost starts its own partition again; nothing is read on the driver but offsets.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

from .fetching import ATTEMPTS, MAX_ROWS, PROPERTIES, ROW_LIMIT

SEARCH_ROW = "day date, key string, clicks bigint, impressions bigint, ctr double, position double"
#: Numbers of a feed that one partition reads.
RANGE = 1000


def again(call: Callable[[], Any], attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What the call gives, asked again after 1, 2, 4, ... times `wait` seconds; the last failure is raised."""
    for n in range(attempts):
        try:
            return call()
        except (OSError, ValueError):
            if n + 1 == attempts:
                raise
            sleep(wait * 2**n)
    raise ValueError("at least one attempt")


class Day(InputPartition):
    def __init__(self, day: dt.date):
        self.day = day


class Numbers(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Searches:
    """What the table and the stream of searches share. Options: domain, dimension, start_date, end_date, row_limit, max_rows, attempts, wait."""

    def __init__(self, query: Callable[[str, dict], dict | None], options: dict[str, str]):
        self.query, self.options, self.keys, self.part = query, options, None, None
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", 0.5))
        # Which name of the site answers is the same for all days, so it is asked for once.
        probe = {"startDate": options.get("start_date", ""), "endDate": options.get("end_date", options.get("start_date", "")), "dimensions": [self.dimension], "rowLimit": 1, "startRow": 0}
        names = [p.format(domain=options["domain"]) for p in PROPERTIES]
        self.site = next((p for p in names if again(lambda p=p: query(p, probe), self.attempts, self.wait) is not None), None)

    @property
    def dimension(self) -> str:
        return self.options.get("dimension", "query")

    def days(self, first: dt.date, last: dt.date) -> list[Day]:
        return [] if self.site is None else [Day(first + dt.timedelta(k)) for k in range((last - first).days + 1)]

    def read(self, partition: Day | None) -> Iterator[tuple]:
        if partition is None:  # there are no days to read
            return
        limit, most = int(self.options.get("row_limit", ROW_LIMIT)), int(self.options.get("max_rows", MAX_ROWS))
        body: dict = {"startDate": str(partition.day), "endDate": str(partition.day), "dimensions": [self.dimension]}
        asked = [] if self.keys is None else [{"operator": "equals", "expressions": sorted(self.keys)}]
        asked += [] if self.part is None else [{"operator": "contains", "expressions": [self.part]}]
        if asked:
            body["filters"] = [{"dimension": self.dimension} | a for a in asked]
        done = 0
        while done < most:
            size = min(limit, most - done)
            page = again(lambda: self.query(self.site, body | {"rowLimit": size, "startRow": done}), self.attempts, self.wait)  # noqa: B023
            rows = (page or {}).get("rows") or []
            for r in rows:
                yield partition.day, (r.get("keys") or [None])[0], int(r.get("clicks", 0)), int(r.get("impressions", 0)), float(r.get("ctr", 0.0)), float(r.get("position", 0.0))
            done += len(rows)
            if len(rows) < size:
                break


class SearchReader(_Searches, DataSourceReader):
    def __init__(self, query: Callable[[str, dict], dict | None], options: dict[str, str]):
        super().__init__(query, options)
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("start_date", "end_date"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Days become fewer partitions, keys go into the requests; what a service can't do is left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column == "day" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                above = f.value + dt.timedelta(1) if isinstance(f, GreaterThan) else f.value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else self.first
                below = f.value - dt.timedelta(1) if isinstance(f, LessThan) else f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else self.last
                self.first, self.last = max(self.first, above), min(self.last, below)
            elif column == "key" and isinstance(f, (EqualTo, In)):
                own = set(f.value if isinstance(f, In) else [f.value]) - {None}
                self.keys = own if self.keys is None else self.keys & own
            elif column == "key" and isinstance(f, StringContains) and self.part is None:
                self.part = f.value
            elif column == "day" and isinstance(f, IsNotNull):
                pass
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [] if self.keys is not None and not self.keys else self.days(self.first, self.last)


class SearchStream(_Searches, DataSourceStreamReader):
    def __init__(self, query: Callable[[str, dict], dict | None], latest: Callable[[], str], options: dict[str, str]):
        super().__init__(query, options)
        self.latest = latest

    def initialOffset(self) -> dict:
        """The day before the first that is read."""
        return {"day": str(dt.date.fromisoformat(self.options["start_date"]) - dt.timedelta(1))}

    def latestOffset(self) -> dict:
        return {"day": max(self.initialOffset()["day"], again(self.latest, self.attempts, self.wait))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.days(dt.date.fromisoformat(start["day"]) + dt.timedelta(1), dt.date.fromisoformat(end["day"]))


def searches(name: str, query: Callable[[str, dict], dict | None], latest: Callable[[], str] | None = None) -> type[DataSource]:
    """A data source of SEARCH_ROW. query(property, body) gives a page of rows, or None for no access; latest() the last
    complete day as text. Both run on executors or the driver and must be picklable."""

    class Searches(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SEARCH_ROW

        def reader(self, schema: Any) -> DataSourceReader:
            return SearchReader(query, dict(self.options))

        def streamReader(self, schema: Any) -> DataSourceStreamReader:
            return SearchStream(query, latest, dict(self.options))

    return Searches


class _Feed:
    """What the table and the stream of a feed share. Options: page (numbers a request), range (numbers a partition), attempts, wait."""

    def __init__(self, fetch: Callable[[int, int], list[tuple]], end: Callable[[], int], options: dict[str, str]):
        self.fetch, self.end, self.options = fetch, end, options
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", 0.5))

    def ranges(self, first: int, last: int) -> list[Numbers]:
        size = int(self.options.get("range", RANGE))
        return [Numbers(k, min(last, k + size)) for k in range(first, last, size)]

    def read(self, partition: Numbers | None) -> Iterator[tuple]:
        if partition is None:
            return
        size = int(self.options.get("page", ROW_LIMIT))
        for k in range(partition.first, partition.last, size):
            yield from again(lambda: self.fetch(k, min(partition.last, k + size)), self.attempts, self.wait)  # noqa: B023


class FeedReader(_Feed, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.ranges(int(self.options.get("first", 0)), again(self.end, self.attempts, self.wait))


class FeedStream(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("first", 0))}

    def latestOffset(self) -> dict:
        return {"next": max(self.initialOffset()["next"], again(self.end, self.attempts, self.wait))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.ranges(start["next"], end["next"])


def feed(name: str, ddl: str, fetch: Callable[[int, int], list[tuple]], end: Callable[[], int]) -> type[DataSource]:
    """A data source of a numbered feed: fetch(first, last) gives the rows of numbers first to last - 1, end() the next number."""

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ddl

        def reader(self, schema: Any) -> DataSourceReader:
            return FeedReader(fetch, end, dict(self.options))

        def streamReader(self, schema: Any) -> DataSourceStreamReader:
            return FeedStream(fetch, end, dict(self.options))

    return Feed


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Makes sources known by name. Filters reach readers only where the session allows it, so this is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)
