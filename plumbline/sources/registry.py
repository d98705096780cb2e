"""The study registry as a data source of its own: after register(spark), `spark.read.format("study_registry")` and `spark.readStream...`.

Rows are (study_id, status, updated, value): value is the study's JSON. Filters on status and on the date of the last update go to the
registry. Pages come one after the other, as each
names the next; several date windows are read side by side. A stream's offset is the page token.

Options: url, limit, from and to (dates, both included) with windows (how many partitions that time is cut into), pause.
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

# Fixed values of the registry's interface.
URL = "https://clinicaltrials.gov/api/v2/studies"
FILTERS = {"filter.overallStatus": "COMPLETED", "filter.advanced": "AREA[DesignAllocation]RANDOMIZED AND AREA[StudyType]INTERVENTIONAL", "aggFilters": "results:with"}
MOST, PAGE, PAUSE = 500_000, 1000, 0.2


def fetch(url: str, params: dict) -> dict:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=60) as r:
        return json.load(r)


def page(url: str, size: int, token: str | None, filters: dict, get: Callable[[str, dict], dict] = fetch) -> tuple[list[dict], str | None]:
    """One page of studies, and the token of the next; none after the last."""
    got = get(url, filters | {"pageSize": size, "format": "json"} | ({"pageToken": token} if token else {}))
    found = got.get("studies", [])
    return found, got.get("nextPageToken") if found else None


def studies(limit: int, url: str = URL, get: Callable[[str, dict], dict] = fetch, pause: float = PAUSE, filters: dict | None = None) -> Iterator[dict]:
    """Up to limit studies, page by page."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"the limit must lie in 1..{MOST}")
    left, token = limit, None
    while left > 0:
        found, token = page(url, min(PAGE, left), token, filters or FILTERS, get)
        yield from found[:left]
        left -= len(found[:left])
        if not token:
            return
        time.sleep(pause)


def row(study: dict) -> tuple:
    """(study_id, status, updated, value) of a study."""
    protocol = study.get("protocolSection", {})
    status = protocol.get("statusModule", {})
    day = status.get("lastUpdatePostDateStruct", {}).get("date")
    try:
        updated = datetime.date.fromisoformat(day) if day else None
    except ValueError:  # a month without a day
        updated = None
    return protocol.get("identificationModule", {}).get("nctId"), status.get("overallStatus"), updated, json.dumps(study, sort_keys=True)


class Window(InputPartition):
    """Days first .. last of the last update; None where open."""

    def __init__(self, first: datetime.date | None, last: datetime.date | None) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.limit, self.url, self.pause = int(options.get("limit", 2000)), options.get("url", URL), float(options.get("pause", PAUSE))
        day = lambda k: datetime.date.fromisoformat(options[k]) if k in options else None
        self.first, self.last, self.windows, self.status = day("from"), day("to"), int(options.get("windows", 1)), FILTERS["filter.overallStatus"]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Status and bounds of the update's date go to the registry; Spark keeps all others."""
        for f in filters:
            match f:
                case EqualTo(("status",), str(s)):
                    self.status = s
                case GreaterThanOrEqual(("updated",), datetime.date() as d):
                    self.first = max(d, self.first or d)
                case LessThanOrEqual(("updated",), datetime.date() as d):
                    self.last = min(d, self.last or d)
                case _:
                    pass
            yield f  # the registry may treat missing dates in its own way: Spark checks all of them again

    def partitions(self) -> list[InputPartition]:
        """Windows of about equal length where both ends of the time are known."""
        if not (self.first and self.last and self.windows > 1):
            return [Window(self.first, self.last)]
        days = (self.last - self.first).days + 1
        cuts = [self.first + datetime.timedelta(days=k * days // self.windows) for k in range(self.windows + 1)]
        return [Window(a, b - datetime.timedelta(days=1)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def asked(self, w: Window) -> dict:
        """The request's filters for one window."""
        out = FILTERS | {"filter.overallStatus": self.status}
        if w.first or w.last:
            out["filter.advanced"] += f" AND AREA[LastUpdatePostDate]RANGE[{w.first or 'MIN'},{w.last or 'MAX'}]"
        return out

    def read(self, partition: Window) -> Iterator[tuple]:
        for s in studies(self.limit, self.url, pause=self.pause, filters=self.asked(partition)):
            yield row(s)


class RegistryStream(SimpleDataSourceStreamReader):
    """Page after page; the offset is the token of the page to read next."""

    def __init__(self, options: dict) -> None:
        self.url, self.size = options.get("url", URL), int(options.get("page", PAGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": "", "done": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        found, token = page(self.url, self.size, start["token"] or None, FILTERS)
        return iter([row(s) for s in found]), {"token": token or "", "done": int(not token)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """Pages from start up to end once more, after a failure."""
        at = start
        while at != end and not at["done"]:
            rows, at = self.read(at)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study_registry"

    def schema(self) -> str:
        return "study_id string, status string, updated date, value string"

    def reader(self, schema) -> RegistryReader:  # noqa: ANN001
        return RegistryReader(self.options)

    def simpleStreamReader(self, schema) -> RegistryStream:  # noqa: ANN001, N802
        return RegistryStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session; Spark must be told that Python sources may take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)
