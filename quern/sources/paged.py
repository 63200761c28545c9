"""A source that is read page by page: a page is a partition, and the first page tells how many there are.

A listing that is in order of one of its fields can say, in its first page, between which values each
page lies (`bounds`). Ranges asked of that field then choose the pages before any but the first is opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime, timezone
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from quern.sources.files import located


def _page(url: str, n: int) -> dict:
    """Page n of a listing: a URL with {page}, of a service or of any file system that tasks can reach."""
    where = url.format(page=n)
    if where.startswith(("http:", "https:")):
        with urlopen(where) as f:
            return json.load(f)
    system, path = located(where)
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def _comparable(value: object) -> object:
    """Times as text of one form and numbers as they are, so that what a filter holds compares with what JSON holds."""
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value).isoformat(timespec="microseconds")
    return value.isoformat() if isinstance(value, date) else value


class _Pages(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.url, self.order = schema.fieldNames(), options["url"], options.get("order")
        self.timed = {f.name for f in schema.fields if isinstance(f.dataType, (TimestampType, TimestampNTZType))}
        self.low: list = []
        self.high: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the order field, closed (a page too many does no harm). Every filter is Spark's to apply as well."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.order,):
                values = [_comparable(x) for x in (f.value if isinstance(f, In) else [f.value]) if x is not None]
                if values and not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low.append(min(values))
                if values and not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high.append(max(values))
            yield f

    def _bound(self, value: object) -> object:
        return _comparable(datetime.fromisoformat(value)) if self.order in self.timed else value

    def partitions(self) -> list[InputPartition]:
        first = _page(self.url, 1)
        total, bounds = int(first.get("total_pages", 1)), first.get("bounds")
        touched = lambda lo, hi: all(self._bound(hi) >= x for x in self.low) and all(self._bound(lo) <= x for x in self.high)
        known = bounds if self.order is not None and bounds is not None and len(bounds) == total else None
        return [InputPartition(n + 1) for n in range(total) if known is None or known[n] is None or touched(*known[n])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in _page(self.url, partition.value).get("items", []):
            yield tuple(datetime.fromisoformat(item[n]) if n in self.timed and item.get(n) is not None else item.get(n) for n in self.names)


class PagedSource(DataSource):
    """format("paged"): pages {items: [...], total_pages: n, bounds: [[first, last], ...]} at option url, a pattern with {page}; option order names the field of the bounds. Without order or bounds all pages are read."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(schema, self.options)


def paged(spark: SparkSession, url: str, schema: str, order: str | None = None) -> DataFrame:
    """All items of all pages, a task for each page; a task that is lost reads its page again. order: the field by which pages are in order, whose ranges choose pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").schema(schema).option("url", url)
    return (rows if order is None else rows.option("order", order)).load()
