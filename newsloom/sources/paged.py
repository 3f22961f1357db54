"""A paged store as a data source: windows by time, chains of pages in them, and new anchors where a chain ends too soon.

Such a store gives rows of a range of times, newest first, a page at a time, and stops a chain of pages after so many rows though there are
more. A window's reader then begins a new chain at the oldest time that it has seen (that included, as several rows may have it), until
a chain ends by itself. Rows at an anchor come twice: ``latest`` keeps the last write of each id.

Each window of ``days`` is a partition, read by a task of its own, so that chains are as short as windows and a lost executor repeats
only its windows. Bounds on ``collected`` in a query's filter narrow the windows before anything is read, and stay in the query.

    register(spark)
    spark.read.format("paged").schema(schema).options(client="module:Class", start="2024-01-01", end="2024-02-01", days=1, **others).load()

A client is made on the executor from the options, and has ``page(low, high, cursor, size)``: rows (as the schema's tuples) with
``low <= collected < high`` from a cursor on (None: the newest), and the next cursor or None; both ``TooMany`` and a cursor of None end a chain.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

TIME, PAGE, TICK = "collected", 100, dt.timedelta(microseconds=1)


class TooMany(Exception):
    """A chain is as long as the store allows; there may be more rows."""


@dataclass
class Window(InputPartition):
    low: dt.datetime
    high: dt.datetime


def windows(low: dt.datetime, high: dt.datetime, days: float) -> list[Window]:
    out, step = [], dt.timedelta(days=days)
    while low < high:
        out.append(Window(low, min(high, low + step)))
        low += step
    return out


def chained(client, low: dt.datetime, high: dt.datetime, at: int, size: int = PAGE) -> Iterator[tuple]:
    """All rows of a window, in chains; ``at`` is the place of the time in a row. A chain whose rows all have one time can't be anchored: an error."""
    while True:
        cursor, first, oldest = None, None, None
        try:
            while True:
                rows, cursor = client.page(low, high, cursor, size)
                for row in rows:
                    first = first or row[at]
                    oldest = row[at]
                    yield row
                if cursor is None:
                    return
        except TooMany:
            if oldest is None or (oldest == first and oldest + TICK >= high):
                raise ValueError(f"more rows at {oldest} than a chain holds") from None
            high = oldest + TICK  # the anchor: what is as old as the oldest, or older


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.options, self.at = dict(options), schema.fieldNames().index(TIME)
        self.low, self.high = (dt.datetime.fromisoformat(options[k]) for k in ("start", "end"))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == (TIME,) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                value = f.value.replace(tzinfo=None) if f.value.tzinfo is None else f.value.astimezone(dt.UTC).replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                else:
                    self.high = min(self.high, value + TICK if isinstance(f, LessThanOrEqual) else value)
            yield f  # Spark tests it too

    def partitions(self) -> list[Window]:
        return windows(self.low, self.high, float(self.options.get("days", 1)))

    def read(self, partition: Window) -> Iterator[tuple]:
        module, _, name = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), name)(self.options)
        yield from chained(client, partition.low, partition.high, self.at, int(self.options.get("size", PAGE)))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark) -> None:
    """Makes the source known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def latest(rows: DataFrame, key: str = "id", version: str = "edited") -> DataFrame:
    """The last write of each id."""
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


class FileStore:
    """A client over a Parquet folder or file (option ``path``, any file system that Arrow knows), with the limit ``chain`` of rows; ``columns`` are the
    file's names of the schema's fields, in order, the time's first. A window is read and sorted once, and later chains take what is left of it."""

    def __init__(self, options: dict):
        import pyarrow.dataset as ds

        self.columns, self.chain = options["columns"].split(","), int(options["chain"])
        self.data, self.bounds = ds.dataset(options["path"], format="parquet"), None

    def page(self, low, high, cursor, size):
        if self.bounds is None or low != self.bounds[0] or high > self.bounds[1]:
            self._hold(low, high)
        first = len(self.times) - int(self.times[::-1].searchsorted(np.datetime64(high, "us")))  # rows at ``high`` and newer come first
        at, left = cursor or 0, len(self.times) - first
        if at >= self.chain:
            raise TooMany
        held = self.held.slice(first + at, min(size, self.chain - at))
        rows = list(zip(*(c.to_pylist() for c in held.columns), strict=True))
        return rows, at + len(rows) if at + len(rows) < left else None

    def _hold(self, low, high):
        import pyarrow.dataset as ds

        time = ds.field(self.columns[0])
        rows = self.data.to_table(columns=self.columns, filter=(time >= low) & (time < high), use_threads=False)
        self.held = rows.sort_by([(c, "descending") for c in self.columns]).combine_chunks()
        self.times = self.held.column(0).to_numpy().astype("datetime64[us]")
        self.bounds = (low, high)
