"""A vendor's event query as a Spark data source: tasks pull slices of time, in batches and as a stream.

``spark.read.format("vendor_events")`` and ``spark.readStream`` give the raw rows (uuid, event, distinct_id,
timestamp, properties) of ``feed``, registered with ``register_vendor_source``. A slice is one input
partition, so as many tasks ask the vendor as the cluster has room for, and a lost task asks again for its
slice alone. The stream's offset is the time up to which it has read; each batch also reads the last
``overlap_seconds`` again, for rows that the vendor received late, and ``pull_stream`` drops by event_id
what came before.

Options: start and end (ISO times, UTC where they name no zone; a slice holds start <= timestamp < end; end
defaults to now), slice_seconds (86,400), overlap_seconds (3,600; streams only). A stream that is given an
end reads up to it and waits there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larkspur.session import ship
from larkspur.sources.vendor import map_vendor_events
from larkspur.streaming.incremental import distinct_events

NAMES = ("uuid", "event", "distinct_id", "timestamp", "properties")
RAW = T.StructType([T.StructField(n, T.StringType()) for n in NAMES])
_ARROW = pa.schema([(n, pa.string()) for n in NAMES])
FORMAT = "vendor_events"
#: Rows of a page, and most that the interface gives.
BATCH, MOST = 1000, 50_000
SLICE_SECONDS, OVERLAP_SECONDS = 86_400, 3_600


class Feed(Protocol):
    """Where rows come from; it is pickled, and used in tasks."""

    def rows(self, start: datetime, end: datetime) -> Iterator[list[tuple]]:
        """Raw rows with start <= timestamp < end, in lists."""


@dataclass(frozen=True)
class QueryFeed:
    """The vendor's query interface; ``post(path, body) -> (status, json)`` opens the connection.

    Pages go by (timestamp, uuid): rows of one instant are never skipped nor read without end. A page that
    fails is asked for again, ``attempts`` times in all, with growing pauses.
    """

    post: Callable[[str, dict], tuple[int, dict]]
    project: str
    batch: int = BATCH
    attempts: int = 3
    pause: float = 1.0

    def __post_init__(self) -> None:
        if not 1 <= self.batch <= MOST:
            raise ValueError(f"batch must be 1 to {MOST}")

    def ask(self, sql: str) -> tuple[int, dict]:
        return self.post(f"/api/projects/{self.project}/query", {"query": {"kind": "HogQLQuery", "query": sql}})

    def _page(self, sql: str) -> list[tuple]:
        for attempt in range(1, self.attempts + 1):
            try:
                status, found = self.ask(sql)
                if status == 200:
                    return [tuple(r) for r in found.get("results") or []]
                problem = f"status {status}"
            except ConnectionError as failed:
                status, problem = 0, str(failed)
            # A refusal stays one.
            if attempt == self.attempts or status in (400, 401, 403, 404):
                break
            time.sleep(self.pause * 2 ** (attempt - 1))
        raise ConnectionError(problem)

    def rows(self, start: datetime, end: datetime) -> Iterator[list[tuple]]:
        after, last, before = start.isoformat(), "", end.isoformat()
        while True:
            a, i = (x.replace("'", "") for x in (after, last))
            rows = self._page(
                f"SELECT uuid, event, distinct_id, timestamp, properties FROM events WHERE (timestamp > toDateTime64('{a}', 6) OR (timestamp = toDateTime64('{a}', 6) AND toString(uuid) > '{i}')) "
                f"AND timestamp < toDateTime64('{before}', 6) ORDER BY timestamp, toString(uuid) LIMIT {self.batch}"
            )
            if rows:
                yield rows
                after, last = str(rows[-1][3]), str(rows[-1][0])
            if len(rows) < self.batch:
                return


@dataclass(frozen=True)
class ExportFeed:
    """The same rows in a Parquet export: ``columns`` names the export's column for each raw one, ``timestamp`` a time.

    Only the row groups and rows of a slice are read.
    """

    path: str
    columns: tuple[str, str, str, str, str] = NAMES

    def rows(self, start: datetime, end: datetime) -> Iterator[list[tuple]]:
        import pyarrow.dataset as ds

        table = ds.dataset(self.path, format="parquet")
        at, kind = ds.field(self.columns[3]), table.schema.field(self.columns[3]).type
        low, high = (pa.scalar(t if kind.tz else t.replace(tzinfo=None), kind) for t in (start, end))
        for batch in table.to_batches(columns=list(self.columns), filter=(at >= low) & (at < high)):
            told = [batch.column(c).to_pylist() for c in self.columns]
            told[3] = [t.isoformat() for t in told[3]]
            yield list(zip(*told, strict=True))


def utc(text: str) -> datetime:
    """A time from ISO text; UTC where it names no zone."""
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


@dataclass
class Slice(InputPartition):
    """start <= timestamp < end, as ISO texts."""

    start: str
    end: str


def slices(start: datetime, end: datetime, seconds: int) -> list[Slice]:
    """[start, end) cut at whole multiples of ``seconds``, so that a slice read again is the same one."""
    if seconds < 1:
        raise ValueError("slice_seconds must be positive")
    out, at = [], start
    while at < end:
        cut = datetime.fromtimestamp((int(at.timestamp()) // seconds + 1) * seconds, timezone.utc)
        out.append(Slice(at.isoformat(), min(cut, end).isoformat()))
        at = cut
    return out


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _read(feed: Feed, part: Slice) -> Iterator[pa.RecordBatch]:
    for rows in filter(None, feed.rows(utc(part.start), utc(part.end))):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(map(_text, c), pa.string()) for c in columns], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, feed: Feed, options: dict[str, str]):
        self.feed, self.seconds = feed, int(options.get("slice_seconds", SLICE_SECONDS))
        self.start, self.end = utc(options["start"]), utc(options["end"]) if "end" in options else datetime.now(timezone.utc)

    def partitions(self) -> list[Slice]:
        # Spark wants a partition at least.
        return slices(self.start, self.end, self.seconds) or [Slice(self.start.isoformat(), self.start.isoformat())]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.feed, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, feed: Feed, options: dict[str, str]):
        self.feed, self.seconds = feed, int(options.get("slice_seconds", SLICE_SECONDS))
        self.overlap = timedelta(seconds=int(options.get("overlap_seconds", OVERLAP_SECONDS)))
        self.start, self.end = options["start"], options.get("end")

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"until": utc(self.start).isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        until = utc(self.end) if self.end else datetime.now(timezone.utc)
        return {"until": max(until, utc(self.start)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first = max(utc(start["until"]) - self.overlap, utc(self.start))
        return slices(first, utc(end["until"]), self.seconds)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.feed, partition)

    def commit(self, end: dict) -> None:
        """Offsets are kept by the query's checkpoint."""


def register_vendor_source(spark: SparkSession, feed: Feed, name: str = FORMAT) -> str:
    """Make ``feed`` readable as format ``name`` in this session; return the name."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return RAW

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(feed, self.options)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802  Spark's name
            return _StreamReader(feed, self.options)

    ship(spark)
    spark.dataSource.register(Source)
    return name


def pull_stream(spark: SparkSession, feed: Feed, tenant_id: str, start: str, end: str | None = None, slice_seconds: int = SLICE_SECONDS, overlap_seconds: int = OVERLAP_SECONDS, name: str = FORMAT) -> DataFrame:
    """Canonical events of ``feed`` from ``start`` on, as a stream; each (tenant_id, event_id) once.

    The ids of the last two overlaps are kept as state in the query's checkpoint, so neither the overlap
    nor a restart repeats a row. Rows that the vendor received more than an overlap late are lost.
    """
    options = {"start": start, "slice_seconds": slice_seconds, "overlap_seconds": overlap_seconds} | ({"end": end} if end else {})
    raw = spark.readStream.format(register_vendor_source(spark, feed, name)).options(**options).load()
    return distinct_events(map_vendor_events(raw, tenant_id), f"{2 * overlap_seconds} seconds")
