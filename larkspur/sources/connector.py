"""Incremental pulls of a vendor's events, with a state that says how far they came."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.vendor import drop_repeats, map_vendor_events
from larkspur.sources.vendor_source import BATCH, OVERLAP_SECONDS, SLICE_SECONDS, Feed, QueryFeed, register_vendor_source, utc

#: Problems that a state remembers, the latest ones.
ERRORS = 20


@dataclass
class SyncState:
    """How far a source has been read, when that was, the rows so far, and what went wrong on the way."""

    last_timestamp: str | None = None
    last_synced_at: str | None = None
    rows: int = 0
    errors: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> SyncState:
        """The state in a file; a missing or broken file is a fresh start."""
        try:
            found = json.loads(Path(path).read_text())
            return cls(found.get("last_timestamp"), found.get("last_synced_at"), int(found.get("rows", 0)), [str(e) for e in found.get("errors") or []])
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()

    def save(self, path: str | Path) -> None:
        whole = Path(path)
        part = whole.with_suffix(".part")
        part.write_text(json.dumps(asdict(self)))
        part.replace(whole)


class Connector:
    """A feed that is read from where the last pull ended.

    The rows are pulled by tasks, a slice of time each, and never pass through the driver. Every pull
    reads the last ``overlap_seconds`` before that point again, for rows that the vendor received late;
    ``append_new`` keeps those that the store does not have.
    """

    def __init__(self, feed: Feed, state_path: str | Path = "sync_state.json", lookback_days: int = 90, slice_seconds: int = SLICE_SECONDS, overlap_seconds: int = OVERLAP_SECONDS):
        self.feed, self.state_path, self.lookback = feed, Path(state_path), timedelta(days=lookback_days)
        self.slice_seconds, self.overlap = slice_seconds, timedelta(seconds=overlap_seconds)

    def validate(self) -> bool:
        """Whether the feed answers; one that is no query interface always does."""
        try:
            return not isinstance(self.feed, QueryFeed) or self.feed.ask("SELECT 1")[0] == 200
        except ConnectionError:
            return False

    def since(self, now: datetime) -> datetime:
        """The first time that the next pull reads."""
        last = SyncState.load(self.state_path).last_timestamp
        return utc(last) - self.overlap if last else now - self.lookback

    def sync(self, spark: SparkSession, tenant_id: str, sink: Callable[[DataFrame], None], now: datetime | None = None) -> SyncState:
        """Hand what is new up to ``now`` to ``sink``, which runs one job over all rows; then move the state on.

        If a task's pages or the sink fail, the state stays where it was, with the problem among its errors,
        and the failure is raised: the next pull reads the same slices again.
        """
        now = now or datetime.now(timezone.utc)
        state, start = SyncState.load(self.state_path), self.since(now)
        options = {"start": start.isoformat(), "end": now.isoformat(), "slice_seconds": self.slice_seconds}
        raw = spark.read.format(register_vendor_source(spark, self.feed)).options(**options).load()
        seen = Observation()
        try:
            sink(drop_repeats(map_vendor_events(raw, tenant_id)).observe(seen, F.count(F.lit(1)).alias("rows")))
        except Exception as problem:
            state.errors = [*state.errors, f"{now.isoformat()} {type(problem).__name__}: {str(problem)[:300]}"][-ERRORS:]
            state.save(self.state_path)
            raise
        state = SyncState(now.isoformat(), datetime.now(timezone.utc).isoformat(), state.rows + seen.get["rows"], state.errors)
        state.save(self.state_path)
        return state


class VendorConnector(Connector):
    """A connector to the vendor's query interface; ``post`` is injected, so nothing here opens a connection."""

    def __init__(self, post: Callable[[str, dict], tuple[int, dict]], project: str, state_path: str | Path = "sync_state.json", batch: int = BATCH, lookback_days: int = 90, slice_seconds: int = SLICE_SECONDS, overlap_seconds: int = OVERLAP_SECONDS):
        super().__init__(QueryFeed(post, project, batch), state_path, lookback_days, slice_seconds, overlap_seconds)


def append_new(events: DataFrame, store: str, since: datetime) -> None:
    """Append to ``store`` (Parquet) the events that are not in it; only its rows from ``since`` on are compared."""
    try:
        known = events.sparkSession.read.parquet(store).filter(F.col("timestamp") >= F.lit(since)).select("tenant_id", "event_id")
        events = events.join(known, ["tenant_id", "event_id"], "left_anti")
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent.getCondition()):
            raise
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").parquet(store)
