"""Maintained views: batches of mergeable states, folded by compaction into versioned snapshots.

A view lies in a folder of its own:

    batch/upto=<n>      the states of stream batch n; a batch that is run again replaces its folder
    snapshot/upto=<n>   all batches up to n, merged, by bucket of the key
    commits/upto=<n>    one row, written after the snapshot is whole

A reader takes the last committed snapshot and the batches behind it and merges them, so it sees every
batch once whatever a compaction has done or left undone. A state holds sums and counts, never averages,
so merging is associative: snapshot and batches in any split give what one scan of the events gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators import heavy_hitters
from larkspur.operators.metrics import daily_partials, user_states
from larkspur.streaming.folders import drop_folders

WHO = ("tenant_id", "user_id")
#: Buckets of a snapshot: a point lookup of a user reads one of them.
BUCKETS = 64


def _union(c: str) -> Column:
    """The union of a group's arrays, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))


def merge_users(states: DataFrame) -> DataFrame:
    """States of users, merged to one for each (tenant_id, user_id)."""
    least, most = ("first_seen", "cohort_date"), ("last_seen", "last_active_date")
    added = ("event_count", "ai_events_count", "quality_sum", "quality_n")
    return states.groupBy(*WHO).agg(
        *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most], *[F.sum(c).alias(c) for c in added], *[_union(c).alias(c) for c in ("ai_features_used", "source_systems")]
    )


def merge_days(kind: str) -> Callable[[DataFrame], DataFrame]:
    """Daily states, merged to one for each (tenant_id, event_date, kind)."""

    def merge(states: DataFrame) -> DataFrame:
        added = [F.sum(c).alias(c) for c in ("n", "ai_n", "quality_sum", "quality_n", "cost_sum")]
        return states.groupBy("tenant_id", "event_date", kind).agg(*added, *[F.hll_union_agg(c).alias(c) for c in ("users", "sessions")])

    return merge


@dataclass(frozen=True)
class View:
    """How events become states, and states become fewer; both by the same keys."""

    name: str
    key: str
    states: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


VIEWS = (
    View("users", "user_id", user_states, merge_users),
    View("daily_metrics", "event_date", lambda e: daily_partials(e, "event_type"), merge_days("event_type")),
    View("feature_usage", "event_date", lambda e: daily_partials(e, "event_name"), merge_days("event_name")),
)


def top_view(name: str = "top_features", item: str = "event_name", size: int = heavy_hitters.SIZE) -> View:
    """A day's most frequent items with bounds, of bounded size; not among VIEWS, whose states list every item."""
    days = ("tenant_id", "event_date")
    return View(name, "event_date", lambda e: heavy_hitters.item_summaries(e, *days, item=item, size=size), lambda s: heavy_hitters.merge_summaries(s, *days, size=size))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The states below ``path``; None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class MaintainedView:
    """A view in ``folder``/<name>: put batches, compact them, read the merged states."""

    def __init__(self, spark: SparkSession, folder: str, view: View):
        self.spark, self.path, self.view = spark, f"{folder}/{view.name}", view

    def put(self, events: DataFrame, batch_id: int) -> None:
        """The states of a batch; putting the batch again replaces them."""
        self.view.states(events).write.mode("overwrite").parquet(f"{self.path}/batch/upto={batch_id}")

    def version(self) -> int:
        """The last batch in the last whole snapshot; -1 before the first."""
        commits = _read(self.spark, f"{self.path}/commits")
        last = commits.agg(F.max("upto")).first()[0] if commits is not None else None
        return -1 if last is None else int(last)

    def _parts(self, upto: int | None = None) -> list[DataFrame]:
        """The last snapshot and the batches behind it (up to ``upto``), as states; folders are pruned by their number."""
        version, parts = self.version(), []
        if version >= 0:
            parts.append(self.spark.read.parquet(f"{self.path}/snapshot/upto={version}").drop("bucket"))
        tail = _read(self.spark, f"{self.path}/batch")
        if tail is not None:
            tail = tail.filter(F.col("upto") > version)
            parts.append((tail if upto is None else tail.filter(F.col("upto") <= upto)).drop("upto"))
        return parts

    def read(self) -> DataFrame:
        """One state for each key, over all batches; an error if there is none."""
        parts = self._parts()
        if not parts:
            raise FileNotFoundError(f"no batch in {self.path}")
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.view.merge(both)

    def compact(self, upto: int) -> int:
        """Fold the batches up to ``upto`` into a new snapshot; return its version.

        Batches up to ``upto`` must be finished, for a later change of one would not be seen. Until the
        commit is written readers use the snapshot before, so a compaction that fails leaves nothing
        behind but files, which its next run replaces.
        """
        version = self.version()
        if upto <= version:
            return version
        parts = self._parts(upto)
        if not parts:
            return version
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        bucket = F.pmod(F.xxhash64(self.view.key), F.lit(BUCKETS)).alias("bucket")
        merged = self.view.merge(both).select("*", bucket)
        # A bucket is as many tasks and files as its size asks for.
        merged.repartitionByRange("bucket", self.view.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/upto={upto}")
        self.spark.range(1).select(F.lit(upto).alias("last")).write.mode("overwrite").parquet(f"{self.path}/commits/upto={upto}")
        return upto

    def vacuum(self) -> list[str]:
        """Drop what the last snapshot has made needless: its batches and the snapshots before. No reader may be at them."""
        version = self.version()

        def old(name: str) -> bool:
            return name.startswith("upto=") and int(name[5:]) <= version

        gone = drop_folders(self.spark, f"{self.path}/batch", old)
        return gone + drop_folders(self.spark, f"{self.path}/snapshot", lambda name: old(name) and int(name[5:]) < version)


def write_views(stream: DataFrame, folder: str, checkpoint: str, every: int = 24, views: tuple[View, ...] = VIEWS) -> StreamingQuery:
    """Keep ``views`` up to date with ``stream``, and its rows by day in ``folder``/recent_events.

    Before every ``every``-th batch the batches before it, which are finished, are compacted. A batch that
    is run again replaces its own folders, so nothing counts twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for view in views:
            kept = MaintainedView(batch.sparkSession, folder, view)
            if batch_id and batch_id % every == 0:
                kept.compact(batch_id - 1)
            kept.put(batch, batch_id)
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(f"{folder}/recent_events")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").start()
