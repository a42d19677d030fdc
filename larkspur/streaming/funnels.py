"""Ordered funnels on a stream: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.operators.funnel import Funnel
from larkspur.session import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FunnelProcessor(StatefulProcessor):
    """Levels of one user at a time.

    Rows wait until the watermark has passed them, for then no earlier row can come; they are taken in the
    order of (time, event_id), whatever batches they came in. Kept for a user are the waiting rows and, for
    each step, the latest start that reached it and is still open (not more than the window before the
    watermark). A user without either has no state.
    """

    def __init__(self, n_steps: int, window_micros: int):
        self.n, self.window = n_steps, window_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id string, steps int")
        self.open = handle.getValueState("open", ", ".join(f"s{i} long" for i in range(self.n)) + ", level int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        latest = 0
        for batch in rows:
            new = list(zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["steps"].tolist(), strict=True))
            latest = max(latest, *(at for at, _, _ in new))
            self.waiting.appendList(new)
        self.handle.registerTimer(self._timer(latest))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    @staticmethod
    def _timer(at: int) -> int:
        """The first millisecond behind a row's time."""
        return at // 1000 + 1

    def _advance(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        """Take the rows before the watermark; tell the level if it has risen."""
        starts, level = [None] * self.n, 0
        if self.open.exists():
            *starts, level = self.open.get()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] < watermark), key=lambda r: (r[0], r[1] is not None, r[1]))
        before = level
        for at, _, steps in ready:
            # From the last step down, so that a row does not continue itself.
            for i in range(self.n - 1, 0, -1):
                start = starts[i - 1]
                if steps >> i & 1 and start is not None and at <= start + self.window:
                    starts[i], level = start if starts[i] is None else max(starts[i], start), max(level, i + 1)
            if steps & 1:
                starts[0], level = at if starts[0] is None else max(starts[0], at), max(level, 1)
        starts = [s if s is not None and s + self.window >= watermark else None for s in starts]
        left = [r for r in rows if r[0] >= watermark]
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        last = max((s for s in starts if s is not None), default=None)
        if last is None:
            # Whoever reads the levels takes the highest, so forgetting it loses nothing.
            self.open.clear()
        else:
            self.open.update((*starts, level))
            self.handle.registerTimer(self._timer(last + self.window))
        if level > before:
            yield pd.DataFrame({"user_id": [key[0]], "max_step": [level]})


def funnel_levels(funnel: Funnel, delay: str = "1 hour") -> DataFrame:
    """user_id, max_step as they rise, from a funnel over a stream; a user's level is the highest told.

    A row may come ``delay`` late; later ones are dropped. The state of the stream has to be in RocksDB, which
    is set for the session if its provider is not. Rows count once the watermark has passed them, so the levels
    of the last ``delay`` are open.
    """
    spark = funnel.rows.sparkSession
    _prepare(spark)
    flags = [F.when(F.coalesce(s.column(), F.lit(False)), 1 << i).otherwise(0) for i, s in enumerate(funnel.steps)]
    rows = funnel.rows.withWatermark("timestamp", delay).select("user_id", "timestamp", "event_id", F.unix_micros("timestamp").alias("at"), sum(flags[1:], flags[0]).alias("steps")).filter("steps > 0")
    processor = FunnelProcessor(len(funnel.steps), funnel.window * 1_000_000)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id string, max_step int", "Append", "EventTime")


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    if "RocksDB" not in (spark.conf.get(_STORE, None) or ""):
        spark.conf.set(_STORE, _ROCKS)


def step_counts(levels: DataFrame, funnel: Funnel) -> DataFrame:
    """One row like Funnel.totals, from the levels that a stream has told so far."""
    return levels.groupBy("user_id").agg(F.max("max_step").alias("max_step")).agg(*funnel.counts())
