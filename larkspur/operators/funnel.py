"""Ordered funnels inside a time window."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import slug
from larkspur.schema import identified

#: Steps that a funnel may have.
LEAST, MOST = 2, 20


@dataclass(frozen=True)
class Step:
    """An event name, or any condition (a Column or SQL text), under a label."""

    event_name: str | None = None
    condition: str | Column | None = None
    label: str | None = None

    def __post_init__(self) -> None:
        if not self.event_name and self.condition is None:
            raise ValueError("a step needs an event_name or a condition")

    @property
    def name(self) -> str:
        return self.label or self.event_name or "step"

    def column(self) -> Column:
        if self.condition is None:
            return F.col("event_name") == self.event_name
        test = F.expr(self.condition) if isinstance(self.condition, str) else self.condition
        return test if not self.event_name else (F.col("event_name") == self.event_name) & test


class Funnel:
    """How far users come through ``steps`` within ``window_seconds`` of a first step.

    A level is reached by a later row than the level before it, at most the window after the first
    step's time; the latest start that can still be continued counts. Rows of equal time go by
    event_id. All steps are one chain of running maxima over (user, time, event_id): one shuffle, one
    sort, whatever the number of steps.

    split_seconds: cut each user's rows at whole multiples of so many seconds, so that a user with a large
    part of all rows is many tasks' work; what a piece does to the levels is folded in time order. The
    results are the same.
    """

    def __init__(self, events: DataFrame, tenant_id: str, steps: list[Step], start_date: str, end_date: str, window_seconds: int = 604_800, segment: str | Column | None = None, split_seconds: int | None = None):
        if not LEAST <= len(steps) <= MOST:
            raise ValueError(f"a funnel has {LEAST} to {MOST} steps")
        if window_seconds <= 0:
            raise ValueError("window_seconds must be positive")
        if split_seconds is not None and split_seconds <= 0:
            raise ValueError("split_seconds must be positive")
        rows = identified(events).filter((F.col("tenant_id") == tenant_id) & F.col("event_date").between(F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date))))
        if segment is not None:
            rows = rows.filter(F.expr(segment) if isinstance(segment, str) else segment)
        self.rows, self.steps, self.window, self.split = rows, steps, window_seconds, split_seconds

    def labels(self) -> list[str]:
        return [f"step_{i}_{slug(s.name)}" for i, s in enumerate(self.steps, 1)]

    def levels(self, entry_date: bool = True) -> DataFrame:
        """user_id, max_step (0 without a first step) and entry_date: the user's first row of any kind.

        Without entry_date only rows of some step are read into the sort; users without any are left out.
        """
        df = self.flagged(entry_date)
        if self.split:
            return self._folded(df, entry_date)
        df = self._starts(df, "user_id")
        reached = [F.max(f"s{i}").isNotNull().cast("int") for i in range(1, len(self.steps) + 1)]
        first = [F.min("event_date").alias("entry_date")] if entry_date else []
        return df.groupBy("user_id").agg(*first, sum(reached[1:], reached[0]).alias("max_step"))

    def flagged(self, entry_date: bool = False) -> DataFrame:
        """user_id, event_id, at (microseconds), c1, c2, ... (whether the row is of the step); with entry_date all rows and their event_date."""
        flags = {f"c{i}": F.coalesce(s.column(), F.lit(False)) for i, s in enumerate(self.steps, 1)}
        rows = self.rows if entry_date else self.rows.filter(reduce(or_, flags.values()))
        return rows.select("user_id", *(["event_date"] if entry_date else []), "event_id", F.unix_micros("timestamp").alias("at"), *[c.alias(n) for n, c in flags.items()])

    def _starts(self, df: DataFrame, *keys: str) -> DataFrame:
        """df with s1, s2, ...: the latest start with which the row reaches the step, by chains within ``keys``."""
        before = Window.partitionBy(*keys).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("s1", F.when(F.col("c1"), F.col("at")))
        for i in range(2, len(self.steps) + 1):
            start = F.max(f"s{i - 1}").over(before)
            df = df.withColumn(f"s{i}", F.when(F.col(f"c{i}") & (F.col("at") <= start + self.window * 1_000_000), start))
        return df

    def _folded(self, df: DataFrame, entry_date: bool) -> DataFrame:
        """The levels from pieces of each user's time.

        Of a piece remain, for each step, the latest start inside it that reaches the step inside it, and, for
        each step i and later step j, the earliest time at which a user who came with step i has j: a start
        s of step i before the piece reaches j in it exactly if that time is s + window at most. Pieces are
        aggregated where they lie; a user's task folds one small row a piece.
        """
        n, split = len(self.steps), self.split * 1_000_000
        before = Window.partitionBy("user_id", "piece").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        df = self._starts(df.withColumn("piece", F.floor(F.col("at") / split)), "user_id", "piece")
        for i in range(1, n):
            df = df.withColumn(f"r{i}_{i + 1}", F.col(f"c{i + 1}"))
            for j in range(i + 2, n + 1):
                df = df.withColumn(f"r{i}_{j}", F.col(f"c{j}") & F.coalesce(F.max(f"r{i}_{j - 1}").over(before), F.lit(False)))
        pairs = [(i, j) for i in range(1, n) for j in range(i + 1, n + 1)]
        pieces = df.groupBy("user_id", "piece").agg(
            *([F.min("event_date").alias("first")] if entry_date else []),
            *[F.max(f"s{i}").alias(f"s{i}") for i in range(1, n + 1)],
            *[F.min(F.when(F.col(f"r{i}_{j}"), F.col("at"))).alias(f"e{i}_{j}") for i, j in pairs],
        )
        told = F.struct("piece", *[f"s{i}" for i in range(1, n + 1)], *[f"e{i}_{j}" for i, j in pairs])
        # The pieces of a user in order of time: the first field of the struct sorts them.
        first = [F.min("first").alias("entry_date")] if entry_date else []
        users = pieces.groupBy("user_id").agg(*first, F.array_sort(F.collect_list(told)).alias("pieces"))
        none = F.lit(None).cast("long")

        def after(levels: Column, piece: Column) -> Column:
            """The latest starts behind a piece, from those before it."""
            out = []
            for j in range(1, n + 1):
                carried = [F.when(piece[f"e{i}_{j}"] <= levels[f"l{i}"] + self.window * 1_000_000, levels[f"l{i}"]) for i in range(1, j)]
                out.append(F.greatest(levels[f"l{j}"], piece[f"s{j}"], *carried).alias(f"l{j}"))
            return F.struct(*out)

        ends = F.aggregate("pieces", F.struct(*[none.alias(f"l{i}") for i in range(1, n + 1)]), after)
        levels = users.withColumn("ends", ends)
        steps = sum((F.col(f"ends.l{i}").isNotNull().cast("int") for i in range(2, n + 1)), F.col("ends.l1").isNotNull().cast("int"))
        return levels.select("user_id", *(["entry_date"] if entry_date else []), steps.alias("max_step"))

    def counts(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("total_entered"), *[F.count_if(F.col("max_step") >= i).alias(n) for i, n in enumerate(self.labels(), 1)]]

    def totals(self) -> DataFrame:
        """One row: total_entered and the users who reached each step."""
        return self.levels(entry_date=False).filter("max_step >= 1").agg(*self.counts())

    def by_date(self) -> DataFrame:
        """The same for each entry_date."""
        return self.levels().filter("max_step >= 1").groupBy("entry_date").agg(*self.counts()).orderBy("entry_date")
