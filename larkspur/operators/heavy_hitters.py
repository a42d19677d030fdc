"""Most frequent items from mergeable summaries of bounded size, with bounds that always hold.

A summary of a key (a day of a tenant, say) lists at most ``size`` items. For each listed item

    low                 its weight is at least this
    low ... above+rest  and at most above + rest,

where ``rest`` is the sum of ``above`` over the summary's rows that are not ``listed``; no unlisted item weighs
more than ``rest``. Summaries merge by adding low and above row by row, so days merge to months and batches to
days, in any order. A merged summary is cut to its ``size`` items of greatest bound again; what the cut takes from
an item's ``above`` it adds to ``rest``. If no summary was ever cut, low is the upper bound too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of a summary. A summary's rest is at most its whole weight / SIZE for each cut that it has been through.
SIZE = 1_000


def _cut(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """At most ``size`` listed rows for each of ``keys``.

    Only the first size + 1 rows of a key leave a task (Spark's limit on ranks goes before the shuffle), so a
    key with any number of items stays small.
    """
    if size < 1:
        raise ValueError("size must be positive")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "listed").orderBy(F.desc("above"), F.desc("low"), "item")))
    few = ranked.filter(F.col("place") <= size + 1)
    last = F.col("listed") & (F.col("place") == size + 1)
    off = F.coalesce(F.max(F.when(last, F.col("above"))).over(Window.partitionBy(*keys)), F.lit(0))
    kept = few.select(*keys, (F.col("listed") & ~last).alias("listed"), F.when(~last, F.col("item")).alias("item"), F.when(last, F.lit(0)).otherwise(F.col("low")).alias("low"), "above", last.alias("last"), off.alias("off"))
    return kept.select(*keys, "listed", "item", "low", (F.col("above") - F.when(F.col("listed"), F.col("off")).otherwise(F.lit(0))).alias("above"))


def item_summaries(events: DataFrame, *keys: str, item: str = "event_name", weight: Column | None = None, size: int = SIZE) -> DataFrame:
    """keys, listed, item, low, above: the summary of each of ``keys`` over the rows of ``events``.

    weight: what a row adds, not negative (default 1; null adds nothing). Rows with a null item take no part. The
    weights of a key and item are added on the map side first, so a frequent one meets no single task.
    """
    counts = events.filter(F.col(item).isNotNull()).groupBy(*keys, F.col(item).alias("item")).agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0)).alias("low"))
    return _cut(counts.select(*keys, F.lit(True).alias("listed"), "item", "low", F.col("low").alias("above")), list(keys), size)


def merge_summaries(summaries: DataFrame, *keys: str, size: int = SIZE) -> DataFrame:
    """Summaries of finer keys or of batches, merged to ``keys`` and cut to ``size`` items."""
    added = summaries.groupBy(*keys, "listed", "item").agg(F.sum("low").alias("low"), F.sum("above").alias("above"))
    return _cut(added, list(keys), size)


def top_items(summaries: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, rank, item, low, high, certain: the ``k`` items of greatest low of each of ``keys``.

    summaries: merged to these keys. certain: the item is among the k heaviest of all whatever its weight and
    the others' are within their bounds (where weights are equal, among some k of them).
    """
    if k < 1:
        raise ValueError("k must be positive")
    whole = Window.partitionBy(*keys)
    bounds = summaries.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("listed"), F.col("above"))).over(whole), F.lit(0))).filter("listed")
    high = bounds.select(*keys, "item", "low", (F.col("above") + F.col("rest")).alias("high"), "rest")
    by_high, by_low = Window.partitionBy(*keys).orderBy(F.desc("high"), F.desc("low"), "item"), Window.partitionBy(*keys).orderBy(F.desc("low"), F.desc("high"), "item")
    placed = high.withColumns({"place": F.row_number().over(by_high), "rank": F.row_number().over(by_low)})
    # The weight that k others cannot exceed: the next upper bound behind k, or behind k - 1 others for an item that is not among them.
    behind = {n: F.coalesce(F.max(F.when(F.col("place") == n, F.col("high"))).over(whole), F.lit(0)) for n in (k, k + 1)}
    limit = F.greatest("rest", F.when(F.col("place") <= k, behind[k + 1]).otherwise(behind[k]))
    return placed.withColumn("certain", F.col("low") >= limit).filter(F.col("rank") <= k).select(*keys, "rank", "item", "low", "high", "certain")
