"""Exact distinct users from small mergeable cells: a dense dictionary of users, and bitmaps of their numbers.

A cell is (tenant_id, event_date, other keys, bucket) with a bitmap of 32,768 users (4 KB), so a day is
at most its users / 32,768 rows and a few more for each task that numbered them, and days merge to weeks or
months, kinds to days, without the raw pairs. Counts are exact, unlike those of sketches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schema import identified

#: Users of a cell (fixed by Spark's bitmap functions).
BITS = 32_768


def read_dictionary(spark: SparkSession, path: str, extension: int | None = None) -> DataFrame | None:
    """tenant_id, user_id, position (as it was with ``extension``); None before the first extension."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (found if extension is None else found.filter(F.col("extension") <= extension)).drop("extension")


def extend_dictionary(events: DataFrame, path: str) -> DataFrame:
    """Give every new identified user of ``events`` a number for good; return the dictionary with this extension.

    Numbers start at 1 and follow each other within a task's users; each extension starts in a bucket and a
    folder of its own. Only new users are written (one writer at a time), so events that are read again add nothing.
    """
    spark, users = events.sparkSession, identified(events).select("tenant_id", "user_id").distinct()
    known, start, extension = read_dictionary(spark, path), 1, 0
    if known is not None:
        last = spark.read.parquet(path).agg(F.coalesce(F.max("position"), F.lit(0)), F.coalesce(F.max("extension"), F.lit(-1))).first()
        start, extension = -(-last[0] // BITS) * BITS + 1, last[1] + 1
        users = users.join(known, ["tenant_id", "user_id"], "left_anti")
    users.withColumn("position", F.monotonically_increasing_id() + start).write.mode("overwrite").parquet(f"{path}/extension={extension}")
    return read_dictionary(spark, path, extension)


def daily_bitmaps(events: DataFrame, dictionary: DataFrame, *keys: str) -> DataFrame:
    """tenant_id, event_date, keys, bucket, users (bitmap) of the identified users of ``events``.

    Users are folded to days before they meet the dictionary, so the join sees a user once a day at most
    (and key), however many events they have.
    """
    who = ["tenant_id", "event_date", *keys, "user_id"]
    numbered = identified(events).select(*who).distinct().join(dictionary, ["tenant_id", "user_id"])
    return numbered.groupBy("tenant_id", "event_date", *keys, F.bitmap_bucket_number("position").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("users"))


def merge_bitmaps(cells: DataFrame, *keys: str | Column) -> DataFrame:
    """Cells merged to (tenant_id, keys, bucket): users of any of them."""
    return cells.groupBy("tenant_id", *keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def count_users(cells: DataFrame, *keys: str) -> DataFrame:
    """tenant_id, keys, users: exact distinct users of cells that are merged to these keys."""
    return cells.groupBy("tenant_id", *keys).agg(F.sum(F.bitmap_count("users")).alias("users"))


def active_users(cells: DataFrame, period: Column) -> DataFrame:
    """tenant_id, start, users: exact active users of each period, an expression of event_date."""
    return count_users(merge_bitmaps(cells, period.alias("start")), "start")


def returning_users(cells: DataFrame, after_days: int) -> DataFrame:
    """tenant_id, event_date, users, returned: of each day's users those active exactly ``after_days`` days later too.

    A day meets the later day cell by cell; both are in one group by (day, bucket), without a self-join.
    """
    if after_days < 1:
        raise ValueError("after_days must be positive")
    days = merge_bitmaps(cells, "event_date")
    sides = F.explode(F.array(F.struct(F.col("event_date"), F.lit(0).alias("later")), F.struct(F.date_sub("event_date", after_days).alias("event_date"), F.lit(1).alias("later"))))
    pairs = days.select("tenant_id", "bucket", "users", sides.alias("at")).groupBy("tenant_id", "at.event_date", "bucket").agg(
        F.bitmap_and_agg("users").alias("both"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("at.later") == 0, F.bitmap_count("users"))).alias("own")
    )
    out = pairs.groupBy("tenant_id", "event_date").agg(F.sum("own").alias("users"), F.coalesce(F.sum(F.when(F.col("n") == 2, F.bitmap_count("both"))), F.lit(0)).alias("returned"))
    return out.filter("users is not null")
