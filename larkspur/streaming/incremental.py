"""Streams without duplicates, their daily partials and windows, and the expiry of old folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.metrics import daily_partials
from larkspur.schema import only_once
from larkspur.streaming.folders import drop_folders, folders


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).parquet(folder)


def distinct_events(stream: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("tenant_id", "event_id")) -> DataFrame:
    """Rows without those whose keys came before within ``delay``; the state that is kept ends with it.

    Rows whose event_id is null or '' are no repeats of each other: all stay.
    """
    marked = stream.withWatermark("timestamp", delay).withColumn("_only", only_once())
    return marked.dropDuplicatesWithinWatermark([*keys, "_only"]).drop("_only")


def write_partials(stream: DataFrame, path: str, checkpoint: str, kind: str = "event_type") -> StreamingQuery:
    """Append each micro-batch's daily partials to ``path``/batch=<id>; readers merge them.

    A batch that is run again after a failure replaces its own folder, so nothing counts twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        daily_partials(batch, kind).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").start()


def expire_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Drop the day folders (event_date=...) of a short-lived copy that lie before ``before``."""
    return drop_folders(spark, path, lambda name: name.startswith("event_date=") and name[11:] < before)


def windowed_activity(stream: DataFrame, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Events and approximate users by window and event_type; a window is final ``delay`` after its end."""
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users"))
        .select(F.col("window.start").alias("start"), "event_type", "events", "users")
    )


def recent(events: DataFrame, days: int = 7, as_of: str | None = None) -> DataFrame:
    """The rows of the last ``days`` days: what a short-lived copy of the table would hold."""
    now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    return events.filter(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def expire(spark: SparkSession, path: str, before_month: str) -> list[str]:
    """Drop the month folders (yyyyMM) of a partitioned event table that lie before ``before_month``."""
    tenants = [t for t in folders(spark, path) if "=" in t]
    old = [drop_folders(spark, f"{path}/{t}", lambda name: name.startswith("event_month=") and name[12:] < before_month) for t in tenants]
    return sorted(month for months in old for month in months)
