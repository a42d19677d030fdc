"""Event files: JSON lines, commerce CSV, Parquet; user sampling; feedback sink."""

from __future__ import annotations

import json
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A usual bound for interactive use; sampling happens only where a bound is given.
MAX_USERS = 200_000
ANALYSIS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("event_date", T.DateType()), T.StructField("event_name", T.StringType())])
_LINE = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "distinct_id", "event_date", "timestamp", "event_name", "event", "_corrupt")])
COMMERCE = T.StructType([T.StructField(n, T.StringType()) for n in ("event_time", "event_type", "order_id", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")])


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANALYSIS)


def parse_jsonl(lines: DataFrame, extra: T.StructType | None = None) -> DataFrame:
    """user_id, event_date, event_name (and ``extra`` fields) from a ``value`` column of JSON lines.

    user_id or distinct_id; the first ten characters of event_date or timestamp; event_name or event.
    Blank and malformed lines and lines without a date are left out.
    """
    fields = T.StructType([*_LINE.fields, *(f for f in (extra or T.StructType()).fields if f.name not in _LINE.names)])
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    day = F.to_date(F.try_to_timestamp(F.substring(F.coalesce("j.event_date", "j.timestamp"), 1, 10), F.lit("yyyy-MM-dd")))
    rows = parsed.filter(F.col("j").isNotNull() & F.col("j._corrupt").isNull()).select(
        F.coalesce("j.user_id", "j.distinct_id", F.lit("")).alias("user_id"), day.alias("event_date"), F.coalesce("j.event_name", "j.event", F.lit("")).alias("event_name"), *[F.col(f"j.{f.name}") for f in (extra or T.StructType()).fields if f.name not in _LINE.names]
    )
    return rows.filter(F.col("event_date").isNotNull())


def read_jsonl(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    return parse_jsonl(spark.read.text(path), extra)


def sample_users(events: DataFrame, max_users: int = MAX_USERS) -> DataFrame:
    """All rows of ``max_users`` users, chosen by a seeded hash of the id (a sampling operator); all rows if there are no more."""
    users = events.select("user_id").distinct().orderBy(F.xxhash64("user_id", F.lit(42)), "user_id").limit(max_users)
    return events.join(users, "user_id", "left_semi")


def read_commerce_csv(spark: SparkSession, path: str, max_users: int | None = None) -> DataFrame:
    """Commerce CSV as the analysis frame, of ``max_users`` users if that is given; only the columns that are used are parsed."""
    names = spark.read.option("header", True).csv(path).columns if Path(path.removeprefix("file://")).exists() or "://" in path else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] or COMMERCE.fields)
    events = _commerce_days(spark.read.schema(schema).option("header", True).csv(path))
    return sample_users(events, max_users) if max_users else events


def _commerce_days(rows: DataFrame) -> DataFrame:
    day = F.to_date(F.try_to_timestamp(F.substring("event_time", 1, 10), F.lit("yyyy-MM-dd")))
    return rows.select("user_id", day.alias("event_date"), F.col("event_type").alias("event_name")).filter("event_date is not null")


def parse_commerce_csv(lines: DataFrame) -> DataFrame:
    """The analysis frame from a ``value`` column of commerce CSV lines without a header."""
    return _commerce_days(lines.select(F.from_csv("value", F.lit(COMMERCE.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))).alias("r")).select("r.*"))


def commerce_to_events(rows: DataFrame) -> DataFrame:
    """Each row as its event, and each view of a category also as browse_<top category>."""
    category = F.split(F.coalesce("category_code", F.lit("")), r"\.")[0]
    names = F.array_compact(F.array("event_type", F.when((F.col("event_type") == "view") & (category != ""), F.concat(F.lit("browse_"), category))))
    day = F.to_date(F.try_to_timestamp(F.substring("event_time", 1, 10), F.lit("yyyy-MM-dd")))
    return rows.select("user_id", day.alias("event_date"), F.explode(names).alias("event_name")).filter("event_date is not null")


def write_jsonl(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct("user_id", "event_date", "event_name")).alias("value")).write.text(path)


def load_events(spark: SparkSession, path: str, max_users: int | None = None) -> DataFrame:
    """Read by suffix: .jsonl/.ndjson/.json, .csv, else Parquet; a missing local file gives the empty frame. CSV: of ``max_users`` users, if given."""
    if "://" not in path and not Path(path).exists():
        return empty_events(spark)
    if path.endswith((".jsonl", ".ndjson", ".json")):
        return read_jsonl(spark, path)
    return read_commerce_csv(spark, path, max_users) if path.endswith(".csv") else spark.read.parquet(path)


def demo_events(spark: SparkSession, users: int = 500, days: int = 90, start: str = "2026-01-01", seed: int = 42) -> DataFrame:
    """A seeded fixture with a good feature, a bad one and decaying activity."""
    u = spark.range(users).select(F.col("id").alias("u"), (F.rand(seed) * 30).cast("int").alias("offset"), F.rand(seed + 1).alias("kind"))
    rows = u.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    stay = F.when(F.col("kind") < 0.3, 0.5).when(F.col("kind") < 0.5, 0.1).otherwise(0.25)
    active = rows.filter((F.col("day") == 0) | (F.rand(seed + 2) < F.greatest(F.lit(0.02), stay * (1 - F.col("day") / days))))
    name = F.when((F.col("kind") < 0.3) & (F.col("day") <= 5), "good_feature").when((F.col("kind") < 0.5) & (F.col("kind") >= 0.3), "bad_feature").when(F.rand(seed + 3) < 0.5, "search").otherwise("dashboard")
    return active.select(F.concat(F.lit("u"), "u").alias("user_id"), F.date_add(F.to_date(F.lit(start)), (F.col("offset") + F.col("day")).cast("int")).alias("event_date"), name.alias("event_name"))


VOTES = ("useful", "not_useful")


def append_feedback(path: str, insight_rank: int, vote: str, tenant_id: str = "default", comment: str = "") -> dict:
    """Append one vote, with today's date, as a JSON line; any other vote is an error. Missing folders are made."""
    if vote not in VOTES:
        raise ValueError(f"vote must be one of {VOTES}")
    entry = {"tenant_id": tenant_id, "insight_rank": insight_rank, "vote": vote, "timestamp": date.today().isoformat()} | ({"comment": comment} if comment else {})
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps(entry) + "\n")
    return entry
