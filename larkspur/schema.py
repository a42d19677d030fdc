"""The canonical event table: schema, validation, flattening, and adapters of other tables to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the event contract.
EVENT_TYPES = ("pageview", "identify", "track", "ai_generation", "ai_tool_call", "ai_retrieval", "session_start", "session_end", "group_identify")
DEVICE_TYPES = ("desktop", "mobile", "tablet", "server", "unknown")
SOURCE_SYSTEMS = ("posthog", "segment", "amplitude", "langfuse", "helicone", "warehouse", "custom")
LOCALE, COUNTRY = r"^[a-z]{2}(-[A-Z]{2})?$", r"^[A-Z]{2}$"

AI = T.StructType(
    [T.StructField(n, t) for n, t in (("model", T.StringType()), ("provider", T.StringType()), ("feature", T.StringType()), ("quality_score", T.DoubleType()), ("latency_ms", T.LongType()), ("tokens_in", T.LongType()), ("tokens_out", T.LongType()), ("cost_usd", T.DoubleType()), ("trace_id", T.StringType()), ("heal_triggered", T.BooleanType()), ("consensus_agreement", T.DoubleType()), ("verification_result", T.StringType()), ("generation_id", T.StringType()))]
)
_MAP = T.MapType(T.StringType(), T.StringType())
_TEXTS = ("session_id", "page_url", "page_path", "referrer", "locale", "country", "device_type", "source_system", "source_event_id", "group_type", "group_id", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")

#: One row per event, as sources deliver it; optional fields may be null.
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("tenant_id", "event_id", "user_id", "anonymous_id", "event_name", "event_type")]
    + [T.StructField("timestamp", T.TimestampType()), T.StructField("received_at", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField(n, _MAP) for n in ("properties", "user_properties_set", "user_properties_set_once", "group_properties")]
    + [T.StructField("ai", AI)]
)


def with_missing(df: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as nulls; other columns stay."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def has_identity() -> Column:
    return (F.coalesce("user_id", F.lit("")) != "") | (F.coalesce("anonymous_id", F.lit("")) != "")


def has_ai_context() -> Column:
    return F.col("ai").isNotNull()


def violations() -> Column:
    """An array with the names of the contract's rules that an event breaks; empty if it is valid."""

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    def outside(name: str, low: float | None = None, high: float | None = None) -> Column:
        c = F.col(name)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (c < low)
        if high is not None:
            bad = bad | (c > high)
        return c.isNotNull() & bad

    rules = {f"{n}_missing": missing(n) for n in ("tenant_id", "event_id", "event_name", "event_type", "timestamp", "source_system")}
    rules["identity"] = ~has_identity()
    rules["event_type"] = ~F.col("event_type").isin(*EVENT_TYPES)
    rules["device_type"] = ~F.coalesce("device_type", F.lit("unknown")).isin(*DEVICE_TYPES)
    rules["source_system"] = ~F.col("source_system").isin(*SOURCE_SYSTEMS)
    rules["locale"] = ~missing("locale") & ~F.col("locale").rlike(LOCALE)
    rules["country"] = ~missing("country") & ~F.col("country").rlike(COUNTRY)
    rules["ai_quality_score"] = outside("ai.quality_score", 0, 1)
    rules["ai_consensus_agreement"] = outside("ai.consensus_agreement", 0, 1)
    for name in ("latency_ms", "tokens_in", "tokens_out", "cost_usd"):
        rules[f"ai_{name}"] = outside(f"ai.{name}", 0)
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = with_missing(events).withColumn("violations", violations())
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def row_digest() -> Column:
    """A digest of all fields of EVENT but event_id and received_at; the order of a map's keys does not matter."""
    fields = [f for f in EVENT if f.name not in ("event_id", "received_at")]
    told = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in fields]
    return F.sha2(F.to_json(F.struct(*[c.alias(f.name) for c, f in zip(told, fields, strict=True)])), 256)


def only_once() -> Column:
    """A key that no other row has where event_id is absent (null or ''), null elsewhere: such rows are no repeats."""
    return F.when(F.coalesce("event_id", F.lit("")) == "", F.uuid(F.lit(7)))


def to_table_rows(events: DataFrame) -> DataFrame:
    """The flat event table: '' for absent texts, {} for absent maps, ai_* columns with ''/0, event_date.

    User and group properties and all utm fields are kept. An absent (null or '') event_id is a digest of all the other
    fields but received_at, so reading the row again gives the same one, and rows that differ anywhere have different ones.
    """
    df = with_missing(events)
    columns: list[Column] = []
    for f in EVENT:
        if f.name == "ai":
            for a in AI:
                if a.name in ("heal_triggered", "consensus_agreement", "verification_result", "generation_id"):
                    continue
                zero = F.lit("") if isinstance(a.dataType, T.StringType) else F.lit(0).cast(a.dataType)
                columns.append(F.coalesce(F.col(f"ai.{a.name}"), zero).alias(f"ai_{a.name}"))
        elif isinstance(f.dataType, T.MapType):
            columns.append(F.coalesce(F.col(f.name), F.create_map().cast(f.dataType)).alias(f.name))
        elif f.name == "event_id":
            columns.append(F.when(F.col("event_id") != "", F.col("event_id")).otherwise(row_digest()).alias("event_id"))
        elif f.name == "received_at":
            columns.append(F.coalesce("received_at", F.current_timestamp()).alias("received_at"))
        elif isinstance(f.dataType, T.StringType):
            columns.append(F.coalesce(F.col(f.name), F.lit("unknown" if f.name == "device_type" else "")).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns, F.to_date("timestamp").alias("event_date"))


def write_events(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the event table: Parquet by tenant and month, rows of neighbouring users together in a file.

    Rows are dealt by ranges of (tenant, month, user, time), so a large tenant's month is as many tasks
    and files as its size asks for, and a small one's is in one or two. Bloom filters on the ids that point
    lookups use; a reader's tenant and month predicates prune folders.
    """
    ready = rows.withColumn("event_month", F.date_format("event_date", "yyyyMM"))
    order = ["tenant_id", "event_month", "user_id", "timestamp"]
    ordered = ready.repartitionByRange(*order).sortWithinPartitions(*order, "event_id")
    writer = ordered.write.mode(mode).partitionBy("tenant_id", "event_month")
    for column in ("event_name", "user_id", "session_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def normalize_events(df: DataFrame) -> DataFrame:
    """The analysis frame: user_id string, event_date date, event_name; every other column unchanged.

    A text event_date is read from its first ten characters (null if they are no date).
    """
    fields = dict(df.dtypes)
    if fields["event_date"] == "string":
        df = df.withColumn("event_date", F.to_date(F.try_to_timestamp(F.substring("event_date", 1, 10), F.lit("yyyy-MM-dd"))))
    elif fields["event_date"] != "date":
        df = df.withColumn("event_date", F.to_date("event_date"))
    return df if fields["user_id"] == "string" else df.withColumn("user_id", F.col("user_id").cast("string"))


def identified(df: DataFrame) -> DataFrame:
    """Rows with a user: neither null nor ''."""
    return df.filter(F.col("user_id") != "")


# --- adapters of the star schema's tables ----------------------------------------------------


def from_stream_table(events: DataFrame, tenant: str = "t1") -> DataFrame:
    """The ``events`` table as flat event rows.

    Synthetic columns, all from the row itself: session_id is user and day; ai_model is 'm1' for even
    props.k and '' else; ai_feature is the event type of AI rows; ai_quality_score and ai_cost_usd are
    (k mod 10) / 10 and k / 1000 of AI rows, 0 else; source_system is 'custom'.
    """
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1))
    ai = k % 2 == 0
    at = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    return events.select(
        F.lit(tenant).alias("tenant_id"), F.col("event_id").cast("string").alias("event_id"), user.alias("user_id"), F.col("event_type").alias("event_name"), F.lit("track").alias("event_type"), at.alias("timestamp"), F.to_date(at).alias("event_date"),
        F.concat_ws("-", user, F.date_format(at, "yyyyMMdd")).alias("session_id"), F.lit("").alias("page_path"), F.lit("custom").alias("source_system"),
        F.when(ai, "m1").otherwise("").alias("ai_model"), F.when(ai, F.col("event_type")).otherwise("").alias("ai_feature"), F.when(ai, (k % 10) / 10).otherwise(0.0).alias("ai_quality_score"), F.when(ai, k / 1000).otherwise(0.0).alias("ai_cost_usd"),
    )


def from_orders(orders: DataFrame, tenant: str = "t1") -> DataFrame:
    """The ``orders`` table as flat event rows: customers order (event_name) with a priority.

    event_type is the order's status; user_properties_set has its priority; session_id is user and
    month; AI columns: 'm1' and total price / 1e6 for urgent orders, '' and 0 else.
    """
    at, user = F.col("o_orderdate").cast("timestamp"), F.col("o_custkey").cast("string")
    ai = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        F.lit(tenant).alias("tenant_id"), F.col("o_orderkey").cast("string").alias("event_id"), user.alias("user_id"), F.col("o_orderpriority").alias("event_name"), F.col("o_orderstatus").alias("event_type"), at.alias("timestamp"), F.to_date(at).alias("event_date"),
        F.concat_ws("-", user, F.date_format(at, "yyyyMM")).alias("session_id"), F.lit("").alias("page_path"), F.lit("warehouse").alias("source_system"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("user_properties_set"),
        F.when(ai, "m1").otherwise("").alias("ai_model"), F.when(ai, F.col("o_orderpriority")).otherwise("").alias("ai_feature"), F.when(ai, F.col("o_totalprice") / 1e6).otherwise(0.0).alias("ai_quality_score"), F.when(ai, F.col("o_totalprice") / 1e6).otherwise(0.0).alias("ai_cost_usd"),
    )
