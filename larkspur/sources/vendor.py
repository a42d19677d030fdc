"""Vendor event payloads as canonical events, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.schema import EVENT, only_once, with_missing

# The vendor's names and what they stand for.
EVENT_TYPE_OF = {"$pageview": "pageview", "$pageleave": "pageview", "$screen": "pageview", "$identify": "identify", "$groupidentify": "group_identify"}
DEVICE_OF = {"Desktop": "desktop", "Mobile": "mobile", "Tablet": "tablet"}
CORE_KEYS = (
    "$current_url", "$pathname", "$referrer", "$session_id", "$os", "$browser", "$device_type", "$browser_version", "$os_version",
    "$utm_source", "$utm_medium", "$utm_campaign", "$utm_term", "$utm_content", "$set", "$set_once", "$group_type", "$group_key", "$lib", "$lib_version",
)
#: Core keys that have no canonical field.
HOMELESS = ("$os", "$browser", "$browser_version", "$os_version", "$lib", "$lib_version")
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _lookup(table: dict[str, str], c: Column, default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def timestamp_of(text: Column) -> Column:
    """ISO-8601 text, epoch milliseconds as text, or now."""
    millis = F.when(text.rlike(r"^-?\d{9,}(\.\d+)?$"), F.timestamp_millis(F.floor(text.try_cast("double")).cast("long")))
    return F.coalesce(millis, F.try_to_timestamp(text), F.current_timestamp())


def map_vendor_events(rows: DataFrame, tenant_id: str, keep_all: bool = False) -> DataFrame:
    """Canonical events from uuid, event, distinct_id, timestamp (text), properties (JSON text, map or null).

    Bad JSON counts as no properties; nested values become JSON text, booleans true/false, nulls ''.
    keep_all also keeps the core keys that have no canonical field.
    """
    raw = F.col("properties")
    kind = rows.schema["properties"].dataType
    parsed = F.from_json(raw, _TEXT_MAP) if isinstance(kind, T.StringType) else raw.cast(_TEXT_MAP)
    p = F.transform_values(F.coalesce(parsed, F.create_map().cast(_TEXT_MAP)), lambda k, v: F.coalesce(v, F.lit("")))
    df = rows.withColumn("_p", p)

    def prop(key: str) -> Column:
        return F.coalesce(F.col("_p")[key], F.lit(""))

    def nested(key: str) -> Column:
        inner = F.from_json(F.col("_p")[key], _TEXT_MAP)
        return F.coalesce(F.transform_values(inner, lambda k, v: F.coalesce(v, F.lit(""))), F.create_map().cast(_TEXT_MAP))

    event = F.when(F.coalesce("event", F.lit("")) == "", "unknown").otherwise(F.col("event"))
    who = F.coalesce("distinct_id", F.lit(""))
    identify, anonymous = F.col("event") == "$identify", prop("$process_person_profile") == "false"
    index = F.when(prop("$group_type") != "", F.lit(-1))
    for i in range(5):
        index = index.when(prop(f"$group_{i}") != "", F.lit(i))
    named = F.col("_p")[F.concat(F.lit("$group_"), index.cast("string"))]
    core = [k for k in CORE_KEYS if not (keep_all and k in HOMELESS)]
    passed = F.map_filter("_p", lambda k, v: ~(k.startswith("$set") | k.startswith("$group") | k.isin(*core)))
    country = prop("$geoip_country_code")
    # The same row gets the same id whenever it is read: a retried task or page repeats no event.
    told = F.concat_ws("\x1f", F.coalesce("uuid", F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("event", "distinct_id", "timestamp")], F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_p")))))
    event_id = F.sha2(F.concat_ws("\x1f", F.lit(tenant_id), F.when(F.coalesce("uuid", F.lit("")) != "", F.col("uuid")).otherwise(told)), 256)
    fields = {
        "tenant_id": F.lit(tenant_id), "event_id": event_id, "user_id": F.when(identify, who).when(anonymous, "").otherwise(who), "anonymous_id": F.when(identify, prop("$anon_distinct_id")).when(anonymous, who).otherwise(""),
        "event_name": event, "event_type": _lookup(EVENT_TYPE_OF, F.coalesce("event", F.lit("")), "track"), "timestamp": timestamp_of(F.col("timestamp").cast("string")), "received_at": F.current_timestamp(),
        "session_id": prop("$session_id"), "page_url": prop("$current_url"), "page_path": prop("$pathname"), "referrer": prop("$referrer"), "locale": prop("$locale"), "country": F.when(F.length(country) == 2, F.upper(country)).otherwise(""),
        "device_type": _lookup(DEVICE_OF, prop("$device_type"), "unknown"), "source_system": F.lit("posthog"), "source_event_id": F.coalesce("uuid", F.lit("")),
        "group_type": F.when(index == -1, prop("$group_type")).when(index >= 0, F.concat(F.lit("group_"), index.cast("string"))).otherwise(""), "group_id": F.when(index == -1, prop("$group_key")).otherwise(F.coalesce(named, F.lit(""))),
        "utm_source": prop("$utm_source"), "utm_medium": prop("$utm_medium"), "utm_campaign": prop("$utm_campaign"), "utm_term": prop("$utm_term"), "utm_content": prop("$utm_content"),
        "properties": passed, "user_properties_set": nested("$set"), "user_properties_set_once": nested("$set_once"), "group_properties": F.when(F.col("event") == "$groupidentify", nested("$group_set")).otherwise(F.create_map().cast(_TEXT_MAP)),
    }
    return with_missing(df.select(*[c.alias(n) for n, c in fields.items()])).select(*EVENT.names)


def drop_repeats(events: DataFrame) -> DataFrame:
    """Without what a page boundary or a retry read twice: one row for each (tenant_id, event_id).

    map_vendor_events makes event_id of the source's id, or of the whole row where that has none, so rows without
    a source id are told apart by what they hold. Rows of other origin whose event_id is null or '' all stay.
    """
    return events.withColumn("_only", only_once()).dropDuplicates(["tenant_id", "event_id", "_only"]).drop("_only")
