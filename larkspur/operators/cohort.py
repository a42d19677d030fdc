"""Cohort summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import start_of
from larkspur.functions.text import slug
from larkspur.schema import identified

MODES = ("first_seen_day", "first_seen_week", "first_seen_month", "first_event", "property")


class Cohorts:
    """Users of one tenant and date range, by first period seen, first event, or a property's first value."""

    def __init__(self, events: DataFrame, tenant_id: str, start_date: str, end_date: str, cohort_by: str = "first_seen_week", property_key: str | None = None, event_filter: str | Column | None = None, limit: int = 20, as_of: str | None = None):
        if cohort_by not in MODES:
            raise ValueError(f"cohort_by must be one of {MODES}")
        if cohort_by == "property" and not property_key:
            raise ValueError("property cohorts need a property_key")
        self.base = identified(events).filter((F.col("tenant_id") == tenant_id) & F.col("event_date").between(F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date))))
        self.rows = self.base
        if event_filter is not None:
            self.rows = self.base.filter(F.expr(event_filter) if isinstance(event_filter, str) else event_filter)
        self.mode, self.key, self.limit = cohort_by, property_key, limit
        self.today = F.to_date(F.lit(as_of)) if as_of else F.current_date()
        self.label = {"first_event": "first_event", "property": f"property_{slug(property_key or '')}"}.get(cohort_by, "cohort_date")

    def _value(self) -> Column:
        """The cohort of a user, as an aggregate; the earliest event decides, equal times by event_id."""
        order = F.struct("timestamp", "event_id")
        if self.mode == "first_event":
            return F.min_by("event_name", order)
        if self.mode == "property":
            return F.min_by(F.coalesce(F.col("user_properties_set")[self.key], F.lit("")), order)
        return start_of(self.mode.removeprefix("first_seen_"), F.min("event_date"), "sunday")

    def summary(self) -> DataFrame:
        """Per cohort: size, averages per user, and users active in the last seven days; largest first."""
        users = self.rows.groupBy("user_id").agg(
            self._value().alias(self.label), F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("ai_model") != "").alias("ai"),
            F.count_distinct("event_name").alias("names"), F.count_distinct("session_id").alias("sessions"),
        )
        return (
            users.groupBy(self.label)
            .agg(
                F.count(F.lit(1)).alias("cohort_size"), F.avg("events").alias("avg_events_per_user"), F.avg("ai").alias("avg_ai_events_per_user"), F.avg("names").alias("avg_distinct_events"), F.avg("sessions").alias("avg_sessions"),
                F.avg(F.date_diff("last", "first")).alias("avg_lifespan_days"), F.count_if(F.col("last") >= F.date_sub(self.today, 7)).alias("active_last_7d"),
            )
            .orderBy(F.desc("cohort_size"), F.col(self.label).asc())
            .limit(self.limit)
        )

    def comparison(self, metric_event: str) -> DataFrame:
        """cohort_value, cohort_size, metric_events, users_with_metric, metric_rate (events per user).

        The event filter decides cohorts only. One pass: a user's metric events are counted beside
        the cohort where there is no filter, else joined.
        """
        metric = F.count_if(F.col("event_name") == metric_event).alias("metric")
        if self.rows is self.base:
            users = self.rows.groupBy("user_id").agg(self._value().alias("cohort_value"), metric)
        else:
            counts = self.base.groupBy("user_id").agg(metric)
            users = self.rows.groupBy("user_id").agg(self._value().alias("cohort_value")).join(counts, "user_id")
        grouped = users.groupBy("cohort_value").agg(F.count(F.lit(1)).alias("cohort_size"), F.sum("metric").alias("metric_events"), F.count_if(F.col("metric") > 0).alias("users_with_metric"))
        rated = grouped.withColumn("metric_rate", F.col("metric_events") / F.greatest(F.col("cohort_size"), F.lit(1)))
        return rated.orderBy(F.desc("cohort_size"), "cohort_value").limit(self.limit)
