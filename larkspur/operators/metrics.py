"""Pre-aggregated metrics: mergeable daily partials and the reports that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.schema import identified


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _is_ai() -> Column:
    return F.col("ai_model") != ""


def daily_partials(events: DataFrame, kind: str = "event_type", sketch: bool = True) -> DataFrame:
    """Mergeable states: counts, sums, and what tells distinct users and sessions.

    sketch: one row for each (tenant_id, event_date, kind) with HyperLogLog binaries (bounded size, about
    1.6 % error). Else exact: one row for each of these and (user_id, session_id), so that no cell holds all
    users of a day. No user filter: the empty user counts as one, as in the inserted-row states.
    """
    q, cost = F.col("ai_quality_score"), F.col("ai_cost_usd")
    keys, states = ["tenant_id", "event_date", kind], []
    if sketch:
        states = [F.hll_sketch_agg("user_id").alias("users"), F.hll_sketch_agg("session_id").alias("sessions")]
    else:
        keys += ["user_id", "session_id"]
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *states, F.count_if(_is_ai()).alias("ai_n"), F.sum(_if(q > 0, q)).alias("quality_sum"), F.count_if(q > 0).alias("quality_n"), F.sum(_if(cost > 0, cost)).alias("cost_sum")
    )


def merge_daily(partials: DataFrame, keys: list[str], sketch: bool = True) -> DataFrame:
    """Merge daily states to ``keys``: events, users, sessions, ai_events, avg_ai_quality, total_ai_cost."""

    def merged(state: str, column: str) -> Column:
        return F.hll_sketch_estimate(F.hll_union_agg(state)) if sketch else F.count_distinct(column)

    return partials.groupBy(*keys).agg(
        F.sum("n").alias("events"), merged("users", "user_id").alias("users"), merged("sessions", "session_id").alias("sessions"), F.sum("ai_n").alias("ai_events"),
        F.try_divide(F.sum("quality_sum"), F.sum("quality_n")).alias("avg_ai_quality"), F.sum("cost_sum").alias("total_ai_cost"),
    )


def user_states(events: DataFrame) -> DataFrame:
    """Mergeable states of (tenant_id, user_id): least and greatest times and days, counts, sums, sorted sets."""
    q = F.col("ai_quality_score")
    return identified(events).groupBy("tenant_id", "user_id").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("event_date").alias("cohort_date"), F.max("event_date").alias("last_active_date"),
        F.count(F.lit(1)).alias("event_count"), F.count_if(_is_ai()).alias("ai_events_count"), F.sum(_if(q > 0, q)).alias("quality_sum"), F.count_if(q > 0).alias("quality_n"),
        F.sort_array(F.collect_set(_if(F.col("ai_feature") != "", F.col("ai_feature")))).alias("ai_features_used"), F.sort_array(F.collect_set("source_system")).alias("source_systems"),
    )


def profiles_of(states: DataFrame) -> DataFrame:
    """tenant_id, user_id, first_seen, last_seen, event_count, AI measures, features and sources (sorted arrays) of states with a row for each user."""
    quality = F.try_divide("quality_sum", "quality_n").alias("ai_avg_quality")
    return states.select("tenant_id", "user_id", "first_seen", "last_seen", "event_count", "ai_events_count", quality, "ai_features_used", "source_systems")


def cohorts_of(states: DataFrame) -> DataFrame:
    """tenant_id, user_id, cohort_date, last_active_date, lifetime_events of states with a row for each user."""
    return states.select("tenant_id", "user_id", "cohort_date", "last_active_date", F.col("event_count").alias("lifetime_events"))


def user_profiles(events: DataFrame) -> DataFrame:
    """profiles_of in one scan of the events."""
    return profiles_of(user_states(events))


def user_cohort_info(events: DataFrame) -> DataFrame:
    """cohorts_of in one scan of the events."""
    return cohorts_of(user_states(events))


def current_properties(events: DataFrame) -> DataFrame:
    """tenant_id, user_id, properties: the first value of each set-once key, overridden by the latest of each set key."""
    who = ["tenant_id", "user_id"]
    order = F.struct("timestamp", "event_id")

    def chosen(column: str, pick: Column) -> DataFrame:
        rows = identified(events).select(*who, order.alias("at"), F.explode(column).alias("name", "value"))
        return rows.groupBy(*who, "name").agg(pick.alias("value"))

    once = chosen("user_properties_set_once", F.min_by("value", "at")).withColumn("rank", F.lit(0))
    last = chosen("user_properties_set", F.max_by("value", "at")).withColumn("rank", F.lit(1))
    best = once.unionByName(last).groupBy(*who, "name").agg(F.max_by("value", "rank").alias("value"))
    return best.groupBy(*who).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("properties"))


class Metrics:
    """Reports over one tenant's events between two dates, both included."""

    def __init__(self, events: DataFrame, tenant_id: str, start_date: str, end_date: str):
        self.tenant = events.filter(F.col("tenant_id") == tenant_id)
        self.events = self.tenant.filter(F.col("event_date").between(F.to_date(F.lit(start_date)), F.to_date(F.lit(end_date))))

    def daily_active_users(self) -> DataFrame:
        return self.events.groupBy("event_date").agg(F.count_distinct("user_id").alias("dau"))

    def _usage(self, *keys: str) -> DataFrame:
        q, cost = F.col("ai_quality_score"), F.col("ai_cost_usd")
        return self.events.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_usage"), F.count_distinct("user_id").alias("unique_users"), F.count_if(_is_ai()).alias("ai_events"), F.avg(_if(q > 0, q)).alias("avg_ai_quality"), F.sum(_if(cost > 0, cost)).alias("total_ai_cost")
        )

    def daily_metrics_by_type(self) -> DataFrame:
        q = F.col("ai_quality_score")
        return self.events.groupBy("event_date", "event_type").agg(
            F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("session_id").alias("sessions"), F.count_if(_is_ai()).alias("ai_events"), F.avg(_if(q > 0, q)).alias("avg_ai_quality")
        )

    def feature_usage_ranking(self, limit: int = 50) -> DataFrame:
        columns = ("event_name", "unique_users", "total_usage", "ai_events", "avg_ai_quality", "total_ai_cost")
        return self._usage("event_name").select(*columns).orderBy(F.desc("unique_users"), "event_name").limit(limit)

    def feature_trend(self, event_name: str) -> DataFrame:
        one = Metrics.__new__(Metrics)
        one.events = self.events.filter(F.col("event_name") == event_name)
        return one._usage("event_date").select("event_date", "unique_users", "total_usage", "avg_ai_quality")

    def user_profile(self, user_id: str) -> DataFrame:
        return user_profiles(self.tenant.filter(F.col("user_id") == user_id))

    def user_cohort_info(self, user_id: str) -> DataFrame:
        return user_cohort_info(self.tenant.filter(F.col("user_id") == user_id))

    def overview(self) -> DataFrame:
        q = F.col("ai_quality_score")
        return self.events.agg(
            F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_id").alias("total_users"), F.count_distinct("session_id").alias("total_sessions"), F.count_if(_is_ai()).alias("total_ai_events"), F.avg(_if(q > 0, q)).alias("overall_avg_ai_quality")
        )

    def recent_events(self, limit: int = 100) -> DataFrame:
        """The latest events; equal times by event_id."""
        columns = ("timestamp", "event_name", "event_type", "user_id", "session_id", "page_path", "ai_model", "ai_feature", "ai_quality_score", "source_system")
        return self.events.orderBy(F.desc("timestamp"), "event_id").limit(limit).select(*columns)


def dau_series(events: DataFrame) -> DataFrame:
    """date, value: distinct identified users of each day."""
    return identified(events).groupBy(F.col("event_date").alias("date")).agg(F.count_distinct("user_id").cast("double").alias("value"))


def dau_points(events: DataFrame) -> DataFrame:
    """dau_series, or today with 0.0 if no day has a user."""
    series = dau_series(events)
    return series if series.take(1) else events.sparkSession.range(1).select(F.current_date().alias("date"), F.lit(0.0).alias("value"))
