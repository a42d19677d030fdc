"""Retention: calendar matrices and curves by cohort."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import periods_between, start_of
from larkspur.schema import identified, normalize_events


def _in_range(events: DataFrame, tenant_id: str, start: str, end: str) -> DataFrame:
    return identified(events).filter((F.col("tenant_id") == tenant_id) & F.col("event_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def _condition(event_filter: str | Column | None, ai_only: bool) -> Column:
    """Whether a row meets the filter; a null answer is no."""
    condition = F.lit(True)
    if event_filter is not None:
        condition = F.expr(event_filter) if isinstance(event_filter, str) else event_filter
    return F.coalesce(condition & (F.col("ai_model") != "") if ai_only else condition, F.lit(False))


def period_flags(events: DataFrame, tenant_id: str, start: str, end: str, period: str, num_periods: int, enters: Column, week_start: str) -> DataFrame:
    """user_id, cohort_date, p0 ... : whether the user was active in each period of the cohort's calendar.

    ``enters`` decides which rows bring a user into a cohort and when; any activity counts as a return. One
    scan: rows are folded to (user, day), with a mark if a row of the day enters, and these to users.
    """
    days = _in_range(events, tenant_id, start, end).groupBy("user_id", "event_date").agg(F.max(enters).alias("enters"))
    users = days.groupBy("user_id").agg(F.min(F.when(F.col("enters"), F.col("event_date"))).alias("first"), F.collect_list("event_date").alias("dates"))
    users = users.filter(F.col("first").isNotNull()).withColumn("cohort_date", start_of(period, F.col("first"), week_start))
    users = users.withColumn("at", F.transform("dates", lambda d: periods_between(period, F.col("cohort_date"), d)))
    return users.select("user_id", "cohort_date", *[F.array_contains("at", F.lit(i).cast(users.schema["at"].dataType.elementType)).cast("int").alias(f"p{i}") for i in range(num_periods)])


def retention_matrix(events: DataFrame, tenant_id: str, start: str, end: str, period: str = "week", num_periods: int = 8, event_filter: str | Column | None = None, ai_only: bool = False, week_start: str = "sunday") -> DataFrame:
    """cohort_date, cohort_size, retention_array (users active in period i of their cohort)."""
    rows = events.filter(_condition(event_filter, ai_only))
    flags = period_flags(rows, tenant_id, start, end, period, num_periods, F.lit(True), week_start)
    sums = F.array(*[F.sum(f"p{i}") for i in range(num_periods)])
    return flags.groupBy("cohort_date").agg(F.count(F.lit(1)).alias("cohort_size"), sums.alias("retention_array")).orderBy("cohort_date")


def retention_simple(events: DataFrame, tenant_id: str, start: str, end: str, period: str = "week", num_periods: int = 8, event_filter: str | Column | None = None, ai_only: bool = False, week_start: str = "sunday") -> DataFrame:
    """cohort_date, cohort_size, period_0 ...; the filter is applied to the cohorts only."""
    flags = period_flags(events, tenant_id, start, end, period, num_periods, _condition(event_filter, ai_only), week_start)
    return flags.groupBy("cohort_date").agg(F.count(F.lit(1)).alias("cohort_size"), *[F.sum(f"p{i}").alias(f"period_{i}") for i in range(num_periods)]).orderBy("cohort_date")


def retention_curves(events: DataFrame, periods: list[int] | None = None, cohort_column: str | None = None) -> DataFrame:
    """cohort_key, cohort_size, retained_<p> for each period, rate_<p>.

    A user is retained at p if active p or more days after the first day and before the next period
    of the list; the last period has no end. Cohorts: the Monday of the first week, or the first
    value of ``cohort_column`` (null is a cohort). Two shuffles, whatever the number of periods.
    """
    periods = periods or [1, 7, 30, 90]
    rows = identified(normalize_events(events))
    by_column = cohort_column is not None and cohort_column in rows.columns
    # Fold to days first: later steps see at most one row per user and day.
    days = rows.groupBy("user_id", "event_date").agg(*([F.min(F.struct(F.col(cohort_column).isNull(), cohort_column)).alias("_first")] if by_column else [F.count(F.lit(1)).alias("_n")]))
    value = F.min_by(F.col("_first")[cohort_column], "event_date") if by_column else F.lit(None)
    users = days.groupBy("user_id").agg(F.min("event_date").alias("first"), F.collect_set("event_date").alias("dates"), value.alias("_value"))
    users = users.withColumn("cohort_key", F.col("_value").cast("string") if by_column else start_of("week", F.col("first")))

    def flag(i: int) -> Column:
        low, high = periods[i], periods[i + 1] if i + 1 < len(periods) else None
        return F.exists("dates", lambda d: (F.date_diff(d, "first") >= low) & (F.lit(True) if high is None else F.date_diff(d, "first") < high)).cast("int")

    flags = users.select("cohort_key", *[flag(i).alias(f"f{i}") for i in range(len(periods))])
    sums = [F.sum(f"f{i}").alias(f"retained_{p}") for i, p in enumerate(periods)]
    out = flags.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("cohort_size"), *sums)
    return out.withColumns({f"rate_{p}": F.col(f"retained_{p}") / F.col("cohort_size") for p in periods}).orderBy("cohort_key")


def retention_summary(events: DataFrame, periods: list[int] | None = None, cohort_column: str | None = None, min_cohort_size: int = 10, max_cohorts: int = 10_000) -> dict:
    """The JSON form: overall rates, cohorts, best and worst cohort (of at least ``min_cohort_size`` users).

    Overall sums, best and worst are aggregated in Spark; at most ``max_cohorts`` cohorts are listed.
    """
    periods = periods or [1, 7, 30, 90]
    curves = retention_curves(events, periods, cohort_column).persist()
    last, dimension = f"rate_{periods[-1]}", cohort_column if cohort_column and cohort_column in events.columns else "signup_week"
    sums = curves.agg(F.sum("cohort_size").alias("n"), *[F.sum(f"retained_{p}").alias(f"r{p}") for p in periods]).first()
    span = identified(normalize_events(events)).agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
    total = sums["n"] or 0

    def label(key: object) -> str:
        return "None" if key is None else str(key)

    def entry(row) -> dict:  # noqa: ANN001
        return {"key": label(row["cohort_key"]), "dimension": dimension, f"D{periods[-1]}": round(row[last], 4)}

    large = curves.filter(F.col("cohort_size") >= min_cohort_size)
    best = large.orderBy(F.desc(last), F.col("cohort_key").asc_nulls_last()).limit(1).collect()
    worst = large.orderBy(F.asc(last), F.col("cohort_key").asc_nulls_last()).limit(1).collect()
    listed = curves.limit(max_cohorts).collect()
    curves.unpersist()
    return {
        "metric": "retention", "date_range": {"start": str(span["a"] or date.today()), "end": str(span["b"] or date.today())}, "total_users": total, "periods": periods,
        "overall_retention": {f"D{p}": round(sums[f"r{p}"] / total, 4) if total else 0.0 for p in periods},
        "cohorts": [{"key": label(r["cohort_key"]), "dimension": dimension, "size": r["cohort_size"], "retention": {f"D{p}": round(r[f"rate_{p}"], 4) for p in periods}} for r in listed],
        "best_cohort": entry(best[0]) if best else None, "worst_cohort": entry(worst[0]) if worst else None,
    }
