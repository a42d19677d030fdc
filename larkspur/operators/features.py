"""How the use of a feature goes with retention, raw and within weeks of equal tenure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import start_of
from larkspur.schema import identified, normalize_events
from larkspur.session import shared_folder

#: Weight of a period's impact in the net score; other periods weigh 1.
PERIOD_WEIGHTS = {7: 1.0, 30: 2.0, 90: 3.0}
#: Users that a week needs on both sides to count in the normalised impact.
WEEK_USERS = 2
NEGATIVE, POSITIVE = -0.01, 0.01


def _net(periods: list[int]) -> Column:
    weights = [PERIOD_WEIGHTS.get(p, 1.0) for p in periods]
    return sum((F.col(f"normalized_{p}") * w for p, w in zip(periods, weights, strict=True)), F.lit(0.0)) / F.lit(float(sum(weights)))


def _cells(pairs: DataFrame, periods: list[int]) -> DataFrame:
    """every, event_name, week, n_with, events, q, qn, r<p>: users of a week that have the feature, or (every) all of them.

    pairs: one row for each user and feature. A user's features are one array with the user's first and last
    day beside it, so no pair meets its user again by a join. The result, a row for each feature and week, is cut
    off by a checkpoint: what follows reads it several times.
    """
    shared_folder(pairs.sparkSession)
    used = F.collect_list(F.struct(F.lit(False).alias("every"), "event_name", "n", "q", "qn"))
    users = pairs.groupBy("user_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), used.alias("used"))
    whole = F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("event_name"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("qn")))
    kept = [F.when(F.date_diff("last", "first") >= p, 1).otherwise(0).alias(f"r{p}") for p in periods]
    rows = users.select(start_of("week", F.col("first")).alias("week"), *kept, F.explode(F.concat(whole, "used")).alias("u")).select("week", *[f"r{p}" for p in periods], "u.*")
    counted = [F.count(F.lit(1)).alias("n_with"), F.sum("n").alias("events"), F.sum("q").alias("q"), F.sum("qn").alias("qn"), *[F.sum(f"r{p}").alias(f"r{p}") for p in periods]]
    return rows.groupBy("every", "event_name", "week").agg(*counted).checkpoint()


def feature_correlation(events: DataFrame, periods: list[int] | None = None, min_feature_users: int = 5, min_non_users: int = 5, exclude_events: list[str] | None = None, segment_column: str | None = None, normalize_max_users: int | None = None) -> DataFrame:
    """One row per feature (event_name), by users: counts, impact_<p>, normalized_<p>, net_score, is_negative.

    impact: retention of the feature's users less that of all others; retained at p: active p or more
    days after the first day. normalized: the same within weeks of first activity, averaged with
    weight min(users, others); weeks with fewer than two on either side do not count, none: 0. Above
    ``normalize_max_users`` users, if that is given, the raw impact stands in. ``exclude_events`` leave
    before anything is computed. ``segment_column`` is accepted and not used.

    "Others" are totals less the feature's own counts, so there is no pass per feature: the events are
    read once, folded by user, and counted by (feature, week) and (all, week).
    """
    periods = periods or [7, 30]
    rows = identified(normalize_events(events))
    if exclude_events:
        rows = rows.filter(~F.col("event_name").isin(*exclude_events))
    has_quality = "ai_quality_score" in rows.columns
    quality = F.col("ai_quality_score") if has_quality else F.lit(None).cast("double")
    pairs = rows.groupBy("user_id", "event_name").agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.sum(F.when(quality > 0, quality)).alias("q"), F.count_if(quality > 0).alias("qn"))
    cells = _cells(pairs, periods)
    sums = [F.sum(f"r{p}").alias(f"r{p}") for p in periods]
    weeks = cells.filter("every").select("week", F.col("n_with").alias("all_n"), *[F.col(f"r{p}").alias(f"all_r{p}") for p in periods])
    used = cells.filter("not every").drop("every")

    totals = weeks.agg(F.sum("all_n").alias("total_n"), *[F.sum(f"all_r{p}").alias(f"total_r{p}") for p in periods])
    apart = used.join(weeks, "week").withColumn("n_wo", F.col("all_n") - F.col("n_with"))
    # A week in which a feature has no user has n_with 0 < WEEK_USERS and so no part in the mean.
    weight = F.when((F.col("n_with") >= WEEK_USERS) & (F.col("n_wo") >= WEEK_USERS), F.least("n_with", "n_wo")).otherwise(0)
    apart = apart.withColumn("w", weight)

    def delta(p: int) -> Column:
        return F.when(F.col("w") > 0, F.col(f"r{p}") / F.col("n_with") - (F.col(f"all_r{p}") - F.col(f"r{p}")) / F.col("n_wo")).otherwise(0.0)

    feature = apart.groupBy("event_name").agg(
        F.sum("n_with").alias("unique_users"), F.sum("events").alias("total_events"), F.try_divide(F.sum("q"), F.sum("qn")).alias("avg_quality"), F.sum("w").alias("w"), *sums, *[F.sum(F.col("w") * delta(p)).alias(f"d{p}") for p in periods]
    )
    out = feature.join(F.broadcast(totals)).withColumn("non_users", F.col("total_n") - F.col("unique_users"))
    out = out.filter((F.col("unique_users") >= min_feature_users) & (F.col("non_users") >= min_non_users))
    for p in periods:
        out = out.withColumn(f"impact_{p}", F.col(f"r{p}") / F.col("unique_users") - (F.col(f"total_r{p}") - F.col(f"r{p}")) / F.col("non_users"))
        within = F.when(F.col("w") > 0, F.col(f"d{p}") / F.when(F.col("w") > 0, F.col("w")).otherwise(1)).otherwise(0.0)
        if normalize_max_users is not None:
            within = F.when(F.col("total_n") > normalize_max_users, F.col(f"impact_{p}")).otherwise(within)
        out = out.withColumn(f"normalized_{p}", within)
    out = out.withColumn("net_score", _net(periods)).withColumn("is_negative", F.col(f"normalized_{max(periods)}") < NEGATIVE)
    columns = ["event_name", "unique_users", "total_events", "non_users", *([] if not has_quality else ["avg_quality"])]
    return out.select(*columns, *[f"{k}_{p}" for k in ("impact", "normalized") for p in periods], "net_score", "is_negative").orderBy(F.desc("unique_users"), "event_name")


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """The features of highest net score, equal ones by name."""
    return found.orderBy(F.desc("net_score"), "event_name").limit(limit)


def feature_summary(events: DataFrame, periods: list[int] | None = None, **options) -> dict:  # noqa: ANN003
    """The JSON form: the ten features of highest net score, and the negative ones."""
    periods = periods or [7, 30]
    found = feature_correlation(events, periods, **options).persist()
    rows = identified(normalize_events(events))
    span = rows.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b"), F.count_distinct("user_id").alias("n")).first()
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("net_score") > POSITIVE).alias("up"), F.count_if("is_negative").alias("down")).first()

    def entry(r, events_too: bool = True) -> dict:  # noqa: ANN001
        out = {"name": r["event_name"], "users": r["unique_users"], "events": r["total_events"], "impact": {f"D{p}": round(r[f"normalized_{p}"], 4) for p in periods}, "net_score": round(r["net_score"], 4)}
        return out if events_too else {k: v for k, v in out.items() if k != "events"}

    top = ranked(found, 10).collect()
    bad = found.filter("is_negative").orderBy("net_score", "event_name").limit(1000).collect()
    found.unpersist()
    return {
        "metric": "feature_correlation", "caveat": "Correlation, not causation: users choose the features they use.", "date_range": {"start": str(span["a"] or date.today()), "end": str(span["b"] or date.today())}, "total_users": span["n"], "total_features": counts["n"],
        "periods": [f"D{p}" for p in periods], "positive_count": counts["up"], "negative_count": counts["down"], "top_features": [entry(r) for r in top], "negative_features": [entry(r, False) for r in bad],
    }
