"""Behavioural churn: health, decay stage and signals of each user from two adjoining fortnights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.schema import identified, normalize_events

HALF = 14
STAGES = ("thriving", "coasting", "fading", "ghosting", "gone")
AT_RISK = ("fading", "ghosting", "gone")
# What can still be done in a stage, the recency steps, and the signals.
SAVE_RATES = {"thriving": None, "coasting": "60-80%", "fading": "30-50%", "ghosting": "10-20%", "gone": "5-10%"}
ACTION_WINDOWS = {"thriving": "No action needed", "coasting": "30-60 days to act", "fading": "14-30 days to act", "ghosting": "7-14 days to act", "gone": "Last resort"}
RECENCY = ((1, 100.0), (3, 90.0), (7, 70.0), (14, 40.0), (30, 15.0), (60, 5.0))
SIGNALS = {
    "absence": "No activity of late",
    "usage_frequency_drop": "Active on far fewer days than before",
    "activity_volume_decline": "Far fewer events than before",
    "feature_breadth_narrow": "Falling back on fewer features",
    "session_gap_growth": "Longer and longer gaps between visits",
}


def _decline(recent: Column, prior: Column) -> Column:
    """1 - recent / prior; null where prior is 0."""
    return 1 - F.try_divide(recent, prior)


def _component(recent: Column, prior: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.try_divide(recent, prior)))
    return F.when(prior > 0, share).when(recent > 0, 100.0).otherwise(0.0)


def churn_users(events: DataFrame, analysis_date: str | None = None, usage_drop: float = 0.4, activity_decline: float = 0.5, absence_days: int = 14, breadth_decline: float = 0.4, lookback_weeks: int = 4, w_activity: float = 0.45, w_breadth: float = 0.35, w_recency: float = 0.20) -> DataFrame:
    """One row for each user active in the lookback: measures, scores, signals (array), stage and trend.

    Recent: after analysis_date - 14 days (later events too); prior: the 14 days before. Only events
    after analysis_date - 7 * lookback_weeks count. Default date: the last event's. Days and features
    are folded to one row per (user, day, event) before the per-user aggregate, which then needs no
    expansion for its four distinct counts.
    """
    rows = identified(normalize_events(events)).select("user_id", "event_date", "event_name")
    if analysis_date is None:
        last = rows.agg(F.max("event_date")).first()[0]
        analysis_date = str(last) if last else "1970-01-01"
    at = F.to_date(F.lit(analysis_date))
    rows = rows.filter(F.col("event_date") > F.date_sub(at, 7 * lookback_weeks))
    folded = rows.groupBy("user_id", "event_date", "event_name").agg(F.count(F.lit(1)).alias("n"))
    recent = F.col("event_date") > F.date_sub(at, HALF)
    prior = (F.col("event_date") > F.date_sub(at, 2 * HALF)) & ~recent

    def kinds(mask: Column, column: str) -> Column:
        return F.size(F.collect_set(F.when(mask, F.col(column))))

    u = folded.groupBy("user_id").agg(
        F.max("event_date").alias("last_seen"), F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("recent_events"), F.coalesce(F.sum(F.when(prior, F.col("n"))), F.lit(0)).alias("prior_events"),
        kinds(recent, "event_date").alias("recent_days"), kinds(prior, "event_date").alias("prior_days"), kinds(recent, "event_name").alias("recent_features"), kinds(prior, "event_name").alias("prior_features"),
    )
    u = u.withColumn("days_inactive", F.date_diff(at, "last_seen"))
    step = F.when(F.col("days_inactive") <= RECENCY[0][0], RECENCY[0][1])
    for days, score in RECENCY[1:]:
        step = step.when(F.col("days_inactive") <= days, score)
    u = u.withColumns({"activity_score": _component(F.col("recent_events"), F.col("prior_events")), "breadth_score": _component(F.col("recent_features"), F.col("prior_features")), "recency_score": step.otherwise(0.0)})
    u = u.withColumn("health_score", w_activity * F.col("activity_score") + w_breadth * F.col("breadth_score") + w_recency * F.col("recency_score"))
    rd, pd_ = F.col("recent_days"), F.col("prior_days")
    gap = (F.col("recent_events") > 0) & (pd_ > 0) & (F.col("days_inactive") >= 7) & (HALF / F.greatest(rd, F.lit(1)) > 1.5 * HALF / F.greatest(pd_, F.lit(1)))
    fired = {
        "absence": F.col("days_inactive") >= absence_days,
        "usage_frequency_drop": (pd_ > 0) & (_decline(rd, pd_) >= usage_drop),
        "activity_volume_decline": (F.col("prior_events") > 0) & (_decline(F.col("recent_events"), F.col("prior_events")) >= activity_decline),
        "feature_breadth_narrow": (F.col("prior_features") > 1) & (_decline(F.col("recent_features"), F.col("prior_features")) >= breadth_decline),
        "session_gap_growth": gap,
    }
    u = u.withColumn("signals", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fired.items()])))
    n, days, health = F.size("signals"), F.col("days_inactive"), F.col("health_score")
    stage = (
        F.when((days >= 30) | (health < 10), "gone")
        .when((days >= 14) | (health < 25), "ghosting")
        .when((n >= 2) | (health < 50), "fading")
        .when((n >= 1) | (health < 70), "coasting")
        .otherwise("thriving")
    )
    mean = (F.col("activity_score") + F.col("breadth_score") + F.col("recency_score")) / 3
    return u.withColumn("stage", stage).withColumn("trend", F.when(mean >= 70, "stable").otherwise("declining")).withColumn("at_risk", F.col("stage").isin(*AT_RISK))


def stage_distribution(users: DataFrame) -> DataFrame:
    """stage, users: over all scored users."""
    return users.groupBy("stage").agg(F.count(F.lit(1)).alias("users"))


def signal_cohorts(users: DataFrame) -> DataFrame:
    """signal, users, avg_health_score: over all scored users, largest first."""
    fired = users.select("health_score", F.explode("signals").alias("signal"))
    return fired.groupBy("signal").agg(F.count(F.lit(1)).alias("users"), F.avg("health_score").alias("avg_health_score")).orderBy(F.desc("users"), "signal")


def at_risk_users(users: DataFrame, limit: int) -> DataFrame:
    """The users at risk of least health, equal ones by user_id."""
    return users.filter("at_risk").orderBy("health_score", "user_id").limit(limit)


def churn_summary(events: DataFrame, analysis_date: str | None = None, healthy: int | None = None, cohort_cap: int | None = None, **options) -> dict:  # noqa: ANN003
    """The JSON form. All users count; ``healthy`` bounds those who are not at risk in the stage distribution, and ``cohort_cap``
    a signal's users, where a report wants that."""
    rows = identified(normalize_events(events))
    span = rows.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
    at = analysis_date or str(span["b"] or "1970-01-01")
    users = churn_users(events, at, **options).persist()
    stages = {r["stage"]: r["users"] for r in stage_distribution(users).collect()}
    total, risk = sum(stages.values()), sum(stages.get(s, 0) for s in AT_RISK)
    listed = stages
    if healthy is not None:
        shown = users.filter(~F.col("at_risk")).orderBy("user_id").limit(healthy)
        listed = {r["stage"]: r["users"] for r in stage_distribution(shown).collect()} | {s: stages[s] for s in AT_RISK if s in stages}
    cohorts = [{"signal": r["signal"], "user_count": r["users"] if cohort_cap is None else min(r["users"], cohort_cap), "avg_health_score": round(r["avg_health_score"], 1), "description": SIGNALS[r["signal"]]} for r in signal_cohorts(users).collect()]
    worst = at_risk_users(users, 10).collect()
    users.unpersist()
    return {
        "metric": "churn_prediction", "analysis_date": at, "date_range": {"start": str(span["a"] or at), "end": str(span["b"] or at)}, "total_users": total, "at_risk_count": risk, "at_risk_pct": round(risk / total, 4) if total else 0.0,
        "stage_distribution": {s: listed.get(s, 0) for s in STAGES}, "cohorts": sorted(cohorts, key=lambda c: -c["user_count"]),
        "top_at_risk": [
            {
                "user_id": r["user_id"], "health_score": round(r["health_score"], 1), "decay_stage": r["stage"], "matched_signals": r["signals"], "signal_details": {s: SIGNALS[s] for s in r["signals"]}, "trend": r["trend"], "days_inactive": r["days_inactive"], "is_at_risk": r["at_risk"],
                "save_rate": SAVE_RATES[r["stage"]], "action_window": ACTION_WINDOWS[r["stage"]], "components": {"activity": round(r["activity_score"], 1), "feature_breadth": round(r["breadth_score"], 1), "recency": round(r["recency_score"], 1)},
            }
            for r in worst
        ],
    }
