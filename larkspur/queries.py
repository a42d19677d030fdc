"""Registered queries over the star schema's tables, each with the SQL that checks it.

``events`` gives metrics, funnels and the daily series; ``orders`` gives retention, cohorts, features,
activation and churn, which are degenerate on thirty days of events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import dates
from larkspur.operators import activation, anomaly, bitmaps, churn, cohort, features, funnel, heavy_hitters, metrics, retention, sketches
from larkspur.schema import AI, from_orders, from_stream_table, identified, split_valid, to_table_rows
from larkspur.session import shared_folder
from larkspur.sources import readers, user_table, vendor, vendor_source
from larkspur.streaming import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Dates that take in all rows of either table.
ALL = ("1990-01-01", "2030-12-31")
TENANT = "t1"

EV = r"""
ev as (
    select 't1' tenant_id, cast(event_id as varchar) event_id, cast(user_id as varchar) user_id, event_type event_name, 'track' event_type, ts "timestamp", cast(ts as date) event_date,
           cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') session_id, '' page_path, 'custom' source_system, k,
           case when k % 2 = 0 then 'm1' else '' end ai_model, case when k % 2 = 0 then event_type else '' end ai_feature,
           case when k % 2 = 0 then cast(k % 10 as double) / 10 else 0 end q, case when k % 2 = 0 then cast(k as double) / 1000 else 0 end cost
    from (select *, coalesce(try_cast(regexp_extract(props, '"k":\s*(-?\d+)', 1) as bigint), 1) k from events)
)"""
OD = """
od as (
    select 't1' tenant_id, cast(o_orderkey as varchar) event_id, cast(o_custkey as varchar) user_id, o_orderpriority event_name, o_orderstatus event_type, o_orderdate "timestamp", cast(o_orderdate as date) event_date,
           cast(o_custkey as varchar) || '-' || strftime(o_orderdate, '%Y%m') session_id, case when o_orderpriority = '1-URGENT' then 'm1' else '' end ai_model,
           case when o_orderpriority = '1-URGENT' then o_totalprice / 1e6 else 0 end q
    from orders
)"""


def stream(spark: SparkSession, d: str) -> DataFrame:
    return from_stream_table(spark.read.parquet(f"{d}/events.parquet"))


def ordered(spark: SparkSession, d: str) -> DataFrame:
    return from_orders(spark.read.parquet(f"{d}/orders.parquet"))


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _metrics(spark: SparkSession, d: str) -> metrics.Metrics:
    return metrics.Metrics(stream(spark, d), TENANT, *ALL)


@query("dau", f"with {EV} select event_date, count(distinct user_id) dau from ev group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).daily_active_users()


@query("overview", f"with {EV} select count(*) total_events, count(distinct user_id) total_users, count(distinct session_id) total_sessions, count(*) filter (ai_model <> '') total_ai_events, round(avg(q) filter (q > 0), 9) overall_avg_ai_quality from ev")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).overview().withColumn("overall_avg_ai_quality", F.round("overall_avg_ai_quality", 9))


@query("daily_metrics_by_type", f"with {EV} select event_date, event_type, count(*) events, count(distinct user_id) users, count(distinct session_id) sessions, count(*) filter (ai_model <> '') ai_events, round(avg(q) filter (q > 0), 9) avg_ai_quality from ev group by 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).daily_metrics_by_type().withColumn("avg_ai_quality", F.round("avg_ai_quality", 9))


_USAGE = "count(distinct user_id) unique_users, count(*) total_usage, count(*) filter (ai_model <> '') ai_events, round(avg(q) filter (q > 0), 9) avg_ai_quality, round(sum(cost) filter (cost > 0), 6) total_ai_cost"


@query("feature_usage_ranking", f"with {EV} select event_name, {_USAGE} from ev group by 1 order by unique_users desc, event_name limit 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).feature_usage_ranking().withColumn("avg_ai_quality", F.round("avg_ai_quality", 9)).withColumn("total_ai_cost", F.round("total_ai_cost", 6))


@query("feature_trend", f"with {EV} select event_date, count(distinct user_id) unique_users, count(*) total_usage, round(avg(q) filter (q > 0), 9) avg_ai_quality from ev where event_name = 'click' group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).feature_trend("click").withColumn("avg_ai_quality", F.round("avg_ai_quality", 9))


@query("user_profile_all", f"""with {EV} select tenant_id, user_id, min("timestamp") first_seen, max("timestamp") last_seen, count(*) event_count, count(*) filter (ai_model <> '') ai_events_count, round(avg(q) filter (q > 0), 9) ai_avg_quality,
    coalesce(string_agg(distinct ai_feature, ',' order by ai_feature) filter (ai_feature <> ''), '') ai_features_used, string_agg(distinct source_system, ',') source_systems from ev where user_id <> '' group by 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.user_profiles(stream(spark, d)).withColumn("ai_avg_quality", F.round("ai_avg_quality", 9))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
    return rows.withColumns(times | {c: F.array_join(c, ",") for c in ("ai_features_used", "source_systems")})


_PROFILES = ORACLES["user_profile_all"]


@query("user_profiles_maintained", _PROFILES)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same from three batches of states, the first two compacted before the third came."""
    rows, folder = stream(spark, d), f"{shared_folder(spark)}/views-{uuid.uuid4().hex}"
    kept = views.MaintainedView(spark, folder, views.VIEWS[0])
    for batch in range(3):
        if batch == 2:
            kept.compact(1)
        kept.put(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch)
    found = metrics.profiles_of(kept.read()).withColumn("ai_avg_quality", F.round("ai_avg_quality", 9))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
    return found.withColumns(times | {c: F.array_join(c, ",") for c in ("ai_features_used", "source_systems")})


@query("user_cohort_all", f"with {EV} select tenant_id, user_id, min(event_date) cohort_date, max(event_date) last_active_date, count(*) lifetime_events from ev where user_id <> '' group by 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.user_cohort_info(stream(spark, d))


@query("recent_events", f"""with {EV} select "timestamp", event_name, event_type, user_id, session_id, page_path, ai_model, ai_feature, q ai_quality_score, source_system from ev order by "timestamp" desc, event_id limit 100""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).recent_events().withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("daily_partials_merged", f"with {EV} select event_date, count(*) events, cast(count(distinct user_id) as bigint) users, cast(count(distinct session_id) as bigint) sessions, count(*) filter (ai_model <> '') ai_events, round(avg(q) filter (q > 0), 9) avg_ai_quality, round(sum(cost) filter (cost > 0), 6) total_ai_cost from ev group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = metrics.daily_partials(stream(spark, d), "event_name", sketch=False)
    return metrics.merge_daily(parts, ["event_date"], sketch=False).withColumn("avg_ai_quality", F.round("avg_ai_quality", 9)).withColumn("total_ai_cost", F.round("total_ai_cost", 6))


@query("daily_partials_sketch", f"with {EV} select event_date, count(*) events, true users_near, true sessions_near from ev group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sketched counts against exact ones: near is 5 % of them, or 1."""
    rows = stream(spark, d)
    rough = metrics.merge_daily(metrics.daily_partials(rows, "event_name"), ["event_date"])
    exact = metrics.merge_daily(metrics.daily_partials(rows, "event_name", sketch=False), ["event_date"], sketch=False)
    both = rough.alias("a").join(exact.alias("b"), "event_date")
    near = [(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.greatest(F.lit(1.0), 0.05 * F.col(f"b.{c}"))).alias(f"{c}_near") for c in ("users", "sessions")]
    return both.select("event_date", F.col("a.events").alias("events"), *near)


@query("active_users_bitmaps", f"with {EV} select 'day' period, event_date \"start\", count(distinct user_id) users from ev group by 1, 2 union all select 'week', cast(date_trunc('week', event_date) as date), count(distinct user_id) from ev group by 1, 2 union all select 'month', cast(date_trunc('month', event_date) as date), count(distinct user_id) from ev group by 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Daily, weekly and monthly actives from the daily bitmaps of each event name."""
    cells = _bitmaps(spark, d)
    found = [bitmaps.active_users(cells, dates.start_of(p, F.col("event_date"))).select(F.lit(p).alias("period"), "start", "users") for p in dates.PERIODS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _bitmaps(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d)
    return bitmaps.daily_bitmaps(rows, bitmaps.extend_dictionary(rows, f"{shared_folder(spark)}/users-{uuid.uuid4().hex}"), "event_name")


@query("returning_users_bitmaps", f"with {EV}, d as (select distinct event_date, user_id from ev) select a.event_date, count(*) users, count(b.user_id) returned from d a left join d b on a.user_id = b.user_id and b.event_date = a.event_date + 7 group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.returning_users(_bitmaps(spark, d), 7).drop("tenant_id")


@query("retention_sketch", f"""with {OD}, f as (select user_id, cast(date_trunc('month', min(event_date)) as date) cohort from od group by 1), a as (select distinct user_id, cast(date_trunc('month', event_date) as date) m from od)
    select cohort, (year(m) - year(cohort)) * 12 + month(m) - month(cohort) period, true users_near, true retained_near from f join a using (user_id) group by 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Monthly retention from sketches against exact counts: near is five standard errors of the cohort, or 1.

    A small cohort meets months of any number of users, so sketches are by buckets of users that they hold exactly.
    """
    rows = ordered(spark, d)
    buckets = sketches.exact_buckets(rows)
    month = dates.start_of("month", F.col("event_date"))
    first = identified(rows).groupBy("user_id").agg(dates.start_of("month", F.min("event_date")).alias("cohort"))
    rough = sketches.sketch_retention(sketches.user_sketches(first, "cohort", buckets=buckets), sketches.user_sketches(rows, month.alias("start"), buckets=buckets), dates.periods_between("month", F.col("cohort"), F.col("start")))
    active = identified(rows).select("user_id", month.alias("start")).distinct()
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    exact = active.join(first, "user_id").groupBy("cohort", dates.periods_between("month", F.col("cohort"), F.col("start")).alias("period")).agg(F.count(F.lit(1)).alias("kept")).join(sizes, "cohort")
    off = F.greatest(F.lit(1.0), 5 / 2.0 ** (sketches.LOG_NOMINAL / 2) * F.col("size"))
    both = exact.join(rough, ["cohort", "period"])
    return both.select("cohort", "period", (F.abs(F.col("users") - F.col("size")) <= off).alias("users_near"), (F.abs(F.col("retained") - F.col("kept")) <= off).alias("retained_near"))


@query("feature_others_sketch", f"with {EV}, n as (select count(distinct user_id) every from ev) select event_name, cast(count(distinct user_id) as bigint) users, cast(any_value(every) - count(distinct user_id) as bigint) others from ev, n group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d)
    found = sketches.others_than(sketches.user_sketches(rows, "event_name", buckets=sketches.exact_buckets(rows)), "event_name")
    return found.select("event_name", F.round("users").cast("long").alias("users"), F.round("others").cast("long").alias("others"))


@query("top_items_daily_partials", """with n as (select cast(o_custkey as varchar) item, count(*) n from orders group by 1), o as (select n.*, row_number() over (order by n desc, item) place from n),
    k as (select max(n) filter (place = 50) kth from o) select item, n, n >= kth among_top, true bounds_hold, true certain_is_true from o, k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders against the bounds of the 50 heaviest, merged from monthly summaries of 200 customers."""
    rows = ordered(spark, d)
    months = heavy_hitters.item_summaries(rows.withColumn("month", dates.start_of("month", F.col("event_date"))), "tenant_id", "month", item="user_id", size=200)
    merged = heavy_hitters.merge_summaries(months, "tenant_id", size=200)
    top = heavy_hitters.top_items(merged, 50, "tenant_id").select("item", "certain")
    listed = merged.filter("listed").select("item", "low", "above")
    rest = merged.agg(F.coalesce(F.sum(F.when(~F.col("listed"), F.col("above"))), F.lit(0)).alias("rest"))  # one row
    exact = rows.filter("user_id is not null").groupBy(F.col("user_id").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    # The 50th greatest count: one row.
    kth = exact.orderBy(F.desc("n"), "item").limit(50).agg(F.min("n").alias("kth"))
    both = exact.join(listed, "item", "left").join(top, "item", "left").join(F.broadcast(rest)).join(F.broadcast(kth))
    held = F.when(F.col("low").isNull(), F.col("n") <= F.col("rest")).otherwise(F.col("n").between(F.col("low"), F.col("above") + F.col("rest")))
    among = F.col("n") >= F.col("kth")
    return both.select("item", "n", among.alias("among_top"), held.alias("bounds_hold"), (~F.coalesce("certain", F.lit(False)) | among).alias("certain_is_true"))


@query("top_features_partials", f"with {EV} select event_name item, count(*) low, count(*) high, true certain, row_number() over (order by count(*) desc, event_name) rank from ev group by 1 order by rank limit 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The top 50 event names from daily summaries; with fewer names than a summary lists they are exact."""
    days = heavy_hitters.item_summaries(stream(spark, d), "tenant_id", "event_date")
    return heavy_hitters.top_items(heavy_hitters.merge_summaries(days, "tenant_id"), 50, "tenant_id").drop("tenant_id")


# --- funnels: the window chain, in SQL as in Spark --------------------------------------------

_CHAIN = f"""
with {EV}, c as (
    select user_id, event_date, event_id, epoch_us("timestamp") tm, event_name = 'signup' c1, event_name = 'click' c2, event_name = 'purchase' c3 from ev
), s1 as (
    select *, case when c1 then tm end a1 from c
), s2 as (
    select *, case when c2 and tm <= p + 21600000000 then p end a2
    from (select *, max(a1) over (partition by user_id order by tm, event_id rows between unbounded preceding and 1 preceding) p from s1)
), s3 as (
    select *, case when c3 and tm <= p3 + 21600000000 then p3 end a3
    from (select *, max(a2) over (partition by user_id order by tm, event_id rows between unbounded preceding and 1 preceding) p3 from s2)
), u as (
    select user_id, min(event_date) entry_date, (max(a1) is not null)::int + (max(a2) is not null)::int + (max(a3) is not null)::int max_step from s3 group by 1
)"""
_STEPS = "count(*) total_entered, count(*) filter (max_step >= 1) step_1_signup, count(*) filter (max_step >= 2) step_2_click, count(*) filter (max_step >= 3) step_3_purchase"


def _funnel(spark: SparkSession, d: str) -> funnel.Funnel:
    return funnel.Funnel(stream(spark, d), TENANT, [funnel.Step("signup"), funnel.Step("click"), funnel.Step("purchase")], *ALL, window_seconds=21_600)


@query("funnel", f"{_CHAIN} select {_STEPS} from u where max_step >= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d).totals()


@query("funnel_by_date", f"{_CHAIN} select entry_date, {_STEPS} from u where max_step >= 1 group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _funnel(spark, d).by_date()


@query("funnel_split", f"{_CHAIN} select entry_date, {_STEPS} from u where max_step >= 1 group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same from pieces of two hours of each user's time."""
    steps = [funnel.Step("signup"), funnel.Step("click"), funnel.Step("purchase")]
    return funnel.Funnel(stream(spark, d), TENANT, steps, *ALL, window_seconds=21_600, split_seconds=7_200).by_date()


_CONDITIONS = _CHAIN.replace("event_name = 'signup' c1, event_name = 'click' c2, event_name = 'purchase' c3 from ev", "event_name <> 'view' c1, event_name = 'click' and q > 0.3 c2, ai_model = '' c3 from ev where k % 3 <> 0")


@query("funnel_conditions", f"{_CONDITIONS} select count(*) total_entered, count(*) filter (max_step >= 1) step_1_not_a_view, count(*) filter (max_step >= 2) step_2_click, count(*) filter (max_step >= 3) step_3_plain from u where max_step >= 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1))
    steps = [funnel.Step(condition="event_name <> 'view'", label="not a view"), funnel.Step("click", "ai_quality_score > 0.3"), funnel.Step(condition=F.col("ai_model") == "", label="plain")]
    return funnel.Funnel(from_stream_table(raw.filter(k % 3 != 0)), TENANT, steps, *ALL, window_seconds=21_600, segment="user_id <> 'nobody'").totals()


# --- retention ---------------------------------------------------------------------------------

_START = {"day": "min(event_date)", "week": "min(event_date) - cast(dayofweek(min(event_date)) as integer)", "month": "cast(date_trunc('month', min(event_date)) as date)"}
_INDEX = {"day": "date_diff('day', c, event_date)", "week": "cast(floor(date_diff('day', c, event_date) / 7) as bigint)", "month": "(year(event_date) - year(c)) * 12 + month(event_date) - month(c)"}


def _simple_sql(period: str, n: int, where: str = "true") -> str:
    columns = ", ".join(f"count(distinct case when i = {i} then user_id end) period_{i}" for i in range(n))
    return f"""with {OD}, f as (select user_id, cast({_START[period]} as date) c from od where user_id <> '' and {where} group by 1),
    r as (select user_id, c, {_INDEX[period]} i from od join f using (user_id)), z as (select c, count(*) cohort_size from f group by 1)
    select c cohort_date, cohort_size, {columns} from r join z using (c) group by 1, 2"""


for _period, _n in (("day", 8), ("week", 8), ("month", 12)):

    def _matrix(spark: SparkSession, d: str, period: str = _period, n: int = _n) -> DataFrame:
        rows = retention.retention_matrix(ordered(spark, d), TENANT, *ALL, period=period, num_periods=n)
        return rows.select("cohort_date", "cohort_size", *[F.col("retention_array")[i].alias(f"period_{i}") for i in range(n)])

    query(f"retention_matrix_{_period}", _simple_sql(_period, _n))(_matrix)


@query("retention_simple_week", _simple_sql("week", 8, "event_name = '1-URGENT'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.retention_simple(ordered(spark, d), TENANT, *ALL, event_filter="event_name = '1-URGENT'")


@query("retention_matrix_filtered", _simple_sql("month", 6, "event_type = 'F'").replace("from od join f", "from (select * from od where event_type = 'F') od join f"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = retention.retention_matrix(ordered(spark, d), TENANT, *ALL, period="month", num_periods=6, event_filter=F.col("event_type") == "F")
    return rows.select("cohort_date", "cohort_size", *[F.col("retention_array")[i].alias(f"period_{i}") for i in range(6)])


@query("retention_simple_ai_only", _simple_sql("week", 8, "ai_model <> ''"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.retention_simple(ordered(spark, d), TENANT, *ALL, ai_only=True)


def _curve_sql(key: str) -> str:
    return f"""with {OD}, f as (select user_id, min(event_date) first, min_by(event_type, event_date || event_type) kind from od where user_id <> '' group by 1),
    b as (select user_id, {key} cohort_key, max((date_diff('day', first, event_date) between 1 and 29)::int) r1, max((date_diff('day', first, event_date) between 30 and 364)::int) r30, max((date_diff('day', first, event_date) >= 365)::int) r365
          from od join f using (user_id) group by user_id, first, kind)
    select cohort_key, count(*) cohort_size, cast(sum(r1) as bigint) retained_1, cast(sum(r30) as bigint) retained_30, cast(sum(r365) as bigint) retained_365,
           sum(r1) / count(*)::double rate_1, sum(r30) / count(*)::double rate_30, sum(r365) / count(*)::double rate_365 from b group by 1"""


@query("retention_curve_week", _curve_sql("cast(date_trunc('week', first) as date)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.retention_curves(ordered(spark, d), [1, 30, 365])


@query("retention_curve_by_column", _curve_sql("kind"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return retention.retention_curves(ordered(spark, d), [1, 30, 365], "event_type")


@query("retention_curve_user_table", ORACLES["retention_curve_week"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The weekly curves from a table in buckets of users."""
    return retention.retention_curves(_by_user(spark, d), [1, 30, 365])


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    name = f"orders_{uuid.uuid4().hex}"
    user_table.save_by_user(ordered(spark, d), name, f"{shared_folder(spark)}/{name}", buckets=16)
    return spark.read.table(name)


# --- cohorts -----------------------------------------------------------------------------------


def _cohort_sql(label: str, value: str) -> str:
    return f"""with {OD}, u as (select user_id, {value} label, min(event_date) a, max(event_date) b, count(*) n, count(*) filter (ai_model <> '') ai, count(distinct event_name) names, count(distinct session_id) sessions from od where user_id <> '' group by 1)
    select label "{label}", count(*) cohort_size, avg(n) avg_events_per_user, avg(ai) avg_ai_events_per_user, avg(names) avg_distinct_events, avg(sessions) avg_sessions, avg(date_diff('day', a, b)) avg_lifespan_days, count(*) filter (b >= date '2001-07-25') active_last_7d
    from u group by 1 order by cohort_size desc, label limit 20"""


_FIRST = """min_by({0}, strftime("timestamp", '%Y%m%d%H%M%S') || event_id)"""
for _name, _options, _label, _value in (
    ("cohort_day", {"cohort_by": "first_seen_day"}, "cohort_date", "min(event_date)"),
    ("cohort_week", {"cohort_by": "first_seen_week"}, "cohort_date", f"cast({_START['week']} as date)"),
    ("cohort_month", {"cohort_by": "first_seen_month"}, "cohort_date", _START["month"]),
    ("cohort_first_event", {"cohort_by": "first_event"}, "first_event", _FIRST.format("event_name")),
    ("cohort_property", {"cohort_by": "property", "property_key": "status"}, "property_status", _FIRST.format("event_type")),
):

    def _cohort(spark: SparkSession, d: str, options: dict = _options) -> DataFrame:
        return cohort.Cohorts(ordered(spark, d), TENANT, *ALL, as_of="2001-08-01", **options).summary()

    query(_name, _cohort_sql(_label, _value))(_cohort)


@query("cohort_comparison", f"""with {OD}, u as (select user_id, {_FIRST.format("event_name")} v from od where user_id <> '' and event_type = 'O' group by 1), m as (select user_id, count(*) filter (event_name = '5-LOW') n from od group by 1)
    select v cohort_value, count(*) cohort_size, cast(sum(n) as bigint) metric_events, count(*) filter (n > 0) users_with_metric, sum(n) / count(*)::double metric_rate from u join m using (user_id) group by 1 order by 2 desc, 1 limit 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cohort.Cohorts(ordered(spark, d), TENANT, *ALL, cohort_by="first_event", event_filter="event_type = 'O'").comparison("5-LOW")


# --- anomalies ---------------------------------------------------------------------------------


def _anomaly_sql(series: str) -> str:
    return f"""with {EV}, {series}, w as (
        select metric, date, value, count(*) over (partition by metric order by date rows between 4 preceding and 1 preceding) n, avg(value) over (partition by metric order by date rows between 4 preceding and 1 preceding) m,
               stddev_samp(value) over (partition by metric order by date rows between 4 preceding and 1 preceding) sd, count(*) over (partition by metric) points from s),
    z as (select *, greatest(coalesce(sd, 0), abs(m) * 0.01) e from w where points >= 4 and n >= 2),
    y as (select *, case when e > 0 then abs(value - m) / e when value <> m then 'infinity'::double end sigma from z)
    select metric, date, value, round(m, 9) expected, round(sigma, 6) sigma_distance, case when value > m then 'up' else 'down' end direction, case when sigma >= 3 then 'critical' else 'warning' end severity,
           round(case when m <> 0 then (value - m) / m else 'infinity'::double end, 9) pct_change from y where sigma >= 2"""


def _placed(report: DataFrame) -> DataFrame:
    """The rows of a short ordered report with their places, from 1."""
    at = report.withColumn("at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"expected": F.round("expected", 9), "sigma_distance": F.round("sigma_distance", 6), "pct_change": F.round("pct_change", 9)})


@query("anomaly_dau", _anomaly_sql("s as (select 'dau' metric, event_date date, count(distinct user_id)::double as value from ev where user_id <> '' group by 2)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(anomaly.detect_anomalies(metrics.dau_series(stream(spark, d)).withColumn("metric", F.lit("dau"))))


@query("anomaly_multi", _anomaly_sql("s as (select event_name metric, event_date date, count(*)::double as value from ev group by 1, 2)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    series = stream(spark, d).groupBy(F.col("event_name").alias("metric"), F.col("event_date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _rounded(anomaly.detect_anomalies(series))


@query("anomaly_order", f"""select metric, date, severity, row_number() over (order by case when severity = 'critical' then 0 else 1 end, sigma_distance desc, metric, date) place
    from ({_anomaly_sql("s as (select event_name metric, event_date date, count(*)::double as value from ev group by 1, 2)")})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The places of the anomalies in their report."""
    series = stream(spark, d).groupBy(F.col("event_name").alias("metric"), F.col("event_date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _placed(anomaly.detect_anomalies(series)).select("metric", "date", "severity", "place")


@query("retention_order", f"select cohort_date, cohort_size, row_number() over (order by cohort_date) place from ({_simple_sql('week', 8)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The places of the cohorts in the weekly matrix."""
    return _placed(retention.retention_simple(ordered(spark, d), TENANT, *ALL)).select("cohort_date", "cohort_size", "place")


@query("anomaly_ranges", ORACLES["anomaly_multi"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same with each series in ranges of five days, and halos."""
    series = stream(spark, d).groupBy(F.col("event_name").alias("metric"), F.col("event_date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _rounded(anomaly.detect_anomalies(series, range_days=5))


# --- features and activation -------------------------------------------------------------------

_FEATURES = f"""with {OD}, e as (select user_id, event_date, event_name || event_type event_name from od where user_id <> ''),
    u as (select user_id, cast(date_trunc('week', min(event_date)) as date) wk, (date_diff('day', min(event_date), max(event_date)) >= 1500)::int a, (date_diff('day', min(event_date), max(event_date)) >= 2000)::int b from e group by 1),
    f as (select event_name, count(*) total_events from e group by 1), p as (select distinct user_id, event_name from e),
    x as (select f.event_name, u.*, (p.user_id is not null)::int has from f cross join u left join p on p.user_id = u.user_id and p.event_name = f.event_name),
    r as (select event_name, sum(has) unique_users, count(*) - sum(has) non_users, avg(a) filter (has = 1) - avg(a) filter (has = 0) impact_1500, avg(b) filter (has = 1) - avg(b) filter (has = 0) impact_2000 from x group by 1),
    w as (select event_name, wk, least(sum(has), count(*) - sum(has)) w, avg(a) filter (has = 1) - avg(a) filter (has = 0) da, avg(b) filter (has = 1) - avg(b) filter (has = 0) db from x group by 1, 2 having sum(has) >= 2 and count(*) - sum(has) >= 2),
    n as (select event_name, sum(w * da) / sum(w) na, sum(w * db) / sum(w) nb from w group by 1)"""


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d).select("user_id", "event_date", F.concat("event_name", "event_type").alias("event_name"))
    return features.feature_correlation(rows, [1500, 2000])


@query("feature_correlation", f"{_FEATURES} select event_name, cast(unique_users as bigint) unique_users, cast(non_users as bigint) non_users, total_events, round(impact_1500, 9) impact_1500, round(impact_2000, 9) impact_2000 from r join f using (event_name) where unique_users >= 5 and non_users >= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _feature_rows(spark, d).select("event_name", "unique_users", "non_users", "total_events", F.round("impact_1500", 9).alias("impact_1500"), F.round("impact_2000", 9).alias("impact_2000"))


@query("feature_correlation_normalized", f"{_FEATURES} select event_name, round(coalesce(na, 0), 9) normalized_1500, round(coalesce(nb, 0), 9) normalized_2000, round((coalesce(na, 0) + coalesce(nb, 0)) / 2, 9) net_score, coalesce(nb, 0) < -0.01 is_negative from r left join n using (event_name) where unique_users >= 5 and non_users >= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _feature_rows(spark, d).select("event_name", *[F.round(c, 9).alias(c) for c in ("normalized_1500", "normalized_2000", "net_score")], "is_negative")


@query("feature_ranking", f"{_FEATURES} select event_name, round((coalesce(na, 0) + coalesce(nb, 0)) / 2, 9) net_score from r left join n using (event_name) where unique_users >= 5 and non_users >= 5 order by net_score desc, event_name limit 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return features.ranked(_feature_rows(spark, d).withColumn("net_score", F.round("net_score", 9)), 10).select("event_name", "net_score")


_ACT = f"""with {OD}, e as (select user_id, event_date, event_name || event_type event_name from od where user_id <> ''),
    u as (select user_id, min(event_date) first, (date_diff('day', min(event_date), max(event_date)) >= 2000)::int r from e group by 1),
    c as (select user_id, event_name, count(*) n, max(r) r from e join u using (user_id) where date_diff('day', first, event_date) <= 365 group by 1, 2),
    t as (select count(*) users, sum(r) ur from u)"""
_TABLE = """select events, frequency, adopters, cast(ar as bigint) adopters_retained, cast(users - adopters as bigint) others, cast(ur - ar as bigint) others_retained, round(case when d > 0 then (tp * tn - fp * fn) / sqrt(d) else 0 end, 9) mcc
    from (select *, ar::double tp, adopters::double - ar fp, (ur - ar)::double fn, (users - adopters)::double - (ur - ar) tn, adopters::double * (users - adopters) * ur * (users - ur) d from p cross join t)"""
_COLUMNS = ("frequency", "adopters", "adopters_retained", "others", "others_retained")


def _patterns(spark: SparkSession, d: str, combinations: int) -> DataFrame:
    rows = ordered(spark, d).select("user_id", "event_date", F.concat("event_name", "event_type").alias("event_name"))
    table = activation.contingency(rows, 365, 2000, combinations, [1, 2, 3])
    return table.select(F.array_join("events", "+").alias("events"), *_COLUMNS, F.round("mcc", 9).alias("mcc"))


@query("activation_singles", f"{_ACT}, p as (select event_name events, k frequency, count(*) adopters, sum(r) ar from c cross join (values (1), (2), (3)) v(k) where n >= k group by 1, 2) {_TABLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d, 1)


@query("activation_pairs", f"{_ACT}, m as (select event_name from c group by 1 order by count(*) desc, 1 limit 30), k as (select * from c where event_name in (select event_name from m)), p as (select x.event_name || '+' || y.event_name events, 1 frequency, count(*) adopters, sum(x.r) ar from k x join k y on x.user_id = y.user_id and x.event_name < y.event_name group by 1) {_TABLE}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d, 2).filter(F.col("events").contains("+"))


_STATISTICS = """s as (select *, users - adopters others, ur - ar others_retained, ar::double x, adopters::double n, (ur - ar)::double y, (users - adopters)::double m from p cross join t),
    v as (select *, case when y > 0 then (x / n) / (y / m) when x > 0 then 'infinity'::double else 1 end lift, case when n > 0 and m > 0 and x + y > 0 and n + m - x - y > 0 then (n + m) * (x * (m - y) - y * (n - x)) ^ 2 / (n * m * (x + y) * (n + m - x - y)) else 0 end chi2,
          case when n * m * ur * (users - ur) > 0 then (x * (m - y) - (n - x) * y) / sqrt(n * m * ur * (users - ur)) else 0 end mcc from s)"""
_PAIRS = "m as (select event_name from c group by 1 order by count(*) desc, 1 limit 30), k as (select * from c where event_name in (select event_name from m))"
_PATTERNS = "p as (select event_name events, k frequency, count(*) adopters, sum(r) ar from c cross join (values (1), (2), (3)) v(k) where n >= k group by 1, 2 union all select x.event_name || '+' || y.event_name, 1, count(*), sum(x.r) from k x join k y on x.user_id = y.user_id and x.event_name < y.event_name group by 1)"
#: The statistic that p = 0.5 stands at, at one degree of freedom.
_MEDIAN_CHI2 = 0.454936423119572


@query("activation_statistics", f"""{_ACT}, {_PAIRS}, {_PATTERNS}, {_STATISTICS} select events, frequency, adopters, round(chi2, 6) chi2, round(mcc, 9) mcc, round(lift, 9) lift, case when chi2 <= 0 then 1 when sqrt(chi2 / 2) < 2
    then 1 - 2 * sqrt(chi2 / 2) * exp(-chi2 / 2) / sqrt(pi()) * list_reduce(list_prepend(1.0::double, range(60, 0, -1)), lambda a, k: 1 + a * chi2 / (2 * k + 1))
    else exp(-chi2 / 2) / sqrt(pi()) / list_reduce(list_prepend(sqrt(chi2 / 2), range(40, 0, -1)), lambda a, k: sqrt(chi2 / 2) + k / 2.0::double / a) end p_value from v""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d).select("user_id", "event_date", F.concat("event_name", "event_type").alias("event_name"))
    table = activation.contingency(rows, 365, 2000, 2, [1, 2, 3])
    return table.select(F.array_join("events", "+").alias("events"), "frequency", "adopters", F.round("chi2", 6).alias("chi2"), F.round("mcc", 9).alias("mcc"), F.round("lift", 9).alias("lift"), "p_value")


@query("activation_moments", f"""{_ACT}, {_PAIRS}, {_PATTERNS}, {_STATISTICS}, w as (
        select *, row_number() over (partition by events order by mcc desc, frequency) nth from v
        where adopters >= 10 and others >= 10 and n / users between 0.02 and 0.95 and lift >= 1.1 and chi2 > {_MEDIAN_CHI2})
    select events, frequency, adopters, cast(ar as bigint) adopters_retained, cast(others as bigint) others, cast(others_retained as bigint) others_retained, round(lift, 9) lift, round(mcc, 9) mcc, round(chi2, 6) chi2 from w where nth = 1 order by w.mcc desc, events limit 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d).select("user_id", "event_date", F.concat("event_name", "event_type").alias("event_name"))
    found = activation.discover(rows, 365, 2000, p_threshold=0.5, frequencies=[1, 2, 3])
    return found.select(F.array_join("events", "+").alias("events"), *_COLUMNS, F.round("lift", 9).alias("lift"), F.round("mcc", 9).alias("mcc"), F.round("chi2", 6).alias("chi2"))


# --- churn -------------------------------------------------------------------------------------

_CHURN = f"""with {OD}, e as (select user_id, event_date, event_name from od where user_id <> ''), z as (select max(event_date) dt from e),
    m as (select user_id, max(event_date) last_seen, max(dt) dt, count(*) filter (event_date > dt - 14) re, count(*) filter (event_date > dt - 28 and event_date <= dt - 14) pe, count(distinct event_date) filter (event_date > dt - 14) rd,
          count(distinct event_date) filter (event_date > dt - 28 and event_date <= dt - 14) pd, count(distinct event_name) filter (event_date > dt - 14) rf, count(distinct event_name) filter (event_date > dt - 28 and event_date <= dt - 14) pf
          from e cross join z where event_date > dt - 728 group by 1),
    k as (select *, date_diff('day', last_seen, dt) di, case when pe > 0 then least(100.0, 100.0 * re / pe)::double when re > 0 then 100.0 else 0.0 end act, case when pf > 0 then least(100.0, 100.0 * rf / pf)::double when rf > 0 then 100.0 else 0.0 end br from m),
    h as (select *, case when di <= 1 then 100 when di <= 3 then 90 when di <= 7 then 70 when di <= 14 then 40 when di <= 30 then 15 when di <= 60 then 5 else 0 end::double rec from k),
    s as (select *, 0.45::double * act + 0.35::double * br + 0.20::double * rec health, di >= 14 f1, pd > 0 and 1 - rd / nullif(pd, 0)::double >= 0.4 f2, pe > 0 and 1 - re / nullif(pe, 0)::double >= 0.5 f3, pf > 1 and 1 - rf / nullif(pf, 0)::double >= 0.4 f4,
          re > 0 and pd > 0 and di >= 7 and 14.0 / greatest(rd, 1) > 1.5 * 14.0 / greatest(pd, 1) f5 from h),
    g as (select *, coalesce(f1, false)::int + coalesce(f2, false)::int + coalesce(f3, false)::int + coalesce(f4, false)::int + coalesce(f5, false)::int n from s),
    u as (select *, case when di >= 30 or health < 10 then 'gone' when di >= 14 or health < 25 then 'ghosting' when n >= 2 or health < 50 then 'fading' when n >= 1 or health < 70 then 'coasting' else 'thriving' end stage from g)"""


def _churn(spark: SparkSession, d: str) -> DataFrame:
    return churn.churn_users(ordered(spark, d), lookback_weeks=104)


def _churn_columns(users: DataFrame) -> DataFrame:
    return users.select("user_id", "days_inactive", "recent_events", "prior_events", F.round("health_score", 6).alias("health_score"), F.size("signals").alias("signals"), "stage", "trend")


@query("churn_users", f"{_CHURN} select user_id, di days_inactive, re recent_events, pe prior_events, round(health, 6) health_score, n signals, stage, case when (act + br + rec) / 3 >= 70 then 'stable' else 'declining' end trend from u")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _churn_columns(_churn(spark, d))


@query("churn_users_user_table", ORACLES["churn_users"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same users from a table in buckets of users."""
    return _churn_columns(churn.churn_users(_by_user(spark, d), lookback_weeks=104))


# The stream's users, a quarter each: gone for 20 days, for 10 days, with a fifth of their events of late, as they are.
_FADING = f"""{EV}, od as (select user_id, event_date, event_name from (select *, max(event_date) over () mx, cast(user_id as bigint) % 4 g from ev) where case g when 0 then event_date <= mx - 20 when 1 then event_date <= mx - 10 when 2 then event_date <= mx - 14 or k % 5 = 0 else true end)"""
_FADED = _CHURN.replace(f"with {OD}", f"with {_FADING}").replace("dt - 728", "dt - 28")


def _fading(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1))
    rows = from_stream_table(raw.filter(k % 5 == 0)).withColumn("fifth", F.lit(True)).unionByName(from_stream_table(raw.filter(k % 5 != 0)).withColumn("fifth", F.lit(False)))
    rows = rows.withColumn("part", F.col("user_id").cast("long") % 4)
    last = F.lit(rows.agg(F.max("event_date")).first()[0])
    late = F.when(F.col("part") == 0, F.col("event_date") <= F.date_sub(last, 20)).when(F.col("part") == 1, F.col("event_date") <= F.date_sub(last, 10)).when(F.col("part") == 2, (F.col("event_date") <= F.date_sub(last, 14)) | F.col("fifth"))
    return rows.filter(late.isNull() | late)


@query("churn_fading_users", f"{_FADED} select user_id, di days_inactive, re recent_events, pe prior_events, round(health, 6) health_score, n signals, stage, case when (act + br + rec) / 3 >= 70 then 'stable' else 'declining' end trend from u")
def _(spark: SparkSession, d: str) -> DataFrame:
    return churn.churn_users(_fading(spark, d)).select("user_id", "days_inactive", "recent_events", "prior_events", F.round("health_score", 6).alias("health_score"), F.size("signals").alias("signals"), "stage", "trend")


@query("churn_fading_signals", f"{_FADED} select signal, count(*) users from (select health, unnest(['absence', 'usage_frequency_drop', 'activity_volume_decline', 'feature_breadth_narrow', 'session_gap_growth']) signal, unnest([f1, f2, f3, f4, f5]) f from u) where f group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return churn.signal_cohorts(churn.churn_users(_fading(spark, d))).select("signal", "users")


@query("churn_at_risk", f"{_FADED} select user_id, round(health, 6) health_score, stage from u where stage in ('fading', 'ghosting', 'gone') order by health, user_id limit 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return churn.at_risk_users(churn.churn_users(_fading(spark, d)), 10).select("user_id", F.round("health_score", 6).alias("health_score"), "stage")


@query("churn_stage_distribution", f"{_CHURN} select stage, count(*) users from u group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return churn.stage_distribution(_churn(spark, d))


@query("churn_signal_cohorts", f"{_CHURN} select signal, count(*) users, round(avg(health), 6) avg_health_score from (select health, unnest(['absence', 'usage_frequency_drop', 'activity_volume_decline', 'feature_breadth_narrow', 'session_gap_growth']) signal, unnest([f1, f2, f3, f4, f5]) f from u) where f group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return churn.signal_cohorts(_churn(spark, d)).withColumn("avg_health_score", F.round("avg_health_score", 6))


# --- sources -----------------------------------------------------------------------------------


@query("events_jsonl_normalize", "select cast(user_id as varchar) user_id, cast(ts as date) event_date, event_type event_name, count(*) n from events group by 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    lines = raw.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("distinct_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("event"))).alias("value"))
    return readers.parse_jsonl(lines).groupBy("user_id", "event_date", "event_name").agg(F.count(F.lit(1)).alias("n"))


@query("vendor_mapping", """select case when user_id % 5 = 0 then '' else cast(user_id as varchar) end user_id, case when user_id % 5 = 0 then cast(user_id as varchar) else '' end anonymous_id, case event_type when 'signup' then 'identify' when 'view' then 'pageview' else 'track' end event_type, 'desktop' device_type, cast(ts as date) event_date, count(*) n from events group by 1, 2, 3, 4, 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    name = F.when(F.col("event_type") == "signup", "$identify").when(F.col("event_type") == "view", "$pageview").otherwise(F.col("event_type"))
    person = F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") != "signup"), "false")
    properties = F.to_json(F.struct(F.lit("Desktop").alias("$device_type"), person.alias("$process_person_profile"), F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "signup"), F.col("user_id").cast("string")).alias("$anon_distinct_id")))
    rows = raw.select(F.col("event_id").cast("string").alias("uuid"), name.alias("event"), F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") == "signup"), "").otherwise(F.col("user_id").cast("string")).alias("distinct_id"), F.col("ts").cast("timestamp").cast("string").alias("timestamp"), properties.alias("properties"))
    mapped = vendor.map_vendor_events(rows, TENANT)
    return mapped.groupBy("user_id", "anonymous_id", "event_type", "device_type", F.to_date("timestamp").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))


@query("vendor_pull", "select cast(event_id as varchar) source_event_id, event_type event_name, cast(user_id as varchar) user_id, ts \"timestamp\", props from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The events as a vendor's export, pulled by day slices through the data source."""
    feed = vendor_source.ExportFeed(f"{d}/events.parquet", ("event_id", "event_type", "user_id", "ts", "props"))
    low, high = spark.read.parquet(f"{d}/events.parquet").agg(F.min("ts").cast("date").cast("string"), F.date_add(F.max("ts").cast("date"), 1).cast("string")).first()
    raw = spark.read.format(vendor_source.register_vendor_source(spark, feed)).options(start=low, end=high, slice_seconds=86_400).load()
    events = vendor.drop_repeats(vendor.map_vendor_events(raw, TENANT))
    return events.select("source_event_id", "event_name", "user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.concat(F.lit('{"k": '), F.col("properties")["k"], F.lit("}")).alias("props"))


@query("validation_split", "select case when user_id % 7 = 0 then 'quarantined' else 'valid' end kind, count(*) n from events group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).withColumn("user_id", F.when(F.col("user_id").cast("long") % 7 == 0, "").otherwise(F.col("user_id")))
    valid, bad = split_valid(rows)
    return valid.select(F.lit("valid").alias("kind")).union(bad.select(F.lit("quarantined"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("commerce_fan_out", "select cast(user_id as varchar) user_id, cast(ts as date) event_date, unnest(case when event_type = 'view' then ['view', 'browse_c' || (event_id % 3)] else [event_type] end) event_name, count(*) n from events group by 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    rows = raw.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("event_time"), "event_type", F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("c"), F.col("event_id") % 3, F.lit(".x")).alias("category_code"))
    return readers.commerce_to_events(rows).groupBy("user_id", "event_date", "event_name").agg(F.count(F.lit(1)).alias("n"))


@query("sampled_users", "select count(distinct user_id) users, least(50, count(distinct user_id)) kept_users from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).select("user_id", "event_date", "event_name")
    kept = readers.sample_users(rows, 50)
    return identified(rows).agg(F.count_distinct("user_id").alias("users")).crossJoin(kept.agg(F.count_distinct("user_id").alias("kept_users")))


@query("commerce_csv_scan", "select cast(user_id as varchar) user_id, cast(ts as date) event_date, event_type event_name, count(*) n from events group by 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    empty = {f.name: F.lit("") for f in readers.COMMERCE.fields} | {"event_time": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss 'UTC'"), "event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string"), "brand": F.lit('a "b", c')}
    lines = raw.select(F.to_csv(F.struct(*[c.alias(n) for n, c in empty.items()])).alias("value"))
    return readers.parse_commerce_csv(lines).groupBy("user_id", "event_date", "event_name").agg(F.count(F.lit(1)).alias("n"))


@query("flattened_rows", """select event_type event_name, case user_id % 3 when 0 then 'mobile' else 'unknown' end device_type, case user_id % 3 when 1 then 'DE' else '' end country, case event_id % 2 when 0 then 'm' else '' end ai_model, cast(ts as date) event_date,
    round(sum(case event_id % 2 when 0 then 0.5 else 0 end), 6) quality, cast(sum(case event_id % 2 when 0 then event_id % 7 else 0 end) as bigint) tokens, count(*) filter (user_id % 5 = 0) set_keys, count(*) n from events group by 1, 2, 3, 4, 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    user, event = F.col("user_id"), F.col("event_id")
    ai = F.when(event % 2 == 0, F.struct(F.lit("m").alias("model"), F.lit(0.5).alias("quality_score"), (event % 7).alias("tokens_in")))
    rows = raw.select(
        F.lit(TENANT).alias("tenant_id"), event.cast("string").alias("event_id"), user.cast("string").alias("user_id"), F.col("event_type").alias("event_name"), F.lit("track").alias("event_type"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("custom").alias("source_system"),
        F.when(user % 3 == 0, "mobile").alias("device_type"), F.when(user % 3 == 1, "DE").alias("country"), F.when(user % 5 == 0, F.create_map(F.lit("plan"), F.lit("pro"))).alias("user_properties_set"),
        F.struct(*[(ai[f.name] if f.name in ("model", "quality_score", "tokens_in") else F.lit(None)).cast(f.dataType).alias(f.name) for f in AI]).alias("ai"),
    )
    flat = to_table_rows(rows)
    totals = [F.round(F.sum("ai_quality_score"), 6).alias("quality"), F.sum("ai_tokens_in").alias("tokens"), F.count_if(F.size("user_properties_set") > 0).alias("set_keys"), F.count(F.lit(1)).alias("n")]
    return flat.groupBy("event_name", "device_type", "country", "ai_model", "event_date").agg(*totals)


@query("vendor_mapping_fields", """with e as (select *, user_id % 6 u, cast(user_id as varchar) who, event_id % 3 g from events)
    select case event_type when 'view' then '$groupidentify' else event_type end event_name, case event_type when 'view' then 'group_identify' else 'track' end event_type, case u when 0 then 'mobile' when 1 then 'tablet' else 'unknown' end device_type, case u when 2 then 'FR' else '' end country,
    case g when 0 then 'company' when 1 then 'group_2' else '' end group_type, case g when 0 then 'k' || u when 1 then 'g' || u else '' end group_id, '/p' || u page_path, 'en-US' locale, case u when 3 then 'mail' else '' end utm_source,
    '{"$geoip_country_code":"' || case u when 2 then 'fr' else 'xxx' end || '","$locale":"en-US","flag":"true","nested":"{\\"a\\":[1]}","none":"","plan":"p' || u || '"}' properties, case when u = 4 then '{"tier":"1"}' else '{}' end user_set, case when u = 4 then '{"first":"x"}' else '{}' end user_set_once,
    case when event_type = 'view' then '{"size":"9"}' else '{}' end group_properties, 'posthog' source_system, count(*) n from e group by all""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet")
    u, g, one = F.col("user_id") % 6, F.col("event_id") % 3, F.col("event_type") == "view"
    told = {
        "$device_type": F.when(u == 0, "Mobile").when(u == 1, "Tablet").otherwise("Watch"), "$geoip_country_code": F.when(u == 2, "fr").otherwise("xxx"), "$pathname": F.concat(F.lit("/p"), u), "$locale": F.lit("en-US"), "$utm_source": F.when(u == 3, "mail"), "$os": F.lit("x"),
        "$group_type": F.when(g == 0, "company"), "$group_key": F.when(g == 0, F.concat(F.lit("k"), u)), "$group_2": F.when(g == 1, F.concat(F.lit("g"), u)), "plan": F.concat(F.lit("p"), u), "flag": F.lit(True), "none": F.lit(None).cast("string"), "nested": F.struct(F.array(F.lit(1)).alias("a")),
        "$set": F.when(u == 4, F.struct(F.lit(1).alias("tier"))), "$set_once": F.when(u == 4, F.struct(F.lit("x").alias("first"))), "$group_set": F.struct(F.lit(9).alias("size")),
    }
    properties = F.to_json(F.struct(*[c.alias(k) for k, c in told.items()]), {"ignoreNullFields": "false"})
    rows = raw.select(F.col("event_id").cast("string").alias("uuid"), F.when(one, "$groupidentify").otherwise(F.col("event_type")).alias("event"), F.col("user_id").cast("string").alias("distinct_id"), F.col("ts").cast("timestamp").cast("string").alias("timestamp"), properties.alias("properties"))

    def text(column: str) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))

    mapped = vendor.map_vendor_events(rows, TENANT)
    keys = ["event_name", "event_type", "device_type", "country", "group_type", "group_id", "page_path", "locale", "utm_source", "source_system"]
    return mapped.groupBy(*keys, text("properties").alias("properties"), text("user_properties_set").alias("user_set"), text("user_properties_set_once").alias("user_set_once"), text("group_properties").alias("group_properties")).agg(F.count(F.lit(1)).alias("n"))
