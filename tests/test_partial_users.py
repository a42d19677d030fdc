"""Distinct users from partial states: bitmaps against exact counts, sketches within their bounds; and erfc."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.functions.dates import start_of
from larkspur.functions.statistics import erfc, p_value, p_values
from larkspur.operators import activation, bitmaps, features, sketches

SCHEMA = "tenant_id string, user_id string, event_name string, event_date date"


def drawn(spark, n, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), draw.choice(["", None, *[f"u{i}" for i in range(60)]]), draw.choice("xyz"), date(2026, 1, 1) + timedelta(days=draw.randint(0, 40))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_bitmaps_count_exactly_over_batches_days_and_kinds(spark, tmp_path):
    path = str(tmp_path / "users")
    one, first = drawn(spark, 400, 1)
    two, second = drawn(spark, 900, 2)
    numbers = bitmaps.extend_dictionary(first, path)
    assert numbers.count() == len({(t, u) for t, u, *_ in one if u})
    before = {(r["tenant_id"], r["user_id"]): r["position"] for r in numbers.collect()}
    cells = bitmaps.daily_bitmaps(first, numbers, "event_name")
    numbers = bitmaps.extend_dictionary(second, path)
    assert bitmaps.extend_dictionary(second, path).count() == numbers.count()
    after = {(r["tenant_id"], r["user_id"]): r["position"] for r in numbers.collect()}
    assert before.items() <= after.items() and len(set(after.values())) == len(after) and set(after) == {(t, u) for t, u, *_ in one + two if u}
    cells = cells.unionByName(bitmaps.daily_bitmaps(second, numbers, "event_name"))
    for period in ("day", "week", "month"):
        exact = first.union(second).filter("user_id <> ''").groupBy("tenant_id", start_of(period, F.col("event_date")).alias("start")).agg(F.count_distinct("user_id").alias("users"))
        assert sorted(bitmaps.active_users(cells, start_of(period, F.col("event_date"))).collect()) == sorted(exact.collect())
    days = {}
    for t, u, _, d in one + two:
        if u:
            days.setdefault((t, d), set()).add(u)
    for after_days in (1, 7):
        want = {(t, d, len(us), len(us & days.get((t, d + timedelta(days=after_days)), set()))) for (t, d), us in days.items()}
        assert {tuple(r) for r in bitmaps.returning_users(cells, after_days).collect()} == want
    with pytest.raises(ValueError):
        bitmaps.returning_users(cells, 0)


def test_bitmaps_of_nothing(spark, tmp_path):
    _, none = drawn(spark, 0, 1)
    numbers = bitmaps.extend_dictionary(none, str(tmp_path / "users"))
    assert numbers.count() == 0 and bitmaps.read_dictionary(spark, str(tmp_path / "other")) is None
    assert bitmaps.active_users(bitmaps.daily_bitmaps(none, numbers), F.col("event_date")).count() == 0


def test_sketches_stay_within_their_bounds(spark):
    """40,000 users of two cohorts, beyond what a sketch of 4,096 entries holds exactly."""
    users = spark.range(40_000).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).cast("int").alias("cohort"))
    kept = users.filter("cast(user_id as int) % 5 < 2").select("user_id", F.lit(1).alias("start"))
    found = sketches.sketch_retention(sketches.user_sketches(users, "cohort"), sketches.user_sketches(kept, "start"), F.col("start") - F.col("cohort")).collect()
    assert {(r["cohort"], r["period"]) for r in found} == {(0, 1), (1, 0)}
    for r in found:
        assert r["users"] == pytest.approx(20_000, rel=0.08) and r["retained"] == pytest.approx(8_000, abs=5 * 20_000 / 64)
    rest = sketches.others_than(sketches.user_sketches(users, "cohort"), "cohort").collect()
    assert all(r["others"] == pytest.approx(20_000, rel=0.15) for r in rest)
    merged = sketches.merge_sketches(sketches.user_sketches(users.withColumn("day", F.expr("cast(user_id as int) % 7")), "cohort", "day"), "cohort")
    assert all(r["n"] == pytest.approx(20_000, rel=0.08) for r in merged.select(F.theta_sketch_estimate("users").alias("n")).collect())


def test_bucketed_sketches_count_others_exactly(spark):
    """20,000 users; key 2 has three of them, so most buckets have no sketch of it."""
    users = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 2).cast("int").alias("key"))
    users = users.union(users.filter("user_id in ('5', '6', '7')").withColumn("key", F.lit(2)))
    parts = sketches.user_sketches(users, "key", buckets=sketches.exact_buckets(users))
    assert {tuple(r) for r in sketches.others_than(parts, "key").collect()} == {(0, 10_000, 10_000), (1, 10_000, 10_000), (2, 3, 19_997)}
    nobody = users.filter("key = 9")
    assert sketches.others_than(sketches.user_sketches(nobody, "key", buckets=sketches.exact_buckets(nobody)), "key").count() == 0


def test_bucketed_sketches_count_retention_of_small_cohorts_exactly(spark):
    """A cohort of 20 and one of 19,980; all of the large one and 10 of the small are active in month 1, nobody but one user in month 2."""
    users = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"), F.when(F.col("id") < 20, 0).otherwise(1).alias("cohort"), "id")
    active = users.filter("id >= 10").withColumn("start", F.lit(1)).union(users.filter("id = 7").withColumn("start", F.lit(2)))
    buckets = sketches.exact_buckets(users)
    found = sketches.sketch_retention(sketches.user_sketches(users, "cohort", buckets=buckets), sketches.user_sketches(active, "start", buckets=buckets), F.col("start") - F.col("cohort"))
    assert {tuple(r) for r in found.collect()} == {(0, 1, 20, 10), (0, 2, 20, 1), (1, 0, 19_980, 19_980), (1, 1, 19_980, 0)}



def test_erfc_and_p_values_are_those_of_the_library(spark):
    rows = spark.range(0, 10_001).select((F.col("id") / 10.0).alias("chi2")).select("chi2", p_values(F.col("chi2")).alias("p"), erfc(F.sqrt("chi2")).alias("e")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(p_value(r["chi2"]), rel=1e-9, abs=0)
        want = math.erfc(math.sqrt(r["chi2"]))
        assert r["e"] == pytest.approx(want, rel=1e-9, abs=5e-324)
    fine = spark.range(0, 2001).select((F.col("id") / 500.0).alias("x")).select("x", erfc(F.col("x")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-10) for r in fine)


def test_activation_reads_the_events_twice(spark, tmp_path):
    """Once for single events and totals, once for pairs."""
    rows = [(f"u{i}", date(2026, 1, 1) + timedelta(days=d), f"e{(i + d) % 4}") for i in range(60) for d in (0, 3, 40 if i % 2 else 5)]
    spark.createDataFrame(rows, "user_id string, event_date date, event_name string").write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    table = activation.contingency(events)
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r["users"] for r in table.collect()} == {60}
    assert activation.contingency(events.limit(0)).count() == 0
    assert activation.activation_summary(events.limit(0))["total_users"] == 0


def test_features_read_the_events_once(spark, tmp_path, monkeypatch):
    """The cells are made in one scan; all that follows reads their checkpoint."""
    rows = [(f"u{i}", date(2026, 1, 1) + timedelta(days=d), f"e{(i + d) % 4}" if d else None) for i in range(60) for d in (0, 3, 40 if i % 2 else 5)]
    spark.createDataFrame(rows, "user_id string, event_date date, event_name string").write.parquet(str(tmp_path / "e"))
    made = []
    cells = features._cells
    monkeypatch.setattr(features, "_cells", lambda pairs, periods: made.append(pairs) or cells(pairs, periods))
    found = features.feature_correlation(spark.read.parquet(str(tmp_path / "e")), [7, 30])
    assert "FileScan parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r["event_name"]: r["unique_users"] + r["non_users"] for r in found.collect()} == {n: 60 for n in ("e0", "e1", "e2", "e3")}  # every user has the null one, so it has no others
    assert features.feature_correlation(spark.read.parquet(str(tmp_path / "e")).limit(0)).count() == 0
