"""Heavy hitters: bounds that hold in any split, certain items that are among the heaviest, summaries of bounded size."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import heavy_hitters
from larkspur.streaming import views

SCHEMA = "tenant_id string, event_date date, event_name string, w long"


def drawn(spark, n, days, names, seed):
    """Names by a long-tailed law, two tenants; some null."""
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), date(2026, 1, 1) + timedelta(days=draw.randrange(days)), draw.choice([None, *[f"n{int(names * draw.random() ** 3)}"] * 9]), draw.randint(0, 5)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def weights(rows, weigh=lambda r: 1):
    found = {}
    for r in rows:
        if r[2] is not None:
            found.setdefault(r[0], Counter())[r[2]] += weigh(r)
    return found


def check(summary, exact, size):
    """Bounds of one merged summary against exact weights by tenant."""
    got = {}
    for r in summary.collect():
        got.setdefault(r["tenant_id"], []).append(r)
    for tenant, counts in exact.items():
        rest = sum(r["above"] for r in got[tenant] if not r["listed"])
        listed = {r["item"]: r for r in got[tenant] if r["listed"]}
        assert len(listed) <= size and len(got[tenant]) <= size + 2
        for item, n in counts.items():
            if item in listed:
                assert listed[item]["low"] <= n <= listed[item]["above"] + rest
            else:
                assert n <= rest


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_bounds_hold_over_days_weeks_and_batches(spark, size):
    rows, events = drawn(spark, 6000, 30, 300, size)
    exact = weights(rows)
    days = heavy_hitters.item_summaries(events, "tenant_id", "event_date", size=size)
    check(heavy_hitters.merge_summaries(days, "tenant_id", size=size), exact, size)
    weeks = heavy_hitters.merge_summaries(days.withColumn("week", F.weekofyear("event_date")), "tenant_id", "week", size=size)
    twice = heavy_hitters.merge_summaries(weeks, "tenant_id", size=size)
    check(twice, exact, size)
    for k in (1, 5, 20):
        top = heavy_hitters.top_items(twice, k, "tenant_id").collect()
        for tenant, counts in exact.items():
            mine = [r for r in top if r["tenant_id"] == tenant]
            assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, len(mine) + 1))
            kth = sorted(counts.values(), reverse=True)[k - 1]
            assert all(counts[r["item"]] >= kth for r in mine if r["certain"])
            if size == 1000:
                assert len(mine) == k and all(r["certain"] and r["low"] == r["high"] == counts[r["item"]] for r in mine)


def test_heavy_items_are_found_with_weights(spark):
    rows, events = drawn(spark, 8000, 90, 500, 3)
    exact = weights(rows, lambda r: r[3])
    days = heavy_hitters.item_summaries(events, "tenant_id", "event_date", weight=F.col("w"), size=25)
    merged = heavy_hitters.merge_summaries(days, "tenant_id", size=100)
    check(merged, exact, 100)
    for r in heavy_hitters.top_items(merged, 3, "tenant_id").collect():
        assert r["low"] <= exact[r["tenant_id"]][r["item"]] <= r["high"]


def test_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    merged = heavy_hitters.merge_summaries(heavy_hitters.item_summaries(empty, "tenant_id"), "tenant_id")
    assert heavy_hitters.top_items(merged, 3, "tenant_id").collect() == []
    nulls = spark.createDataFrame([(None, None, "x", None), (None, None, "x", 2), (None, None, None, 9), ("a", None, "", 1)], SCHEMA)
    got = heavy_hitters.top_items(heavy_hitters.item_summaries(nulls, "tenant_id", weight=F.col("w")), 5, "tenant_id").collect()
    assert {(r["tenant_id"], r["item"], r["low"], r["high"], r["certain"]) for r in got} == {(None, "x", 2, 2, True), ("a", "", 1, 1, True)}
    for wrong in (lambda: heavy_hitters.item_summaries(nulls, "tenant_id", size=0), lambda: heavy_hitters.top_items(nulls, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_only_few_rows_of_a_key_leave_a_task(spark):
    _, events = drawn(spark, 100, 2, 50, 5)
    plan = heavy_hitters.item_summaries(events, "tenant_id", "event_date", size=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_a_maintained_view_of_top_features(spark, tmp_path):
    rows, events = drawn(spark, 3000, 10, 200, 8)
    view = views.top_view(size=30)
    kept = views.MaintainedView(spark, str(tmp_path), view)
    for batch in range(3):
        kept.put(events.filter(F.pmod(F.xxhash64("tenant_id", "event_date", "event_name", "w"), F.lit(3)) == batch), batch)
        if batch == 1:
            kept.compact(1)
    check(heavy_hitters.merge_summaries(kept.read(), "tenant_id", size=30), weights(rows), 30)
