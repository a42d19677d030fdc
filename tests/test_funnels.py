"""Funnels in pieces and on a stream against the chain over whole users."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators.funnel import Funnel, Step
from larkspur.streaming import funnels

SCHEMA = "tenant_id string, event_id string, user_id string, event_name string, timestamp timestamp, event_date date"
STEPS = [Step("a"), Step("b"), Step("c"), Step(condition="event_name in ('a', 'c')", label="again")]
DATES = ("2026-01-01", "2026-12-31")


def drawn(n, users, seed, minutes=3000):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = datetime(2026, 1, 1) + timedelta(minutes=draw.randint(0, minutes))
        rows.append(("t", f"{draw.randint(0, 9)}-{i:05d}", f"u{draw.randint(1, users)}", draw.choice("aabcx"), at, at.date()))
    return rows


@pytest.mark.parametrize(("split", "window", "steps"), [(600, 3600, STEPS), (3600, 5400, STEPS[:3]), (60, 20_000, STEPS), (10**6, 3600, STEPS[:2])])
def test_pieces_give_the_levels_of_whole_users(spark, split, window, steps):
    rows = drawn(1500, 40, split) + drawn(500, 1, window, 400)
    events = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (Funnel(events, "t", steps, *DATES, window_seconds=window, split_seconds=s) for s in (None, split))
    assert sorted(whole.levels().collect()) == sorted(cut.levels().collect())
    assert whole.totals().collect() == cut.totals().collect() and whole.by_date().collect() == cut.by_date().collect()
    assert len({r["max_step"] for r in whole.levels().collect()}) > 1


def test_one_giant_user_is_the_work_of_several_tasks(spark):
    events = spark.range(200_000).select(F.lit("t").alias("tenant_id"), F.lpad(F.col("id").cast("string"), 7, "0").alias("event_id"), F.lit("u").alias("user_id"), F.element_at(F.array(*map(F.lit, "axxbxxxcxx")), (F.xxhash64("id") % 5 + 5).cast("int")).alias("event_name"), F.timestamp_seconds(1_767_225_600 + F.col("id") * 30).alias("timestamp"))
    events = events.withColumn("event_date", F.to_date("timestamp"))
    cut = Funnel(events, "t", STEPS, *DATES, window_seconds=600, split_seconds=86_400)
    plan = cut.levels(entry_date=False)._jdf.queryExecution().executedPlan().toString()
    first_shuffle = plan.split("hashpartitioning(")[-1].split(")")[0]
    assert "piece" in first_shuffle
    assert cut.totals().collect() == Funnel(events, "t", STEPS, *DATES, window_seconds=600).totals().collect()
    with pytest.raises(ValueError):
        Funnel(events, "t", STEPS, *DATES, split_seconds=0)


def test_a_stream_in_any_order_ends_with_the_batch_counts(spark, tmp_path):
    rows = drawn(600, 25, 7, 600)
    source, levels = str(tmp_path / "in"), str(tmp_path / "levels")

    def run(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        told = funnels.funnel_levels(Funnel(stream, "t", STEPS, *DATES, window_seconds=3600), "11 hours")
        q = told.writeStream.format("parquet").option("path", levels).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    # Rows come shuffled over batches and restarts; the last rows move the watermark behind all of them.
    for part in range(3):
        run(rows[part::3])
    far = datetime(2026, 1, 9)
    run([("t", "z", "nobody", "x", far, far.date()), ("t", "z2", "nobody2", "a", far, far.date())])
    late = datetime(2026, 1, 1)
    run([("t", "late", "u-late", "a", late, late.date()), ("t", "z3", "nobody", "x", far + timedelta(days=1), far.date())])
    funnel = Funnel(spark.createDataFrame(rows, SCHEMA), "t", STEPS, *DATES, window_seconds=3600)
    found = spark.read.parquet(levels).filter("user_id <> 'nobody2'")
    assert funnels.step_counts(found, funnel).collect() == funnel.totals().collect()
    assert {r["user_id"]: r["m"] for r in found.groupBy("user_id").agg(F.max("max_step").alias("m")).collect()} == {r["user_id"]: r["max_step"] for r in funnel.levels(entry_date=False).filter("max_step > 0").collect()}
