"""Maintained views: any split into batches, with any compaction, is one scan of the events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import metrics
from larkspur.streaming import incremental, views
from larkspur.streaming.folders import folders

SCHEMA = "tenant_id string, event_id string, user_id string, event_name string, event_type string, timestamp timestamp, event_date date, session_id string, ai_model string, ai_feature string, source_system string, ai_quality_score double, ai_cost_usd double"


def events(spark, n, start=0):
    t = datetime(2026, 1, 1)
    rows = []
    for i in range(start, start + n):
        at = t + timedelta(hours=i * 5)
        rows.append(("t", str(i), ["", "a", "b", "c", None][i % 5], f"e{i % 3}", "track", at, at.date(), f"s{i // 4}", "m" if i % 2 else "", f"f{i % 4}" if i % 2 else "", f"src{i % 2}", (i % 7) / 7, (i % 3) / 10))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def of_users(states):
    return rows_of(metrics.profiles_of(states)), rows_of(metrics.cohorts_of(states))


def test_batches_and_snapshots_are_one_scan(spark, tmp_path):
    kept = views.MaintainedView(spark, str(tmp_path), views.VIEWS[0])
    with pytest.raises(FileNotFoundError):
        kept.read()
    assert kept.compact(5) == -1
    want = {n: of_users(metrics.user_states(events(spark, n))) for n in (20, 40, 60)}
    kept.put(events(spark, 20), 0)
    assert of_users(kept.read()) == want[20]
    kept.put(events(spark, 20, 20), 1)
    kept.put(events(spark, 20, 20), 1)  # run again after a failure
    assert of_users(kept.read()) == want[40]
    assert kept.compact(1) == kept.compact(0) == kept.version() == 1
    assert of_users(kept.read()) == want[40]
    kept.put(events(spark, 20, 40), 2)
    assert of_users(kept.read()) == want[60]
    # A compaction that ends before its commit leaves a folder that no one reads.
    kept.view.merge(kept._parts()[1]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{kept.path}/snapshot/upto=2")
    assert kept.version() == 1 and of_users(kept.read()) == want[60]
    assert kept.compact(2) == 2 and of_users(kept.read()) == want[60]
    assert kept.vacuum() == ["upto=0", "upto=1", "upto=2", "upto=1"] and folders(spark, f"{kept.path}/snapshot") == ["upto=2"]
    assert of_users(kept.read()) == want[60]


@pytest.mark.parametrize("view", views.VIEWS[1:])
def test_daily_views_merge_to_the_reports_of_one_scan(spark, tmp_path, view):
    kept = views.MaintainedView(spark, str(tmp_path), view)
    for batch in range(3):
        kept.put(events(spark, 20, 20 * batch), batch)
        if batch:
            kept.compact(batch - 1)
    one = rows_of(metrics.merge_daily(view.states(events(spark, 60)), ["event_date"]))
    assert rows_of(metrics.merge_daily(kept.read(), ["event_date"])) == one


def test_a_point_lookup_reads_one_bucket(spark, tmp_path):
    kept = views.MaintainedView(spark, str(tmp_path), views.VIEWS[0])
    kept.put(events(spark, 60), 0)
    kept.compact(0)
    snapshot = spark.read.parquet(f"{kept.path}/snapshot/upto=0")
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("a")), F.lit(views.BUCKETS))).first()[0]
    found = snapshot.filter((F.col("bucket") == bucket) & (F.col("user_id") == "a"))
    assert found.count() == 1 and "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()


def test_a_stream_keeps_its_views(spark, tmp_path):
    folder, views_at = str(tmp_path / "in"), str(tmp_path / "views")
    for batch in range(5):
        events(spark, 12, 12 * batch).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = views.write_views(source, views_at, str(tmp_path / "cp"), every=2)
    q.processAllAvailable()
    q.stop()
    kept = {v.name: views.MaintainedView(spark, views_at, v) for v in views.VIEWS}
    assert {k.version() for k in kept.values()} == {3}
    assert of_users(kept["users"].read()) == of_users(metrics.user_states(events(spark, 60)))
    assert metrics.merge_daily(kept["feature_usage"].read(), ["tenant_id"]).first()["events"] == 60
    recent = f"{views_at}/recent_events"
    assert spark.read.parquet(recent).count() == 60
    gone = incremental.expire_days(spark, recent, "2026-01-03")
    assert gone == ["event_date=2026-01-01", "event_date=2026-01-02"] and incremental.expire_days(spark, str(tmp_path / "nowhere"), "2026") == []
