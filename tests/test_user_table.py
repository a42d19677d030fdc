"""Tables in buckets of users: the same results, and no exchange of events by user."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import activation, churn, features, retention
from larkspur.sources.user_table import heaviest_user, save_by_user

SCHEMA = "tenant_id string, event_id string, user_id string, event_name string, event_date date, ai_model string"
ALL = ("2020-01-01", "2030-01-01")


def drawn(spark, n=3000, users=200, seed=1):
    draw = random.Random(seed)
    rows = [("t", str(i), draw.choice(["", None, *[f"u{draw.randrange(users)}"] * 12]), draw.choice("abcdef"), date(2026, 1, 1) + timedelta(days=draw.randint(0, 80)), "") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """(plain events, the table)."""
    folder = tmp_path_factory.mktemp("users")
    drawn(spark).write.parquet(f"{folder}/plain")
    plain = spark.read.parquet(f"{folder}/plain")
    assert save_by_user(plain, "events_by_user", f"{folder}/table", buckets=6, hot_buckets=4)
    yield plain, spark.read.table("events_by_user")
    spark.sql("drop table events_by_user")


ANALYSES = {
    "curves": lambda e: retention.retention_curves(e, [1, 7, 30]),
    "matrix": lambda e: retention.retention_simple(e, "t", *ALL),
    "churn": lambda e: churn.churn_users(e, "2026-03-20"),
    "features": lambda e: features.feature_correlation(e, [7, 30]),
    "activation": lambda e: activation.early_patterns(e).withColumn("names", F.sort_array("names")),
    "first_seen_join": lambda e: e.join(e.filter("user_id <> ''").groupBy("user_id").agg(F.min("event_date").alias("first")), "user_id").groupBy("first", "event_date").agg(F.count_distinct("user_id").alias("n")),
}


def exchanges(df: DataFrame) -> int:
    """Exchanges that partition by user_id, alone or with more columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning(user_id" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_results_are_the_same_without_an_exchange_by_user(name, both, spark, monkeypatch):
    plain, table = both
    rows = [sorted(map(str, ANALYSES[name](e).collect())) for e in both]
    assert rows[0] == rows[1] and rows[0]
    monkeypatch.setattr(type(plain), "checkpoint", lambda self, eager=True: self)  # so that a plan shows all its steps
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a broadcast would hide a shuffle that large tables need
    try:
        assert exchanges(ANALYSES[name](plain)) > 0
        assert exchanges(ANALYSES[name](table)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bucket_is_one_sorted_file_with_all_rows_of_its_users(both, spark):
    plain, table = both
    rows = table.select("user_id", F.input_file_name().alias("f")).collect()
    assert len(rows) == plain.filter("user_id <> ''").count()
    assert len({r["f"] for r in rows}) == 6
    assert all(len({r["f"] for r in rows if r["user_id"] == u}) == 1 for u in ("u1", "u2", "u3"))
    for f in {r["f"] for r in rows}:
        users = [r["user_id"] for r in spark.read.parquet(f).select("user_id").collect()]
        assert users == sorted(users)


def test_a_giant_user_gets_no_bucket(spark, tmp_path):
    plain = drawn(spark, 500).unionByName(drawn(spark, 300).withColumn("user_id", F.lit("giant")))
    assert heaviest_user(plain)[1] >= 300
    assert not save_by_user(plain, "giant_by_user", str(tmp_path / "t"), buckets=8)
    table = spark.read.table("giant_by_user")
    assert sorted(map(str, retention.retention_curves(table, [1, 7]).collect())) == sorted(map(str, retention.retention_curves(plain, [1, 7]).collect()))
    spark.sql("drop table giant_by_user")


def test_odd_input(spark, tmp_path):
    empty = drawn(spark, 5).limit(0)
    assert heaviest_user(empty) == (0, 0)
    assert save_by_user(empty, "none_by_user", str(tmp_path / "t"), buckets=3) and spark.read.table("none_by_user").count() == 0
    numbers = spark.createDataFrame([(1, "2026-01-02", "x"), (None, "2026-01-02", "x"), (2, "no day", None)], "user_id long, event_date string, event_name string")
    assert save_by_user(numbers, "none_by_user", str(tmp_path / "u"), buckets=3)
    assert sorted(map(tuple, spark.read.table("none_by_user").collect()), key=str) == [("1", date(2026, 1, 2), "x"), ("2", None, None)]
    spark.sql("drop table none_by_user")
    with pytest.raises(ValueError):
        save_by_user(numbers, "none_by_user", buckets=0)
