"""Hand-made frames: edges, ties, empty input, and the window chain against a step-by-step funnel."""

import math
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions.statistics import chi_square_cut, p_value
from larkspur.operators import activation, anomaly, churn, cohort, features, funnel, metrics, retention
from larkspur.schema import normalize_events, split_valid, to_table_rows, write_events
from larkspur.sources import readers

DAY0 = date(2026, 1, 1)


def frame(spark, rows, schema="user_id string, event_date date, event_name string"):
    return spark.createDataFrame(rows, schema)


def at(n):
    return DAY0 + timedelta(days=n)


def table(spark, rows):
    """(user, day, name) or (user, datetime, name, id) rows as flat events."""
    full = []
    for i, r in enumerate(rows):
        when = r[1] if isinstance(r[1], datetime) else datetime(2026, 1, 1) + timedelta(days=r[1])
        full.append(("t1", r[3] if len(r) > 3 else f"{i:04d}", r[0], r[2], "track", when, when.date(), f"{r[0]}-s", "", "custom", "", "", 0.0, 0.0, {}))
    return spark.createDataFrame(full, "tenant_id string, event_id string, user_id string, event_name string, event_type string, timestamp timestamp, event_date date, session_id string, page_path string, source_system string, ai_model string, ai_feature string, ai_quality_score double, ai_cost_usd double, user_properties_set map<string,string>")


def test_bounded_retention_of_one_user(spark):
    s = retention.retention_summary(frame(spark, [("u1", at(0), "x"), ("u1", at(1), "x"), ("u1", at(7), "x")]), [1, 7, 30])
    assert s["overall_retention"] == {"D1": 1.0, "D7": 1.0, "D30": 0.0} and s["total_users"] == 1 and s["best_cohort"] is None


def test_retention_of_nothing_and_of_null_cohorts(spark):
    empty = retention.retention_summary(readers.empty_events(spark), [1, 7])
    assert empty["total_users"] == 0 and empty["overall_retention"] == {"D1": 0.0, "D7": 0.0} and empty["cohorts"] == []
    rows = spark.createDataFrame([("a", at(0), "x", None), ("a", at(2), "x", "pro"), ("b", at(0), "x", "free"), ("", at(0), "x", "free"), (None, at(0), "x", "free")], "user_id string, event_date date, event_name string, plan string")
    got = {r["cohort_key"]: (r["cohort_size"], r["retained_1"]) for r in retention.retention_curves(rows, [1], "plan").collect()}
    assert got == {None: (1, 1), "free": (1, 0)}


def test_a_large_tenant_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), F.col("id") % 500).alias("user_id"), F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.lit(1767225600) + F.col("id")).alias("timestamp")).withColumns({"event_date": F.to_date("timestamp"), "event_name": F.lit("x"), "session_id": F.lit("")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_events(rows, str(tmp_path / "w"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "w" / "tenant_id=t" / "event_month=202601").glob("*.parquet"))) >= 3 and spark.read.parquet(str(tmp_path / "w")).count() == 4000


def test_period_bounds_follow_the_list_order(spark):
    rows = frame(spark, [("u", at(0), "x"), ("u", at(10), "x")])
    r = retention.retention_curves(rows, [30, 7]).first()
    assert (r["retained_30"], r["retained_7"]) == (0, 1)


def test_weeks_start_on_sunday_in_matrices_and_on_monday_in_curves(spark):
    rows = table(spark, [("u", 3, "x"), ("u", 4, "x")])  # 2026-01-04 is a Sunday
    assert retention.retention_matrix(rows, "t1", "2026-01-01", "2026-12-31", num_periods=2).first()["cohort_date"] == date(2026, 1, 4)
    assert retention.retention_curves(rows, [1]).first()["cohort_key"] == date(2025, 12, 29)


def test_the_filter_of_a_simple_matrix_is_on_cohorts_only(spark):
    rows = table(spark, [("u", 0, "a"), ("u", 1, "b"), ("v", 0, "b")])
    r = retention.retention_simple(rows, "t1", "2026-01-01", "2026-12-31", "day", 2, event_filter="event_name = 'a'").collect()
    assert [(x["cohort_size"], x["period_0"], x["period_1"]) for x in r] == [(1, 1, 1)]


def test_dau(spark):
    rows = frame(spark, [("u1", at(0), "x"), ("u2", at(0), "x"), ("u1", at(1), "x"), ("u3", at(1), "x"), ("u2", at(2), "x"), ("", at(2), "x")])
    assert [r["value"] for r in metrics.dau_series(rows).orderBy("date").collect()] == [2.0, 2.0, 1.0]


def step_by_step(rows, names, window):
    """The funnel read event by event: levels[i] holds the start time of the latest chain of length i."""
    levels = [None] * (len(names) + 1)
    for when, _, name in sorted(rows):
        new = list(levels)
        for i, wanted in enumerate(names, 1):
            if name == wanted:
                if i == 1:
                    new[1] = when
                elif levels[i - 1] is not None and when <= levels[i - 1] + window:
                    new[i] = levels[i - 1] if new[i] is None else max(new[i], levels[i - 1])
        levels = new
    return max(i for i in range(len(names) + 1) if i == 0 or levels[i] is not None)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("uvw"), st.integers(0, 12), st.sampled_from("abcx")), min_size=1, max_size=30))
def test_the_window_chain_equals_reading_step_by_step(spark, rows):
    data = [(u, datetime(2026, 1, 1) + timedelta(hours=h), n, f"{i:03d}") for i, (u, h, n) in enumerate(rows)]
    f = funnel.Funnel(table(spark, data), "t1", [funnel.Step(x) for x in "abc"], "2026-01-01", "2026-12-31", 4 * 3600)
    got = {r["user_id"]: r["max_step"] for r in f.levels().collect()}
    assert got == {u: step_by_step([(d[1], d[3], d[2]) for d in data if d[0] == u], "abc", timedelta(hours=4)) for u in {r[0] for r in rows}}


def test_funnel_edges_labels_and_errors(spark):
    t0 = datetime(2026, 1, 1)
    rows = table(spark, [("u", t0, "a b"), ("u", t0 + timedelta(seconds=60), "c!"), ("v", t0, "a b"), ("v", t0 + timedelta(seconds=61), "c!"), ("w", t0, "c!"), ("w", t0 + timedelta(seconds=1), "a b")])
    f = funnel.Funnel(rows, "t1", [funnel.Step("a b"), funnel.Step(condition="event_name = 'c!'", label="c!")], "2026-01-01", "2026-01-31", 60)
    assert f.totals().first().asDict() == {"total_entered": 3, "step_1_a_b": 3, "step_2_c_": 1}
    with pytest.raises(ValueError):
        funnel.Funnel(rows, "t1", [funnel.Step("a")], "2026-01-01", "2026-01-31")
    with pytest.raises(ValueError):
        funnel.Step()


def test_cohorts_by_property_and_first_event(spark):
    rows = table(spark, [("u", 0, "a"), ("u", 1, "b"), ("v", 0, "b")])
    got = cohort.Cohorts(rows, "t1", "2026-01-01", "2026-12-31", "first_event").comparison("b").collect()
    assert [(r["cohort_value"], r["metric_events"], r["users_with_metric"], r["metric_rate"]) for r in got] == [("a", 1, 1, 1.0), ("b", 1, 1, 1.0)]
    assert cohort.Cohorts(rows, "t1", "2026-01-01", "2026-12-31", "property", "plan").summary().first()["property_plan"] == ""
    with pytest.raises(ValueError):
        cohort.Cohorts(rows, "t1", "2026-01-01", "2026-12-31", "property")


def series(spark, values, name="m"):
    return spark.createDataFrame([(name, at(i), float(v)) for i, v in enumerate(values)], "metric string, date date, value double")


def test_anomalies(spark):
    assert anomaly.detect_anomalies(series(spark, [100] * 12)).count() == 0
    assert anomaly.detect_anomalies(series(spark, [1, 2, 99])).count() == 0
    found = anomaly.detect_anomalies(series(spark, [0, 0, 0, 0, 5])).first()
    assert math.isinf(found["sigma_distance"]) and math.isinf(found["pct_change"]) and found["severity"] == "critical" and found["direction"] == "up"
    s = anomaly.anomaly_summary(series(spark, [0, 0, 0, 0, 5]))
    assert s["anomalies"][0]["sigma_distance"] == "inf" and s["critical_count"] == 1
    assert anomaly.detect_anomalies(series(spark, [100, 100, 100, 100, 102])).first()["sigma_distance"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(series(spark, [1]), sigma_threshold=0)


def test_features_and_planted_effect(spark):
    rows = []
    for i in range(40):
        rows.append((f"u{i:02d}", at(0), "good" if i < 20 else "bad"))
        if i < 15 or i >= 36:
            rows.append((f"u{i:02d}", at(40), "return"))
    got = {r["event_name"]: r for r in features.feature_correlation(frame(spark, rows)).collect()}
    assert got["good"]["impact_30"] == pytest.approx(0.75 - 0.2) and got["good"]["normalized_30"] == pytest.approx(0.55)
    assert got["bad"]["is_negative"] and not got["good"]["is_negative"] and got["good"]["net_score"] > 0
    raw = {r["event_name"]: r for r in features.feature_correlation(frame(spark, rows), normalize_max_users=10).collect()}
    assert raw["good"]["normalized_7"] == raw["good"]["impact_7"]
    assert features.feature_correlation(readers.empty_events(spark)).count() == 0
    assert features.feature_summary(readers.empty_events(spark))["total_features"] == 0


def test_activation_finds_the_planted_event(spark):
    rows = []
    for i in range(60):
        rows.append((f"u{i:02d}", at(0), "signup"))
        if i < 30:
            rows.append((f"u{i:02d}", at(7), "setup"))
        if i < 25 or i >= 56:
            rows.append((f"u{i:02d}", at(35), "back"))
    s = activation.activation_summary(frame(spark, rows))
    top = s["top_moments"][0]
    assert top["events"] == ["setup"] and top["label"] == "setup ≥1 time" and top["adopters"] == 30 and top["lift"] == pytest.approx(6.25) and top["p_value"] < 0.001
    assert activation.impact_score(3.0, 0.3) == pytest.approx(1.4) and activation.label(["a", "b"], 2) == "a + b ≥2 times"
    assert activation.activation_summary(readers.empty_events(spark))["baseline_retention"] == 0.0


def test_statistics(spark):
    from larkspur.functions.statistics import chi_square, matthews

    lit = lambda *x: [F.lit(v) for v in x]
    one = spark.range(1)
    assert [one.select(matthews(*lit(*t))).first()[0] for t in ((50, 0, 0, 50), (25, 25, 25, 25), (0, 0, 0, 0), (4_000_000_000, 0, 0, 4_000_000_000))] == [1.0, 0.0, 0.0, 1.0]
    p = [p_value(one.select(chi_square(*lit(*t))).first()[0]) for t in ((80, 100, 20, 100), (50, 100, 50, 100), (52, 100, 48, 100), (0, 0, 0, 0), (10, 10, 0, 10))]
    assert p[0] < 0.001 and p[1] > 0.5 and p[2] > 0.05 and p[3] == 1.0 and p[4] < 0.001
    assert chi_square_cut(0.05) == pytest.approx(3.841459, abs=1e-5)


def test_churn_stages(spark):
    last = date(2026, 3, 1)
    ago = lambda d: last - timedelta(days=d)
    rows = [("thriving", ago(d), n) for d in range(28) for n in (["search"] + (["dashboard", "export"] if d % 3 == 0 else []))]
    rows += [("fading", ago(d), n) for d in range(14, 28) for n in ("search", "dashboard", "export")] + [("fading", ago(5), "search")]
    rows += [("ghosting", ago(d), "search") for d in (16, 20)] + [("gone", ago(25), "search"), ("gone", ago(26), "dashboard")]
    got = {r["user_id"]: r for r in churn.churn_users(frame(spark, rows), "2026-03-01").collect()}
    assert got["thriving"]["stage"] == "thriving" and got["thriving"]["health_score"] >= 70 and not got["thriving"]["signals"]
    assert got["fading"]["stage"] == "fading" and len(got["fading"]["signals"]) >= 2
    assert got["ghosting"]["stage"] in ("ghosting", "gone") and "absence" in got["ghosting"]["signals"] and got["gone"]["health_score"] < 20
    s = churn.churn_summary(frame(spark, rows), "2026-03-01")
    assert s["total_users"] == 4 and s["at_risk_count"] == 3 and sum(s["stage_distribution"].values()) == 4
    assert churn.churn_summary(readers.empty_events(spark))["total_users"] == 0


def test_jsonl_csv_and_sampling(spark, tmp_path):
    lines = tmp_path / "e.jsonl"
    lines.write_text('{"user_id":"a","event_date":"2026-01-02","event_name":"x"}\n\nnot json\n{"distinct_id":"b","timestamp":"2026-01-03T23:00:00-05:00","event":"y"}\n{"user_id":"c","event_date":"soon"}\n')
    assert sorted(map(tuple, readers.load_events(spark, str(lines)).collect())) == [("a", date(2026, 1, 2), "x"), ("b", date(2026, 1, 3), "y")]
    csv = tmp_path / "c.csv"
    csv.write_text("event_time,event_type,brand,user_id,category_code\n2019-11-01 00:00:00 UTC,view,z,1,a.b\n2019-11-02 00:00:00 UTC,cart,z,2,\n")
    assert sorted(map(tuple, readers.load_events(spark, str(csv)).collect())) == [("1", date(2019, 11, 1), "view"), ("2", date(2019, 11, 2), "cart")]
    assert readers.load_events(spark, str(csv), 1).count() == 1
    assert readers.load_events(spark, str(tmp_path / "none.jsonl")).count() == 0
    got = readers.commerce_to_events(spark.createDataFrame([("2019-11-01 00:00:00 UTC", "view", "1", "a.b")], "event_time string, event_type string, user_id string, category_code string"))
    assert sorted(r["event_name"] for r in got.collect()) == ["browse_a", "view"]
    with pytest.raises(ValueError):
        readers.append_feedback(str(tmp_path / "f.jsonl"), 1, "maybe")
    assert normalize_events(spark.createDataFrame([(1, "2026-01-02T00", "x")], "user_id long, event_date string, event_name string")).first()[0] == "1"


def test_canonical_rows_are_validated_flattened_and_written(spark, tmp_path):
    row = dict(tenant_id="t", event_id="1", user_id="u", event_name="n", event_type="track", timestamp=datetime(2026, 1, 2), source_system="custom", country="DE")
    rows = spark.createDataFrame([row, row | {"event_id": "2", "user_id": "", "event_type": "odd", "country": "de"}])
    valid, bad = split_valid(rows)
    assert valid.count() == 1 and set(bad.first()["violations"]) == {"identity", "event_type", "country"}
    flat = to_table_rows(valid)
    assert flat.first()["device_type"] == "unknown" and flat.first()["ai_model"] == "" and flat.first()["event_date"] == date(2026, 1, 2)
    write_events(flat, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).filter("tenant_id = 't' and event_month = 202601")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(tenant_id" in back._jdf.queryExecution().toString()


def test_filters_reach_the_scan_and_funnels_shuffle_once(spark, tmp_path):
    table(spark, [("u", 0, "a"), ("u", 1, "b")]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = metrics.Metrics(events, "t1", "2026-01-01", "2026-02-01").daily_active_users()._jdf.queryExecution().toString()
    assert "EqualTo(tenant_id,t1)" in plan and "ReadSchema: struct<tenant_id:string,user_id:string,event_date:date>" in plan
    f = funnel.Funnel(events, "t1", [funnel.Step(x) for x in "abc"], "2026-01-01", "2026-02-01").levels()
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_current_properties(spark):
    t = datetime(2026, 1, 1)
    rows = spark.createDataFrame([("t", "1", "u", t, {"a": "1", "b": "1"}, {"c": "1"}), ("t", "2", "u", t + timedelta(1), {"a": "2"}, {"c": "2", "a": "0"})], "tenant_id string, event_id string, user_id string, timestamp timestamp, user_properties_set map<string,string>, user_properties_set_once map<string,string>")
    assert metrics.current_properties(rows).first()["properties"] == {"a": "2", "b": "1", "c": "1"}
