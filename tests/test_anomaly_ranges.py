"""Windows over ranges of a series against one window over the whole series."""

import random
from datetime import date, timedelta

import pytest

from larkspur.operators.anomaly import detect_anomalies, score_points


def drawn(seed):
    draw = random.Random(seed)
    rows = []
    for metric, n, step in (("dense", 150, 1), ("sparse", 60, 37), ("short", 3, 1), ("gaps", 80, 5)):
        day = date(2020, 1, 1)
        for _ in range(n):
            day += timedelta(days=draw.randint(1, step) if metric != "dense" else 1)
            rows.append((metric, day, None if draw.random() < 0.05 else round(draw.gauss(100, 5) + (60 if draw.random() < 0.05 else 0), 3)))
    return rows


@pytest.mark.parametrize(("window", "days"), [(4, 10), (7, 3), (4, 1), (3, 10_000)])
def test_ranges_with_halos_score_as_the_whole_series(spark, window, days):
    series = spark.createDataFrame(drawn(days), "metric string, date date, value double")
    plain = lambda df: sorted((r["metric"], r["date"], r["value"], round(r["expected"], 9), round(r["sigma_distance"], 6)) for r in df.collect())
    whole = plain(score_points(series, window))
    assert plain(score_points(series, window, range_days=days)) == whole and len(whole) > 200
    assert detect_anomalies(series, 2.0, window).count() == detect_anomalies(series, 2.0, window, range_days=days).count() > 0


def test_points_are_windowed_by_range(spark):
    series = spark.createDataFrame(drawn(1), "metric string, date date, value double")
    plan = score_points(series, 4, range_days=10)._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Window [")[1].split("\n")[0]
    assert "metric" in first and "range" in first
    with pytest.raises(ValueError):
        score_points(series, range_days=0)
