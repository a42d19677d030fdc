"""Anomalies of metric series against a rolling baseline of the points before."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import finite

CRITICAL = 3.0


def _in_ranges(rows: DataFrame, window: int, range_days: int) -> DataFrame:
    """rows (metric, date, value) with n, expected, sd, points, by ranges of days of each series.

    A range leaves its number of points and its last ``window`` ones; what the ranges before it left is its
    halo, from the nearest ``window`` ranges that have points, so a sparse series loses none. Only these small
    rows meet in a series' window; the points themselves are windowed where (metric, range) puts them.
    """
    at = F.coalesce(F.floor(F.unix_date(F.to_date("date")) / range_days), F.lit(-(1 << 40)))
    ranged = rows.withColumn("range", at)
    point = F.struct("date", "value")
    left = ranged.groupBy("metric", "range").agg(F.count(F.lit(1)).alias("own"), F.sort_array(F.collect_list(point)).alias("tail"))
    left = left.withColumn("tail", F.slice("tail", -F.least(F.lit(window), F.size("tail")), F.lit(window)))
    series, before = Window.partitionBy("metric"), Window.partitionBy("metric").orderBy("range").rowsBetween(-window, -1)
    halos = left.withColumns({"points": F.sum("own").over(series), "halo": F.flatten(F.collect_list("tail").over(before))})
    halos = halos.select("metric", "range", "points", F.when(F.size("halo") > window, F.slice("halo", -window, window)).otherwise(F.col("halo")).alias("halo"))
    own = ranged.select("metric", "range", "date", "value", F.lit(True).alias("own"), F.lit(None).cast("long").alias("points"))
    around = halos.select("metric", "range", "points", F.explode_outer("halo").alias("h")).select("metric", "range", "h.date", "h.value", F.lit(False).alias("own"), "points")
    both = own.unionByName(around)
    # A range without a halo still brings its series' number of points, in a row that no window counts.
    order = Window.partitionBy("metric", "range").orderBy("own", "date").rowsBetween(-window, -1)
    whole = Window.partitionBy("metric", "range")
    told = both.withColumns({"n": F.count("value").over(order), "expected": F.avg("value").over(order), "sd": F.stddev_samp("value").over(order), "points": F.max("points").over(whole)})
    return told.filter("own").select("metric", "date", "value", "n", "expected", "sd", "points")


def score_points(series: DataFrame, window: int = 4, min_data_points: int = 4, min_std_pct: float = 0.01, range_days: int | None = None) -> DataFrame:
    """metric, date, value, expected, sigma_distance for each point with a baseline.

    Baseline: mean and sample deviation of the ``window`` points before, of which max(2, window // 2)
    must exist. The deviation counts as at least min_std_pct of |mean|; where that is 0 too, a point
    equal to the mean has no score and any other an infinite one. Series of fewer than
    ``min_data_points`` points give nothing. One shuffle, by metric; a series is one task's window. With
    ``range_days`` a series is cut into ranges of so many days, each with a halo of the points before it, and
    a long series is as many tasks' work; the results are the same.
    """
    if window < 2 or min_data_points < 2:
        raise ValueError("window and min_data_points must be at least 2")
    if range_days is not None and range_days < 1:
        raise ValueError("range_days must be positive")
    rows = series.select("metric", "date", F.col("value").cast("double").alias("value"))
    if range_days:
        rows = _in_ranges(rows, window, range_days)
    else:
        before, whole = Window.partitionBy("metric").orderBy("date").rowsBetween(-window, -1), Window.partitionBy("metric")
        rows = rows.withColumns({"n": F.count("value").over(before), "expected": F.avg("value").over(before), "sd": F.stddev_samp("value").over(before), "points": F.count(F.lit(1)).over(whole)})
    rows = rows.filter((F.col("points") >= min_data_points) & (F.col("n") >= max(2, window // 2)) & F.col("value").isNotNull())
    spread = F.greatest(F.coalesce("sd", F.lit(0.0)), F.abs("expected") * min_std_pct)
    off = F.abs(F.col("value") - F.col("expected"))
    sigma = F.when(spread > 0, off / spread).when(off > 0, F.lit(float("inf")))
    return rows.withColumn("sigma_distance", sigma).filter(F.col("sigma_distance").isNotNull()).select("metric", "date", "value", "expected", "sigma_distance")


def detect_anomalies(series: DataFrame, sigma_threshold: float = 2.0, window: int = 4, min_data_points: int = 4, min_std_pct: float = 0.01, range_days: int | None = None) -> DataFrame:
    """Points at ``sigma_threshold`` or more, with direction, severity and pct_change; critical ones first, then by distance.

    Distances that agree to six digits are equal there (sums in another order change the last digits): by metric and date.
    """
    if sigma_threshold <= 0:
        raise ValueError("sigma_threshold must be positive")
    if min_std_pct < 0:
        raise ValueError("min_std_pct must not be negative")
    found = score_points(series, window, min_data_points, min_std_pct, range_days).filter(F.col("sigma_distance") >= sigma_threshold)
    v, m = F.col("value"), F.col("expected")
    return found.select(
        "*", F.when(v > m, "up").otherwise("down").alias("direction"), F.when(F.col("sigma_distance") >= CRITICAL, "critical").otherwise("warning").alias("severity"), F.when(m != 0, (v - m) / m).otherwise(F.lit(float("inf"))).alias("pct_change")
    ).orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), F.round("sigma_distance", 6).desc(), "metric", "date")


def anomaly_summary(series: DataFrame, limit: int = 1000, **options: float) -> dict:
    """The JSON form; the first ``limit`` anomalies are listed, all are counted."""
    found = detect_anomalies(series, **options).persist()
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("c")).first()
    span = series.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("metric")).alias("metrics")).first()
    metrics = span["metrics"]
    rows = [
        {"metric": r["metric"], "date": str(r["date"]), "value": r["value"], "expected": round(r["expected"], 2), "sigma_distance": finite(r["sigma_distance"], 2), "direction": r["direction"], "severity": r["severity"], "pct_change": finite(r["pct_change"], 4)}
        for r in found.limit(limit).collect()
    ]
    found.unpersist()
    return {
        "metric": "anomaly_detection", "date_range": {"start": str(span["a"] or date.today()), "end": str(span["b"] or date.today())}, "metrics_checked": metrics, "total_data_points": span["n"],
        "anomaly_count": counts["n"], "critical_count": counts["c"], "warning_count": counts["n"] - counts["c"], "anomalies": rows,
    }
