"""Set algebra on users without reading events again: theta sketches, their unions, intersections and differences.

A sketch of 2 ** LOG_NOMINAL entries is exact up to so many users; beyond, a union's estimate is off by a
standard error of 1 / sqrt(2 ** LOG_NOMINAL), 1.6 %, of the set, an intersection's or difference's by about that
share of the larger set that went in. Where counts have to be exact, users are dealt to ``exact_buckets`` by a
hash and sketched by bucket: no sketch, nor the union of all in a bucket, then holds more than it counts exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.schema import identified

LOG_NOMINAL = 12


def exact_buckets(events: DataFrame, log_nominal: int = LOG_NOMINAL) -> int:
    """So many buckets that each gets about half of what a sketch counts exactly; a bucket never gets twice its share."""
    found = identified(events).agg(F.approx_count_distinct("user_id", 0.02).alias("n")).first()["n"]
    return max(1, math.ceil(found / 2.0 ** (log_nominal - 1)))


def user_sketches(events: DataFrame, *keys: str | Column, log_nominal: int = LOG_NOMINAL, buckets: int | None = None) -> DataFrame:
    """keys, users (theta sketch) of the identified users of ``events``; with ``buckets`` also bucket, the users' hash modulo so many."""
    by = [*keys, F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")] if buckets else keys
    return identified(events).groupBy(*by).agg(F.theta_sketch_agg("user_id", log_nominal).alias("users"))


def merge_sketches(sketches: DataFrame, *keys: str | Column, log_nominal: int = LOG_NOMINAL) -> DataFrame:
    """Sketches merged to ``keys``: users of any of them. Sketches by bucket stay exact if bucket is one of the keys."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("users", log_nominal).alias("users"))


def _bucketed(sketches: DataFrame) -> DataFrame:
    return sketches if "bucket" in sketches.columns else sketches.withColumn("bucket", F.lit(0).cast("long"))


def sketch_retention(cohorts: DataFrame, activity: DataFrame, between: Column) -> DataFrame:
    """cohort, period, users, retained (estimates) from sketches of cohorts (cohort, users) and of activity (start, users).

    Either both have a bucket, of equally many, or neither. between: periods from ``cohort`` to ``start``, an
    expression of both. Cohorts and periods are a few hundred rows each, whatever the events; only pairs with
    start >= cohort meet, in each bucket.
    """
    cohorts, activity = _bucketed(cohorts), _bucketed(activity).withColumnRenamed("users", "active")
    sizes = cohorts.groupBy("cohort").agg(F.sum(F.theta_sketch_estimate("users")).alias("users"))
    meet = cohorts.join(activity, (cohorts["bucket"] == activity["bucket"]) & (F.col("start") >= F.col("cohort")))
    kept = meet.groupBy("cohort", "start").agg(F.sum(F.theta_sketch_estimate(F.theta_intersection("users", "active"))).alias("retained"))
    pairs = sizes.join(activity.select("start").distinct(), F.col("start") >= F.col("cohort")).join(kept, ["cohort", "start"], "left")
    return pairs.select("cohort", between.alias("period"), "users", F.coalesce("retained", F.lit(0)).alias("retained"))


def others_than(sketches: DataFrame, key: str, log_nominal: int = LOG_NOMINAL) -> DataFrame:
    """key, users, others: estimates of each key's users and of all users that are not among them (by bucket, if sketched so)."""
    sketches = _bucketed(sketches)
    every = merge_sketches(sketches, "bucket", log_nominal=log_nominal).select("bucket", F.col("users").alias("every"))
    missing = F.theta_sketch_estimate(F.theta_difference("every", "users"))
    found = sketches.join(every, "bucket").groupBy(key).agg(F.sum(F.theta_sketch_estimate("users")).alias("users"), F.sum(missing).alias("missing"), F.sum(F.theta_sketch_estimate("every")).alias("met"))
    # A key without users in a bucket misses all of that bucket.
    total = every.agg(F.sum(F.theta_sketch_estimate("every")).alias("total"))
    return found.join(F.broadcast(total)).select(key, "users", (F.col("missing") + F.col("total") - F.col("met")).alias("others"))  # one row
