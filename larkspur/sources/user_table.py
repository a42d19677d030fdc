"""Events as a table in buckets of users, so that what is asked by user needs no shuffle of events.

Rows of a user lie in one bucket, sorted by user. Aggregates, windows and joins on user_id (or on more columns with it)
then run bucket by bucket where the rows are read; only what they make of the users is shuffled. A query reads
the table with ``spark.read.table(name)`` and is otherwise what it is on plain events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.schema import identified, normalize_events

#: Buckets of a table. A bucket is read by one task: choose so many that rows / buckets fit a task well (at 100 TB, some 100,000).
BUCKETS = 200
#: A user with more rows than so many buckets' mean share is too heavy for a bucket.
HOT_BUCKETS = 2.0


def heaviest_user(events: DataFrame) -> tuple[int, int]:
    """(rows of all users, rows of the heaviest one), counted on the map side first; (0, 0) without users."""
    counts = identified(normalize_events(events)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return int(total), int(most)


def save_by_user(events: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS, hot_buckets: float = HOT_BUCKETS) -> bool:
    """Write the identified users' ``events`` as table ``name`` (at ``path``, if given; else in the warehouse); True if in buckets.

    user_id and event_date are as ``normalize_events`` gives them; rows without a user are left out, since no
    analysis by user reads them. A bucket has one file. An existing table of this name is replaced.

    If a user has more than ``hot_buckets`` times the mean rows of a bucket, the table gets no buckets (False): one task would
    read that user's rows alone, while a plain table's tasks aggregate them where they lie before the shuffle. The
    results are the same either way.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    total, most = heaviest_user(events)
    rows = identified(normalize_events(events))
    fits = most * buckets <= hot_buckets * total or most <= 1
    if fits:
        writer = rows.repartition(buckets, "user_id").write.bucketBy(buckets, "user_id").sortBy("user_id")
    else:
        writer = rows.write
    writer = writer.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return fits
