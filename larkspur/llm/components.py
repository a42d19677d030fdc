"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable


def _ends(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) for every id in the (a, b) links.

    Each round gives every id the least label around it and then that label's own, and goes on with the
    links between different labels, each once: a link inside what has grown together is not met again, so
    later rounds are on ever fewer rows. Hubs are folded per task before the shuffle; joins on them may be
    split by AQE. No links: no rows.
    """
    links = durable(links.select(*_ends("a", "b")).filter("a != b").distinct())
    labels = None
    while True:
        both = links.union(links.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp"))
        far = near.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        step = durable(near.join(far, "comp").select("id", F.col("further").alias("comp")))
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
            labels = durable(labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        at_a, at_b = (step.select(F.col("id").alias(end), F.col("comp").alias(f"of_{end}")) for end in "ab")
        between = links.join(at_a, "a").join(at_b, "b").filter("of_a != of_b")
        links = durable(between.select(*_ends("of_a", "of_b")).distinct())
        if not links.take(1):
            return labels
