"""Audit of filters in every order: documents fold to lattice edges, edges join the steps of the permutations.

A lattice edge is (filters already applied, next filter). Whether a document is still there, and falls, at
an edge depends on the set before it and not on its order, so each document counts in n * 2 ** (n - 1)
edges (80 of five filters), and the steps of all n! orders (600) are looked up among the edges. Documents
are folded by part, failed filters and labels first, so the edges are made from a few rows a part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, durable, join_hot

#: Limits of filters A, B and C, and the marks of D (fixed values).
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 2
MARKS = "[#$%&*|]"
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """A bit for each of the filters A to D (1, 2, 4, 8) that a whole text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    few = F.size(words) < MIN_WORDS
    repeated = 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words)
    shouted = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.char_length(text)
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, repeated, shouted, text.rlike(MARKS)))), F.lit(0))


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (a bit for each filter), good, toxic for each row of ``docs``.

    Texts travel as digests. E is a join of the rows with the least doc_id of each digest that has copies;
    digests with many rows meet that one row by broadcast, so a text that fills a third of the table stays
    where it is. The rows of a doc_id in ``labels`` are folded to one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failures(text).alias("fails")))
    counts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null")
    copies = durable(counts)
    marked = join_hot(rows, copies.select("digest", "least"), ["digest"], copies.select("digest", "n"), "left")
    copied = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    whole = marked.select("doc_id", "part", (F.col("fails") + F.when(copied, 16).otherwise(0)).alias("fails")).join(told, "doc_id", "left")
    return whole.select("part", "fails", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def lattice_edges(judged: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """part, applied (bits), filter (0, 1, ...), the COUNTS and shapley for each edge of the lattice and each part.

    judged: part, fails, good, toxic. Rows of equal part, bits and labels are one before they spread over
    the edges, so what is shuffled is bounded by parts, not by documents. shapley is the filter's removed
    documents over all orders: an edge from s applied filters lies on s! * (n - 1 - s)! of them.
    """
    folded = judged.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    edges = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]))
    on_edges = folded.withColumn("edge", edges).select("part", "fails", "good", "toxic", "n", "edge.*")
    there, falls = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(F.col("bit")) != 0

    def count(which: Column, name: str) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0)).cast("long").alias(name)

    counted = on_edges.groupBy("part", "applied", "filter").agg(
        count(there & ~falls, "kept"),
        count(there & falls, "removed"),
        count(~there & falls, "redundant"),
        count(F.col("fails") == F.col("bit"), "unique_fails"),
        count(there & falls & F.col("good"), "good_lost"),
        count(there & falls & F.col("toxic"), "toxic_lost"),
    )
    orders = [math.factorial(s) * math.factorial(n_filters - 1 - s) for s in range(n_filters)]
    weight = F.element_at(F.array(*map(F.lit, orders)), F.bit_count("applied") + 1)
    shapley = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))
    return counted.withColumn("shapley", shapley.cast("long"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of each step of each order of the five filters, for each part.

    A part is a source (null: the empty string). Null text: empty, so it fails A alone, and E behind a smaller
    doc_id. A null doc_id is larger than all others, has no label, and copies without any doc_id spare
    each other; rows that repeat a doc_id and text fail E together or not at all. A row of labels that is null
    counts for nothing; of several for a doc_id one with 1 is enough. Parts without a failing document have their zeros.
    Empty table: no rows. Columns beside doc_id, text, source (and quality, toxic of labels) are ignored.
    """
    steps = [("".join(order), i + 1, sum(1 << FILTERS.index(x) for x in order[:i]), FILTERS.index(f)) for order in itertools.permutations(FILTERS) for i, f in enumerate(order)]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    edges = lattice_edges(judged_documents(docs, labels))
    # 600 rows, fixed by the number of filters.
    walked = edges.join(F.broadcast(paths), ["applied", "filter"])
    letter = F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter")
    return walked.select("part", "filter_order", "step", letter, *COUNTS, "shapley")
