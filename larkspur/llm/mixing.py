"""Mixing sources to target weights: repetition rates, whole copies and one Bernoulli copy.

A document gets its one copy more with probability equal to the fraction of its source's rate, whatever
its size. The draws of a source are not independent, so that they come near the target: its documents
stand in an order by size in groups of about GROUP, and with one hash-seeded start u for each group the
document at place i gets the copy where floor((i + 1) * f + u) > floor(i * f + u). Over u that has
probability f at every place, and every stretch of sizes gets its share within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.common import WORD, broadcast_if_small, durable, join_hot, uniform, unused

#: Words wanted for each word there is, and copies of one source at most.
BUDGET = 1.5
MOST = 2.0
#: Weights of the sources in code point order, repeated.
WEIGHTS = (3, 1, 2)
#: Documents that are drawn together, on average.
GROUP = 2_000
#: Up to so many documents that are taken, their keys and copies (12 bytes each) are broadcast.
PICK_ROWS = 500_000


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target, n_rows for (source, size) rows.

    Sources in code point order, null last, get the weights in turn. ``budget`` times all sizes is
    shared by weight; no target exceeds ``most`` times its source's size, and what is cut goes to
    the others by weight. With cap_i = most * size_i, the level L solves sum(min(cap_i, L * w_i)) =
    budget * total: sorted by cap_i / w_i, L is the greatest (budget - caps before i) / (weights
    from i on) that does not exceed cap_i / w_i.

    One row per source, folded on the map side before the shuffle, so a source with a third of the
    rows costs its reducer one row from each task. The windows then run over the list of sources.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(float(budget)) - before) / behind
    levelled = ranked.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return levelled.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"), "n_rows")


def _keys(source: Column) -> list[Column]:
    """A source as two columns that are never null."""
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("its_source")]


_ON = ["no_source", "its_source"]


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """no_source, its_source, source_size, target, n_rows, rate for (source, size) rows, with a durable lineage."""
    targets = source_targets(sizes, weights, budget, most).select(*_keys(F.col("source")), "source_size", "target", "n_rows")
    return durable(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))


def _with_copies(rows: DataFrame, seed: str, tie: Column) -> DataFrame:
    """rows (doc_id, size, no_source, its_source, n_rows, rate and others) with ``copies``.

    A source's groups are by a hash of doc_id, about n_rows / GROUP of them, so none holds a large source;
    in a group the order is by size, hash and doc_id, then ``tie``.
    """
    draw = uniform(seed, F.col("doc_id"))
    group = F.floor(uniform(f"{seed}-group", F.col("doc_id")) * F.ceil(F.col("n_rows") / GROUP))
    spread = rows.withColumns({"draw": draw, "draw_group": group})
    place = F.row_number().over(Window.partitionBy(*_ON, "draw_group").orderBy("size", "draw", F.col("doc_id").asc_nulls_first(), tie)) - 1
    start = uniform(f"{seed}-start", F.col("no_source"), F.col("its_source"), F.col("draw_group"))
    whole = F.floor(F.col("rate"))
    part = F.col("rate") - whole
    more = F.floor((F.col("place") + 1) * part + F.col("start")) > F.floor(F.col("place") * part + F.col("start"))
    placed = spread.withColumns({"place": place, "start": start})
    return placed.withColumn("copies", (whole + more.cast("int")).cast("int")).drop("draw", "draw_group", "place", "start")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source: broadcast, or (more than BROADCAST_ROWS sources) by shuffle, large sources apart."""
    if plan.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(plan), _ON)
    return join_hot(rows, plan, _ON, plan.select(*_ON, F.col("n_rows").alias("n")))


def mix_sources(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs``.

    A source's rate is target / source_size; a row is taken floor(rate) times, and once more with
    probability equal to the fraction (see the module's head), so reruns agree. The texts are read once;
    narrow rows are shuffled to their groups.

    Null text: size 0. Null source: a source of its own, ranked last. Null doc_id: hashed as the empty
    text. Repeated rows stand side by side in one group, each at a place of its own. A source without words
    has target 0 and no copies. Empty table: empty result. Other columns are ignored.
    """
    sizes = durable(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    mixed = _with_copies(_joined(sizes.select("*", *_keys(F.col("source"))), source_plan(sizes, weights, budget, most)), seed, F.lit(0))
    return mixed.withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as mix_sources takes it (0, 1, ... times).

    The copies are drawn on narrow rows, one for each different (doc_id, source, text), so rows that repeat all
    three are taken alike. The texts meet their copies where they lie if at most PICK_ROWS documents are
    taken (counted first), and by a shuffled join beyond. For the rest the statements of mix_sources hold.
    """
    size = n_words(F.col("text")).alias("size")
    key, whole, copies = unused(docs, "text_key", "row", "copies")
    known = F.xxhash64("doc_id", "source", "text").alias(key)
    rows = durable(docs.select(known, "doc_id", "source", size))
    plan = source_plan(rows, weights, budget, most)
    once = rows.groupBy(key).agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")])
    drawn = _with_copies(_joined(once.select(key, "doc_id", "size", *_keys(F.col("source"))), plan), seed, F.col(key))
    taken = durable(drawn.filter("copies > 0").select(key, F.col("copies").alias(copies)))
    kept = docs.select(known, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole)).join(broadcast_if_small(taken, PICK_ROWS), key)
    return kept.select(whole, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(f"{whole}.*")
