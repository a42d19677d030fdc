"""What several corpus operators share: tables, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import shared_folder, ship

#: A word is a run of code points other than space and U+0009..U+000D (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side with at most so many (small) rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
#: A key with more rows than this is not left to one task of a shuffled join.
HOT = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the folder that checkpoints use and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a batch that Spark hands to Python where the session leaves Spark's own 10,000: whole texts are large rows.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare_python(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and batches of texts small enough for their memory."""
    ship(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores in front, as many as no column of ``df`` has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def _hottest(counts: DataFrame, on: list[str], hot: int) -> DataFrame | None:
    """on, n of the keys with more than ``hot`` rows, the BROADCAST_ROWS most frequent of them; None if there are none.

    A key that is not among these has less than a share of 1 / BROADCAST_ROWS of the rows.
    """
    found = counts.filter(F.col("n") > hot).select(*on, "n").orderBy(F.desc("n"), *on).limit(BROADCAST_ROWS)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def join_hot(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", hot: int = HOT) -> DataFrame:
    """left join right (one small row for each key, none of them null) where a key may hold any share of left's rows.

    counts: on, n (rows of ``left`` by key, aggregated). The rows of ``right`` for keys with more than ``hot`` rows are
    broadcast, so left's rows of such a key stay where they are; all others are joined by shuffle.
    ``left`` is then read twice.
    """
    keys = _hottest(counts, on, hot)
    if keys is None:
        return left.join(right, on, how)
    keys = F.broadcast(keys.select(*on))
    near = left.join(keys, on, "left_semi").join(F.broadcast(right.join(keys, on, "left_semi")), on, how)
    return near.unionByName(left.join(keys, on, "left_anti").join(right, on, how))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows (counted first), else leave it to a shuffled join.

    Call it on small-row tables whose lineage is cut or cheap; the count stops at ``rows + 1``.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a filter for each of its ids, and in all at most (16 MB); a filter's page is what Spark's bitmap functions hold.
BITS, MOST_BITS, PAGE = 16, 1 << 27, 1 << 15


def join_bits(df: DataFrame, name: str, ids: DataFrame, how: str) -> DataFrame:
    """``df`` semi- or anti-joined by a broadcast filter of ``ids`` (its only column, bigint) on the bigint column ``name``.

    Two bytes an id go through the driver, where a broadcast join takes some hundred. Every row whose ``name`` is among
    the ids passes a ``left_semi``, and about one in BITS of the others too, which the caller's exact join has to drop; a
    ``left_anti`` gives the rest. ``ids`` is read twice: cut its lineage first.
    """
    pages = max(1, math.ceil(min(ids.count() * BITS, MOST_BITS) / PAGE))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c), F.lit(pages)), F.lit(pages * PAGE))

    (only,) = ids.columns
    held = ids.groupBy(F.floor(place(only) / PAGE).alias("page")).agg(F.bitmap_construct_agg(place(only) % PAGE).alias("bits"))
    spot = place(name) % PAGE
    byte = F.conv(F.hex(F.substring("bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    lit = byte.bitwiseAND(F.pow(F.lit(2), spot % 8).cast("int")) != 0
    return df.join(F.broadcast(held), (F.floor(place(name) / PAGE) == F.col("page")) & lit, how)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def uniform(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the parts' text: the first 52 bits of an md5 digest."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
