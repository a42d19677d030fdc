"""MinHash near-duplicate detection with tensored banding and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shingles
from larkspur.llm.common import durable, join_bits, prepare_python
from larkspur.llm.components import components

#: Each of two collections has BANDS bands of ROWS minhashes; table (i, j) is keyed by band i of the
#: first and band j of the second. So 2 * BANDS * ROWS minhashes serve BANDS ** 2 tables of 2 * ROWS
#: each, where plain banding computes BANDS ** 2 * 2 * ROWS. Links at similarity s are missed with
#: probability at most 2 * (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 10, 3
#: In buckets of up to SMALL rows, rows of different components are paired on the bucket's key; in
#: larger ones, the rows that the first links left over are compared in blocks with all of them.
SMALL = 16
QUERY_BLOCK, MEMBER_BLOCK = 64, 256


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (size of the shingle set), h1, h2 (its digests), a, b (its bands) for each row."""
    prepare_python(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, edges in shingles.text_chunks(batch.column(1)):
                sets = shingles.shingle_sets(data, edges, width)
                digests = shingles.set_digests(sets).view(np.int64)
                keys = shingles.minhash_bands(sets, 2 * bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(list(keys[:, :bands]), pa.list_(pa.int64())), pa.array(list(keys[:, bands:]), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "h1", "h2", "a", "b"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, a array<long>, b array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, s (its sorted set of shingle hashes) for the documents in ``ids`` (id), and for few others, from their whole texts.

    Texts are picked where they lie by a filter in bits; joins on id drop what it lets through besides.
    """
    prepare_python(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, edges in shingles.text_chunks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingles.shingle_sets(data, edges, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    picked = join_bits(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids, "left_semi")
    return picked.mapInArrow(build, "id long, s array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union.

    ``pairs``: a, b, lead (whichever of the two may be in any number of pairs; the other is in few). The
    other's set is joined first, so what then meets a leader's set are rows as wide as the work they
    bring, and adaptive execution can split a leader's partition by its bytes. Nothing after that join
    asks for its partitioning, which would forbid the split: pairs of an id that several texts share may repeat.
    """
    ids = durable(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = durable(sets_of(docs, ids, width))
    mate = F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    wide = pairs.withColumn("mate", mate).join(sets.select(F.col("id").alias("mate"), F.col("s").alias("sm")), "mate")
    both = wide.join(sets.select(F.col("id").alias("lead"), F.col("s").alias("sl")), "lead")
    shared = F.size(F.array_intersect("sm", "sl"))
    return both.filter(100 * shared >= percent * (F.size("sm") + F.size("sl") - shared)).select("a", "b")


def _leftovers(docs: DataFrame, large: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links in large buckets between rows that the first links left in different components.

    Large buckets that share rows form a group. Its rows outside its commonest component are
    queries: QUERY_BLOCK of them at a time meet MEMBER_BLOCK rows of the group in one task, which
    returns only links. So a group of any size is spread over many tasks.
    """
    # A row is in many buckets: their leaders are linked, each two of them once, and the row goes with its least one.
    own = durable(large.groupBy("id").agg(F.min("first").alias("lead"), F.collect_set("first").alias("firsts")))
    leaders = components(own.select(F.col("lead").alias("a"), F.explode("firsts").alias("b")).distinct())
    group = own.select("id", "lead").join(leaders.select(F.col("id").alias("lead"), F.col("comp").alias("grp")), "lead", "left").select("id", F.coalesce("grp", "lead").alias("grp"))
    placed = durable(group.join(labels, "id", "left").select("id", "grp", F.coalesce("comp", "id").alias("comp")))
    sizes = placed.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("grp", F.col("m.comp").alias("main"), "rows", (F.col("rows") - F.col("m.n")).alias("outs"))
    open_rows = durable(placed.join(main, "grp"))
    sets = sets_of(docs, durable(open_rows.select("id").distinct()), width)
    rows = open_rows.join(sets, "id").withColumn("h", F.abs(F.xxhash64("id") % (1 << 40)))
    q_blocks, m_blocks = F.ceil(F.col("outs") / QUERY_BLOCK).cast("int"), F.ceil(F.col("rows") / MEMBER_BLOCK).cast("int")
    q, m = (F.col("h") % q_blocks).cast("int"), (F.col("h") % m_blocks).cast("int")
    queries = rows.filter("comp != main").withColumn("qb", q).withColumn("mb", F.explode(F.sequence(F.lit(0), m_blocks - 1))).withColumn("role", F.lit(0))
    members = rows.withColumn("mb", m).withColumn("qb", F.explode(F.sequence(F.lit(0), q_blocks - 1))).withColumn("role", F.lit(1))
    columns = ["grp", "qb", "mb", "role", "id", "comp", "s"]

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows.role == 0], rows[rows.role == 1]
        if not len(asked) or not len(held):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sizes = np.array([len(s) for s in held.s])
        values = np.concatenate(list(held.s))
        order = np.argsort(values, kind="stable")
        values, owners = values[order], np.repeat(np.arange(len(held)), sizes)[order]
        ids, comps, out = held.id.to_numpy(), held.comp.to_numpy(), []
        for one, comp, s in zip(asked.id, asked.comp, asked.s, strict=True):
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            hits = np.concatenate([owners[i:j] for i, j in zip(lo, hi, strict=True)]) if len(s) else owners[:0]
            shared = np.bincount(hits, minlength=len(held))
            good = (100 * shared >= percent * (len(s) + sizes - shared)) & (comps != comp)
            out += [(min(one, x), max(one, x)) for x in ids[good].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return queries.select(*columns).unionByName(members.select(*columns)).groupBy("grp", "qb", "mb").applyInPandas(link, "a long, b long").distinct()


def _mixed(held: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with comp, of buckets in which several components meet."""
    own = held.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    keys = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return durable(own.join(keys, "key", "left_semi"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, h1, h2 for each row of ``docs``.

    Words: A-Z lower-cased, split at space and U+0009..U+000D. Set: distinct ``width``-word shingles;
    fewer words: the whole sequence as one. Rows whose sets have 100 * intersection >= percent *
    union are linked. component_id: the least doc_id reachable; kept: whether that is its own.

    Null or wordless text: empty set, linked with nothing, kept. Null doc_id: linked with nothing,
    component_id null, kept. Rows that share a doc_id are judged each by its text. Equal sets are one
    member of the search (its id is their least doc_id), so copies are never paired. Other columns
    are ignored; an empty table gives no rows.

    Candidates share a table key. Each set is first held against the least leader of its buckets;
    where a bucket still has several components, its members are held against its two leaders (least
    id and least hash of id) in other components; where it has them even then, all its pairs across
    components are confirmed, on the bucket's key if it is small, in blocks if it is large. Nothing
    is capped, and pairs inside a component are not formed.
    """
    signed = durable(signatures(docs, width, bands, rows))
    kinds = signed.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n", "a", "b")).alias("m"))
    kinds = durable(kinds.select("h1", "h2", F.col("m.doc_id").alias("id"), F.col("m.a").alias("a"), F.col("m.b").alias("b")))

    # Only sets that share a band in both collections can share a table key.
    banded = kinds.select("id", F.posexplode(F.concat("a", "b")).alias("at", "key"))
    shared = banded.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("at", "key")
    met = banded.join(shared, ["at", "key"], "left_semi").groupBy("id").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    dense = durable(kinds.join(met.filter((F.col("low") < bands) & (F.col("high") >= bands)).select("id"), "id", "left_semi").select("id", "a", "b"))

    tables = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i * bands + j, x, y))))
    keyed = dense.select("id", F.explode(tables).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("second")).filter("n > 1").select("key", "n", "first", F.col("second.id").alias("second"))
    held = durable(keyed.join(buckets, "key"))

    def ordered(pairs: DataFrame) -> DataFrame:
        ends = [F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")]
        return pairs.filter("lead != id").groupBy(*ends).agg(F.min("lead").alias("lead"))

    tried = durable(ordered(held.groupBy("id").agg(F.min("first").alias("lead"))))
    links = durable(confirm(docs, tried, width, percent))
    labels = components(links)

    open_rows = _mixed(held, labels)
    led = open_rows.select("id", "comp", F.explode(F.array("first", "second")).alias("leader")).filter("id != leader")
    of_leader = labels.select(F.col("id").alias("leader"), F.col("comp").alias("its"))
    across = led.distinct().join(of_leader, "leader", "left").filter(F.col("comp") != F.coalesce("its", "leader"))
    more = durable(ordered(across.select("id", F.col("leader").alias("lead"))).join(tried, ["a", "b"], "left_anti"))
    if more.take(1):
        tried = tried.union(more)
        links = durable(links.union(confirm(docs, more, width, percent)))
        labels = components(links)
        open_rows = _mixed(open_rows.drop("comp").filter("n > 2"), labels)

    open_rows = open_rows.filter("n > 2")  # the one pair of a bucket of two has been tried
    small = open_rows.filter(F.col("n") <= SMALL)
    other = small.select("key", F.col("id").alias("id2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "key").filter("id < id2 and comp != comp2").select(F.col("id").alias("a"), F.col("id2").alias("b"), F.col("id").alias("lead")).distinct()
    pairs = durable(pairs.join(tried, ["a", "b"], "left_anti"))
    if pairs.take(1):
        links = links.union(confirm(docs, pairs, width, percent))
    large = open_rows.filter(F.col("n") > SMALL)
    if large.take(1):
        links = links.union(_leftovers(docs, large, labels, width, percent))
    labels = components(durable(links))

    found = kinds.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("component_id"))
    placed = signed.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "h1", "h2")
