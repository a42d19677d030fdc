"""Document fingerprints: canonical exact digests, wide xxhash buckets confirmed byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable

#: Unicode's White_Space code points, which fold to one space.
SPACES = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The key of a null doc_id, which sorts last.
LAST = (1 << 63) - 1


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may undo it), white space folded and trimmed.

    The JVM's ICU library does the first two through Spark's ``java_method``; no Python runs.
    """

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), SPACES, " "))


def hashes(text: Column) -> Column:
    """A struct h1, h2 of 128 bits: two xxhash64 of the text, the second seeded by hashing a constant first."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))


def digest(text: Column) -> Column:
    """hashes(canonical(text)); the canonical form is bound to a variable, so that it is made once."""
    return F.transform(F.array(canonical(text)), lambda c: hashes(c))[0]


def collisions(texts: DataFrame) -> DataFrame:
    """h1, h2, canon, rank for the buckets (h1, h2) in which canonical texts differ byte by byte.

    Grouping by the text itself folds a bucket of copies to one row in each task before any shuffle.
    """
    groups = texts.groupBy("h1", "h2", "canon").agg(F.count(F.lit(1)).alias("n"))
    split = groups.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1").select("h1", "h2")
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("canon"))
    return groups.join(split, ["h1", "h2"], "left_semi").select("h1", "h2", "canon", rank.alias("rank"))


def next_ids(ids: DataFrame) -> DataFrame:
    """key, next_key for distinct keys: the next greater one; the least for the greatest.

    Keys are dealt into ranges; only the first key of each range goes to a single task.
    """
    distinct = ids.select("key").distinct()
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    every = Window.orderBy("part")
    least = F.min("first").over(Window.partitionBy(F.lit(1)))
    after = firsts.select(F.col("part"), F.coalesce(F.lead("first").over(every), least).alias("after"))
    inside = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return inside.join(F.broadcast(after), "part").select("key", F.coalesce("next_key", "after").alias("next_key"))


#: Keys (8 bytes each) that may be broadcast to pick rows out of the texts; beyond, a shuffled join.
PICK_ROWS = 500_000


def _pick(texts: DataFrame, keys: DataFrame) -> DataFrame:
    if keys.limit(PICK_ROWS + 1).count() <= PICK_ROWS:
        keys = F.broadcast(keys)
    return texts.join(keys, "key", "left_semi")


def _edited(texts: DataFrame, after: DataFrame, repeats: bool) -> DataFrame:
    """Add edited (the text whose last quarter the next document's start replaces)."""
    heads = texts.join(after, texts["key"] == after["next_key"]).select("prev_key", F.substring("text", F.lit(1), F.col("most")).alias("head"), *([F.xxhash64("text").alias("place")] if repeats else []))
    if repeats:
        heads = heads.groupBy("prev_key").agg(F.min(F.struct("place", "head"))["head"].alias("head"))
    take = F.floor(F.char_length("text") / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - take)
    joined = texts.join(heads, texts["key"] == heads["prev_key"]).drop("prev_key")
    return joined.withColumn("edited", F.concat(kept, F.substring(F.col("head"), F.lit(1), take))).drop("head")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    fingerprint: 32 hex digits, the 128-bit bucket of the canonical text. Buckets of more than one
    row are confirmed by comparing canonical texts byte by byte; if texts differ, the second in byte
    order gets the suffix "-2", and so on. So fingerprints are equal exactly when canonical texts are.
    The edited text is the document with its last quarter (code points) replaced by as much of the
    start of the next document, doc_ids ascending; after the last comes the first.
    near_*: 1.0 for equal fingerprints, else 0.0; an exact digest knows nothing between.

    Null text: the empty text. A null doc_id comes last (so does 2**63 - 1, which is returned as null). Rows that share a doc_id are one place in
    the order; each gets its own row, and as the next document they count with the row of the least
    hash of the text. One document is its own next. Other columns are ignored; an empty table gives no rows.

    Texts are shuffled by doc_id once (both sides of the joins reuse it), a quarter of them again as
    heads; of the texts in shared buckets only one of each kind leaves a task.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    takes = durable(texts.groupBy("key").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("most"), F.count(F.lit(1)).alias("n_rows")))
    repeats = bool(takes.filter("n_rows > 1").take(1))
    after = durable(takes.select(F.col("key").alias("prev_key"), "most").join(next_ids(takes), F.col("prev_key") == F.col("key")).select("prev_key", "next_key", "most"))

    sums = _edited(texts, after, repeats).select("key", F.xxhash64("text").alias("place"), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digest(F.col("text")).alias("own"), digest(F.col("edited")).alias("edit"))
    hashed = durable(sums)
    # The next document's digest is known by its own row: only ids and digests are joined.
    firsts = (hashed.groupBy("key").agg(F.min(F.struct("place", "own"))["own"].alias("own")) if repeats else hashed).select(F.col("key").alias("next_key"), F.col("own").alias("next"))
    hashed = durable(hashed.join(after.select(F.col("prev_key").alias("key"), "next_key").join(firsts, "next_key"), "key").select("key", "n_chars", "edited_sha256", "own", "edit", "next"))
    pairs = hashed.select("key", F.explode(F.array(F.struct("own.h1", "own.h2", F.lit(0).alias("side")), F.struct("edit.h1", "edit.h2", F.lit(1).alias("side")))).alias("p")).select("key", "p.*")
    shared = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    keys = durable(pairs.join(shared, ["h1", "h2"], "left_semi").select("key", "side").distinct())
    some = _pick(texts, keys.filter("side = 0").select("key"))
    def told(side: int, text: str) -> list[Column]:
        made = F.transform(F.array(canonical(F.col(text))), lambda c: F.struct(hashes(c).alias("h"), c.alias("canon")))[0]
        return ["key", F.lit(side).alias("side"), made.alias("m")]

    originals = some.select(*told(0, "text"))
    some_after = after.join(keys.filter("side = 1").select(F.col("key").alias("prev_key")), "prev_key", "left_semi")
    around = some_after.select(F.explode(F.array("prev_key", "next_key")).alias("key")).distinct()
    changed = _edited(_pick(texts, around), some_after, repeats).select(*told(1, "edited"))
    confirmed = originals.unionByName(changed).select("key", "side", "m.h.h1", "m.h.h2", "m.canon")
    clash = durable(collisions(confirmed))

    def text_of(side: str) -> Column:
        return F.concat(*[F.lower(F.lpad(F.hex(F.col(f"{side}.{h}")), 16, "0")) for h in ("h1", "h2")])

    out = hashed.select("key", "n_chars", "edited_sha256", text_of("own").alias("fingerprint"), text_of("edit").alias("edited_fingerprint"), text_of("next").alias("next_fingerprint"))
    if clash.take(1):
        ranks = confirmed.join(clash, ["h1", "h2", "canon"]).filter("rank > 1").groupBy("key", "side").agg(F.max("rank").alias("rank"))
        mine, edits = ranks.filter("side = 0"), ranks.filter("side = 1")
        next_ranks = after.join(mine, after["next_key"] == mine["key"]).select(F.col("prev_key").alias("key"), "rank")
        for name, rank in (("fingerprint", mine.select("key", "rank")), ("edited_fingerprint", edits.select("key", "rank")), ("next_fingerprint", next_ranks)):
            out = out.join(rank, "key", "left").withColumn(name, F.concat(F.col(name), F.when(F.col("rank").isNotNull(), F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(""))).drop("rank")

    def near(other: str) -> Column:
        return F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)

    return out.select(F.nullif("key", F.lit(LAST)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
