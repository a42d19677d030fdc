"""The training-data pipeline: five operators in a row over ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; the last returns doc_id, ids and lossless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import language_id, merge_dropout, mixing, near_dedup, quality
from larkspur.llm.common import WORD, durable, join_bits, shared_table, unused

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier accepts.

    Null texts and texts without a letter go; repeated rows are judged alike; without any ``lang`` all go.
    """
    (row,) = unused(docs, "row")
    classifier = language_id.fit(docs.select("doc_id", "text", "lang"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "text")
    return language_id.identify(whole, classifier).filter(~F.col("rejected")).select(f"{row}.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject. Null and blank texts go; repeated rows are judged alike."""
    (row,) = unused(docs, "row")
    scorer, _ = quality.fit(docs.select("doc_id", "text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "text")
    return quality.score_quality(whole, scorer).filter(~F.col("rejected")).select(f"{row}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Rows go by their texts, not by doc_id: a text's hash is its id in the search, so texts that share a
    doc_id or have none are judged each on its own. Of the rows of a kept text the one with the least
    doc_id stays (null last). Rows without words are like no others and all stay.
    """
    key, whole, wordy, nth = unused(docs, "text_key", "row", "wordy", "nth")
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.xxhash64("text").alias(key), has_words.alias(wordy))
    found = near_dedup.near_duplicates(docs.select(F.xxhash64("text").alias("doc_id"), "text"), width=5, percent=80, bands=PIPELINE_BANDS)
    # Texts that go, and those that stand in several rows. All other rows stay where they are: a filter in bits tells them.
    texts = found.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    asked = durable(texts.filter("n > 1 or not kept").select(F.col("doc_id").alias(key), "kept"))
    sure = join_bits(keyed, key, asked.select(key), "left_anti")
    open_rows = join_bits(keyed, key, asked.select(key), "left_semi")
    # Of many copies each task passes on only its first (the rank is cut before the shuffle).
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(whole)["doc_id"].asc_nulls_last()))
    one = open_rows.filter(wordy).withColumn(nth, first).filter(F.col(nth) == 1).join(asked.filter(~F.col("kept")), key, "left_anti")
    return sure.unionByName(open_rows.filter(~F.col(wordy))).unionByName(one.drop(nth)).select(f"{whole}.*")


#: (1 - 0.8 ** 3) ** 13 is below 1e-4 for each of the two collections.
PIPELINE_BANDS = 13


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it. Null texts have no words; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, lossless of every document of the mix. Null text: null ids; empty text: none; both are lossless."""
    return merge_dropout.encode_documents(docs, merge_dropout.load_model(PIECE_MODEL))


STAGES = [("language_id", identify_language), ("quality", classify_quality), ("near_dedup", drop_near_duplicates), ("mixing", mix), ("merge_dropout", encode)]

#: Compression codes, EM and seeded merges have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
