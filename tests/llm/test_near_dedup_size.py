"""What near_dedup sends through the driver and how many links it walks, on tables made for it."""

from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import common, components, near_dedup


def test_a_filter_in_bits_holds_every_id_and_few_others(spark):
    rows = spark.range(-50_000, 50_000).select((F.col("id") * 7919).alias("id"))
    ids = rows.filter("id % 10 = 0").select(F.col("id").alias("wanted"))
    held, rest = (common.join_bits(rows, "id", ids, how) for how in ("left_semi", "left_anti"))
    assert held.columns == ["id"] and held.join(ids, F.col("id") == F.col("wanted"), "left_semi").count() == 10_000
    assert 10_000 <= held.count() < 10_000 + 90_000 * 0.1 and held.count() + rest.count() == 100_000
    none = ids.filter("wanted = 1")
    assert common.join_bits(rows, "id", none, "left_semi").count() == 0 and common.join_bits(rows, "id", none, "left_anti").count() == 100_000


def test_sets_are_picked_without_sending_their_ids_to_the_driver(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), F.col("id").cast("string")).alias("text"))
    sets = near_dedup.sets_of(docs, docs.filter("doc_id < 700").select(F.col("doc_id").alias("id")), 3)
    assert {r["id"] for r in sets.collect()} >= set(range(700)) and sets.count() < 900
    assert "bitmap_construct_agg" in sets._jdf.queryExecution().executedPlan().toString()


def test_later_rounds_do_not_meet_links_inside_a_component(spark, monkeypatch):
    sizes = []

    def counted(df):
        sizes.append(df.count())
        return common.durable(df)

    monkeypatch.setattr(components, "durable", counted)
    links = [(a, b) for a in range(40) for b in range(a)] + [(100, 101), (101, 39)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in [*range(40), 100, 101]}
    assert max(sizes) <= len(links) and sum(sizes) < 2 * len(links)


def test_large_buckets_are_grouped_by_their_leaders(spark, monkeypatch):
    """60 rows, each in 20 buckets: 1,200 pairs of row and leader, but 20 leaders."""
    met = []

    def counted(links):
        met.append(links.count())
        return components.components(links)

    monkeypatch.setattr(near_dedup, "components", counted)
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {'x' if i else 'y'}{i % 2}") for i in range(60)], "doc_id long, text string")
    large = spark.createDataFrame([(i, 1_000 + k, k) for i in range(60) for k in range(20)], "id long, key long, first long")
    labels = spark.createDataFrame([(i, i) for i in range(60)], "id long, comp long")
    found = {tuple(r) for r in near_dedup._leftovers(docs, large, labels, 3, 85).collect()}
    assert met == [20]
    assert found == {(a, b) for a in range(1, 60) for b in range(a + 1, 60) if a % 2 == b % 2}


def test_the_pipeline_keeps_one_row_of_a_text_and_all_rows_without_words(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long), (3, long), (None, long), (9, long + " more"), (1, " \t"), (2, " \t"), (None, None), (7, None), (None, "alone here"), (11, "on its own"), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    apart = sorted([r for r in rows if not (r[1] or "").startswith(long)], key=str)
    assert [r for r in got if not (r[1] or "").startswith(long)] == apart
    assert [r for r in got if (r[1] or "").startswith(long)] in ([(3, long)], [(9, long + " more")])
