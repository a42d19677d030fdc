"""Mixing, URL filters and fingerprints against SQL and brute force, with the odd cases."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, fingerprints, mixing, queries, url_filters

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op1_mixing", "op6_fingerprints", "op8_url_filters"])
def test_native_plans_have_no_python(name, spark):
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()]


def fill(sizes, weights, budget=1.5, most=2.0):
    """Targets by repeated resharing: what is above the cap goes to the others by weight."""
    target, capped = {}, set()
    while True:
        rest = budget * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / w for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mixing_by_resharing_with_odd_rows(spark):
    rows = [(1, "a b c", "en", "s1", 0), (2, None, "en", "s1", 0), (3, "", "en", None, 0), (3, "x\u00a0y z\tq", "en", None, 0), (None, "w " * 500, "en", "s2", 0), (5, "w " * 5000, None, "s3", 0), (5, "w " * 5000, None, "s3", 0), (6, " ", None, "s4", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash")).withColumn("taken", F.lit(0))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {r["source"]: r["source_size"] for r in got}
    assert sizes == {"s1": 3, None: 3, "s2": 500, "s3": 10000, "s4": 0}
    weights = dict(zip(["s1", "s2", "s3", "s4", None], [3, 1, 2, 3, 1], strict=True))
    want = fill(sizes, weights)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets_and_the_documents_are_repeated(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 5)).alias("source"), F.lit(0).alias("n_chars"))
    got = mixing.mix_sources(docs)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r["t"] == pytest.approx(r["g"], rel=0.1)
    copies = {r["doc_id"]: r["copies"] for r in got.collect()}
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_small_sources_come_near_their_targets_too(spark):
    """Sources of 50 documents, some with a fifth of their words in one document."""
    got = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count(F.lit(1)).alias("n")).filter("g > 0").collect()
    assert len(found) > 10 and all(r["t"] == pytest.approx(r["g"], rel=0.1) for r in found if r["n"] >= 20)


def test_every_size_is_taken_with_the_fraction_as_its_probability(spark):
    """300 seeds, as 300 sources of the same twelve sizes: one document holds half of the words."""
    sizes = [1, 1, 2, 3, 5, 8, 13, 20, 30, 40, 60, 183]
    rows = spark.range(300 * 12).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 12).cast("string").alias("its_source"), F.lit(False).alias("no_source"), F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % 12 + 1).cast("int")).alias("size"))
    for rate in (0.3, 1.75):
        drawn = mixing._with_copies(rows.withColumns({"rate": F.lit(rate), "n_rows": F.lit(12)}), "s", F.lit(0))
        found = drawn.groupBy((F.col("doc_id") % 12).alias("k")).agg(F.avg("copies").alias("mean"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect()
        f = rate % 1
        assert len(found) == 12
        for r in found:
            assert abs(r["mean"] - rate) < 3 * (f * (1 - f) / 300) ** 0.5 and (r["low"], r["high"]) == (int(rate), int(rate) + 1)


def test_the_draw_is_fair_and_columns_keep_their_names(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    odd = docs.withColumns({n: F.lit(n) for n in ("_source", "_rate", "_copies", "_copy", "_row", "rate", "draw", "copies", "target", "no_source")})
    one = mixing.mixed_documents(odd)
    assert one.columns == odd.columns and one.select("_copy", "rate").distinct().collect() == [("_copy", "rate")]
    counts = {r["doc_id"]: r["count"] for r in one.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).filter("copies > 0").collect()}
    monkeypatch.setattr(mixing.common, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["count"] for r in mixing.mixed_documents(odd).groupBy("doc_id").count().collect()} == counts


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/", "block"), ("a.net", "/", "allow"), ("x.org", "", "block"), ("x.org", "", "allow"), (None, "/q", "block")]
URLS = [
    ("http://WWW.Example.COM/en/77?x", "www.example.com", "/en/77", "example.com/en/7", "allow"), ("http://example.com/en/8#/en/7", "example.com", "/en/8", "com/en/", "block"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("com/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://a.net", "a.net", "", None, "allow"), ("x://b.a.net/://z", "b.a.net", "/://z", "a.net/", "allow"), ("x://net/", "net", "/", "net/", "block"), ("x://x.org", "x.org", "", "x.org", "block"), ("x://com.evil/en/", "com.evil", "/en/", None, "allow"), ("://", "", "", None, "allow"), ("x://c.net/" + "p" * 20000, "c.net", "/" + "p" * 20000, "net/", "block"),
]


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_urls_on_both_join_ways(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", limit)
    urls = spark.createDataFrame([(i, u, "clash") for i, (u, *_) in enumerate(URLS) if not limit and u and len(u) < 100 or limit], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    twice = urls.union(urls).union(spark.createDataFrame([(None, "x://net/", "c")], urls.schema))
    got = {}
    for r in url_filters.judge_urls(twice, rules).collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[1:])
    for i in [r["page_id"] for r in urls.collect()]:
        assert got[i] == [URLS[i][1:]] * 2
    assert got[None] == [("net", "/", "net/", "block")]
    assert {r["verdict"] for r in url_filters.judge_urls(urls, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.judge_urls(urls.limit(0), rules).count() == 0


def canon(text):
    spaces = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(x for x in folded.translate(dict.fromkeys(map(ord, spaces), " ")).split(" ") if x)


TEXTS = ["Straße  Ⅷ", "strasse\u3000viii ", "", None, "e\u0301a", "\u00e9A", "日本語 🎉 x", "q" * 50000, "short", "short", "Short!", "a b c d e f g h", "ﬁn", "FIN"]


def check_fingerprints(spark, ids, texts):
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = fingerprints.fingerprint_documents(docs.repartition(3)).collect()
    assert len(got) == len(texts)
    rows = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda x: x[0])
    prints, by = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        take = len(text) // 4
        edited = text[: len(text) - take] + after[:take]
        (r,) = by[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(canon(t), f) == f
        assert r["near_edited"] == float(canon(text) == canon(edited)) and r["near_next"] == float(canon(text) == canon(after))
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_by_brute_force(spark):
    check_fingerprints(spark, [7, 3, -5, 100, 12, 13, 1, 50, 51, 52, 53, 2**40, 60, 61], TEXTS)
    check_fingerprints(spark, [9], ["alone here"])


def test_colliding_buckets_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "hashes", lambda text: F.struct((F.length(text) % 2).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
    check_fingerprints(spark, list(range(len(TEXTS))), TEXTS)


def test_fingerprints_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (None, "bbbb"), (None, "cccc"), (2, "dddd")], "doc_id long, text string")
    got = fingerprints.fingerprint_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None", "None"]
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(b"aaad").hexdigest()}
    assert len({r["edited_sha256"] for r in got if r["doc_id"] == 2} & {hashlib.sha256(x).hexdigest() for x in (b"dddb", b"dddc")}) == 1
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
