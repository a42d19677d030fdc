"""op11: ranks against scores of every document, treaps against their definition, and the query's SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import lexical_search, queries

SMALL = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(lexical_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k=10):
    """Every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, counts in held:
            m = 25 + 75 * counts.total() * n // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in counts)
            scored += [(-score, doc_id is None, doc_id or 0, doc_id)] if score > 0 else []
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def searched(spark, docs, items, k=10):
    table = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, term string, score long")
    asked = spark.createDataFrame([(*r, "clash", 1) for r in items], "item_id long, text string, terms string, item long")
    return [tuple(r) for r in lexical_search.search(table, asked, k).select("item_id", "rank", "doc_id", "score").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def drawn(n, seed, words=40):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    return [(i, " ".join(draw.choices(names, [1 / (j + 1) for j in range(words)], k=draw.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("together", [7, 1 << 13])
def test_ranks_are_those_of_all_scores(spark, monkeypatch, together):
    monkeypatch.setattr(lexical_search, "TOGETHER", together)
    docs = drawn(400, 1)
    docs += [(1000 + i, docs[7][1]) for i in range(150)]
    items = [(i, t) for i, (_, t) in enumerate(drawn(25, 2))]
    same(searched(spark, docs, items), by_hand(docs, items))


def test_shards_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 13)
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    docs, items = drawn(120, 3), [(i, t) for i, (_, t) in enumerate(drawn(9, 4))]
    same(searched(spark, docs, items, 5), by_hand(docs, items, 5))
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 3)
    same(searched(spark, docs, items, 5), by_hand(docs, items, 5))


def test_oddities_have_defined_results(spark):
    docs = [(None, "one two"), (None, None), (1, None), (2, ""), (3, "?! ,"), (4, "one two"), (4, "one two"), (5, "ONE Ünd ünd 日本語 ÉTÉ"), (6, "one " * 60_000 + "two"), (7, "x" * 300_000)]
    items = [(0, "one, TWO"), (0, "one, TWO"), (None, "日本語? Ünd"), (1, None), (2, ""), (3, "unknown"), (4, "two two one"), (5, "x" * 300_000), (6, "ünd été ÉTÉ")]
    same(searched(spark, docs, items), by_hand(docs, items))
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=40), min_size=1, max_size=4))
def test_treaps_are_trees_by_document_and_heaps_by_impact(impacts):
    docs = np.concatenate([np.arange(len(x)) for x in impacts]).astype(np.int32)
    flat, counts = np.concatenate([np.array(x) for x in impacts]), np.array([len(x) for x in impacts])
    left, right, roots = lexical_search.treaps(docs, flat, counts)

    def in_order(i):
        if i < 0:
            return []
        assert all(flat[c] <= flat[i] for c in (left[i], right[i]) if c >= 0)
        return [*in_order(left[i]), i, *in_order(right[i])]

    assert [i for r in roots for i in in_order(r)] == list(range(len(flat)))


def test_equal_impacts_make_no_chain():
    left, right, roots = lexical_search.treaps(np.arange(20_000, dtype=np.int32), np.full(20_000, 7), np.array([20_000]))
    depth, level = 0, [roots[0]]
    while level:
        level = [c for i in level for c in (left[i], right[i]) if c >= 0]
        depth += 1
    assert depth < 60


def test_subtrees_are_passed_over(monkeypatch):
    """One document with all of the rare terms: few others are scored."""
    n = 20_000
    docs = [b"common " + b"filler " * (1 + i % 5) for i in range(n)]
    docs[77] += b"rare scarce common common common"
    shard = lexical_search._Shard(lexical_search.Corpus(n, 4 * n), None)
    for i, text in enumerate(docs):
        shard.add(i, text)
    row = shard.row()
    treap = lexical_search.Treaps({c: row.column(c)[0].values for c in row.schema.names})
    seen = []
    split = treap._split
    monkeypatch.setattr(treap, "_split", lambda node, *a: seen.append(len(node)) or split(node, *a))
    (best,) = treap.search([{"rare": 9000, "scarce": 9000, "common": 1}], 1)
    assert best[:2] == (0, 77) and sum(seen) < 50


@settings(max_examples=200, deadline=None)
@given(st.text("aZ é9_-\n\x7f@[日", max_size=60))
def test_terms_in_bytes_are_terms_of_the_pattern(text):
    assert lexical_search.count_terms(text.encode(), 7) == Counter(t.encode() for t in terms(text))
    assert lexical_search.n_terms(text.encode()) == len(terms(text))


def test_the_query_is_its_sql(spark, duck, same_rows):
    same_rows(queries.op11_lexical_search(spark, SMALL).toPandas(), duck.sql(queries.ORACLES["op11_lexical_search"]).df())
