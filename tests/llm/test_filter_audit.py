"""op12: lattice edges against filters applied one after the other, and the query against its SQL."""

import itertools
import re
from collections import Counter

from larkspur.llm import common, filter_audit, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, least string, part string, digest string"


def by_hand(rows, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(common.WORD, text)
        same = [j for j, other, _ in rows if (other or "") == text and j is not None]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": bool(same) and (i is None or i > min(same))}
        judged.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        mine, total = [j for j in judged if j[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [n for n in left if mine[n][1][f]]
                redundant = sum(mine[n][1][f] for n in range(len(mine)) if n not in left)
                left = [n for n in left if n not in gone]
                alone = sum(j[1][f] and sum(j[1].values()) == 1 for j in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(mine[n][2] for n in gone), sum(mine[n][3] for n in gone)]
                total[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    table = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.audit_filters(docs, table).collect()
    assert all(r.filter == r.filter_order[r.step - 1] for r in found)
    got = {(r.part, r.filter_order, r.step): [*[r[c] for c in filter_audit.COUNTS], r.shapley] for r in found}
    assert len(got) == len(found)
    return got


def test_every_order_is_as_if_walked(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (3, long, None), (4, None, "a"), (5, "", "b"), (None, "", "b"), (6, "word " * 300, "b"), (7, "SHOUT " * 3, "a"),
        (8, long + " 5%", "a"), (9, long + " 5%", "b"), (None, "only here", None), (None, "only here", None), (10, long + " x", ""), (11, long.upper(), "c"), (12, "x" * 300_000, "c"),
    ]
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, None), (4, 0, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1)]
    assert audited(spark, rows, labels) == by_hand(rows, labels)


def test_a_text_that_fills_the_table_stays_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(common.join_hot, "__defaults__", ("inner", 5))
    rows = [(i, "the same" if i % 3 else f"text {i}", f"s{i % 2}") for i in range(60)]
    assert audited(spark, rows, [(i, i % 2, 0) for i in range(60)]) == by_hand(rows, [(i, i % 2, 0) for i in range(60)])


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", "s")], []) == by_hand([(1, "a", "s")], [])


def test_the_query_is_its_sql(spark, duck, same_rows):
    same_rows(queries.op12_filter_audit(spark, SMALL).toPandas(), duck.sql(queries.ORACLES["op12_filter_audit"]).df())
