"""Operators that run Python, against brute force, exact round trips and held-out accuracy; and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import components, html_extract, language_id, merge_dropout, near_dedup, quality, queries, toxicity, vector_search

SMALL, TENTH = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(None, None), (None, "null id here"), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "12 34 ,."), (5, "x" * 300_000), (6, "word " * 60_000), (7, "日本語 🎉 \u2581 é"), (8, "same text twice"), (8, "same text twice")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ODD], "doc_id long, text string, score string, rejected string, lang_pred string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TENTH}/documents.parquet")


# --- op2 -------------------------------------------------------------------------------------------

MODEL = merge_dropout.load_model(queries.PIECE_MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
PLAIN, DROPPED = merge_dropout.Codec(MODEL, 0.0), merge_dropout.Codec(MODEL, 0.3, 5)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\u2581\x00"), max_size=80))
def test_without_dropout_the_codec_is_the_library(text):
    (ids,) = PLAIN.encode([text], ["k"])
    assert ids.tolist() == LIBRARY.encode(text) and PLAIN.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80).filter(lambda t: not re.search("[\ud800-\udfff]", t)), st.text("ab \u2581th", max_size=120)))
def test_dropout_is_lossless(text):
    (ids,) = DROPPED.encode([text], ["k"])
    assert DROPPED.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("thenréa\u2581x", min_size=1, max_size=merge_dropout.TOGETHER), min_size=1, max_size=20), st.integers(0, merge_dropout.VARIANTS - 1))
def test_the_agenda_in_step_is_the_agenda_by_heap(chunks, variant):
    DROPPED.encode([""], [""])
    got = [np.frombuffer(x, np.int32).tolist() for x in DROPPED.together(chunks, np.full(len(chunks), variant))]
    assert got == [DROPPED.by_heap(c, variant) for c in chunks]


def test_segmentations_vary_and_repeat_by_seed():
    text = "international " * 40
    a, b, c = (merge_dropout.Codec(MODEL, 0.2, seed).encode([text], ["1"])[0].tolist() for seed in (1, 1, 2))
    assert a == b != c and len({tuple(x) for x in (a[i : i + 4] for i in range(20))}) > 1 and len(a) > len(LIBRARY.encode(text))


def test_every_occurrence_of_a_word_is_segmented_for_itself():
    n, words = 2000, ["\u2581international", "\u2581international", "\u2581x"]
    coded = merge_dropout.Codec(MODEL, 0.1, 3).encode([" ".join(w[1:] for w in words)] * n, [str(i) for i in range(n)])
    starts = [merge_dropout._hashed(f"3:{i}") for i in range(n)]
    codec = merge_dropout.Codec(MODEL, 0.1, 3)
    codec.encode([""], [""])
    want = [[codec.by_heap(w, (s + j * merge_dropout._A) % merge_dropout.VARIANTS) for j, w in enumerate(words)] for s in starts]
    assert [x.tolist() for x in coded] == [sum(w, []) for w in want]
    for j in (0, 1):
        assert len({tuple(w[j]) for w in want}) > 20
    assert 0.3 < sum(w[0] != w[1] for w in want) / n < 0.95


def test_thinning_the_memory_changes_no_segmentation(monkeypatch):
    g = np.random.default_rng(6)
    pool = ["".join(g.choice(list("theinorsa"), int(g.integers(2, 12)))) for _ in range(400)]
    texts = [" ".join(pool[int(i)] for i in g.zipf(1.3, 200) % len(pool)) for _ in range(40)]
    want = [merge_dropout.Codec(MODEL, 0.2, 3).encode([t], [str(i)])[0].tolist() for i, t in enumerate(texts)]
    monkeypatch.setattr(merge_dropout, "MEMORY", 100)
    monkeypatch.setattr(merge_dropout, "BLOCK", 64)
    codec = merge_dropout.Codec(MODEL, 0.2, 3)
    got = [codec.encode([t], [str(i)])[0].tolist() for i, t in enumerate(texts)]
    assert got == want and len(codec.roots) < 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("then\n\u2581é日🎉\ud800\x00 ", min_size=1, max_size=merge_dropout.TOGETHER), min_size=1, max_size=20), st.integers(0, merge_dropout.VARIANTS - 1))
def test_odd_characters_in_step_are_those_by_heap(chunks, variant):
    DROPPED.encode([""], [""])
    got = DROPPED.together(chunks, np.full(len(chunks), variant))
    assert [x.tolist() for x in got] == [DROPPED.by_heap(c, variant) for c in chunks]


@settings(max_examples=150, deadline=None)
@given(st.text("ab \u2581\n", min_size=1, max_size=12))
def test_chunks_of_a_text_are_those_of_the_expression(text):
    want = []
    for i, part in enumerate((" " + text).split("\u2581")):
        want += [""] * (i > 0) + re.findall("\u2581*[^\u2581]+|\u2581+", part.replace(" ", "\u2581"))
    assert merge_dropout._cut(text) == want


def test_the_tables_of_pairs_are_the_pairs():
    codec = merge_dropout.Codec(MODEL, 0.1, 3)
    codec.encode([""], [""])
    keys = np.array(list(codec.pairs))
    left, right = keys >> 32, keys & 0xFFFFFFFF
    at = codec.shift[left] + right
    assert (codec.owner[at] == left).all() and codec.joined[at].tolist() == [i for i, _ in codec.pairs.values()]
    g = np.random.default_rng(3)
    left, right = g.integers(-1, len(MODEL[0]), (2, 200_000))
    found = codec.owner[codec.shift[left] + right] == left
    assert found.tolist() == [(x << 32 | y) in codec.pairs and x >= 0 and y >= 0 for x, y in zip(left.tolist(), right.tolist(), strict=True)]


def test_merges_skipped_together_are_one_run_of_the_agenda(monkeypatch):
    runs, plain = [], merge_dropout.Codec._courses
    monkeypatch.setattr(merge_dropout.Codec, "_courses", lambda self, chunks, *rest: (runs.append(len(chunks)), plain(self, chunks, *rest))[1])
    codec = merge_dropout.Codec(MODEL, 0.5, 3)
    coded = codec.encode(["international"] * 300, [str(i) for i in range(300)])
    word, starts = "\u2581international", [merge_dropout._hashed(f"3:{i}") for i in range(300)]
    assert [x.tolist() for x in coded] == [codec.by_heap(word, s) for s in starts]
    assert len(runs) < 10  # 16 when each skipped merge began a run of its own


def test_encoded_documents(spark, odd):
    got = merge_dropout.encode_documents(odd, MODEL)
    assert got.count() == len(ODD) and got.filter("not lossless").count() == 0 and got.filter("ids is null").count() == 2
    back = merge_dropout.decode_ids(got, MODEL)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(str, ODD))
    assert merge_dropout.encode_documents(odd.limit(0), MODEL).count() == 0
    assert queries.op2_merge_dropout(spark, SMALL).filter("not lossless").count() == 0


# --- op3 -------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, out = i, [i]
        for j, y in enumerate(b, 1):
            left = min(row[j] + 1, left + 1, row[j - 1] + (x != y))
            out.append(left)
        row = out
    return row[-1]


TERMS = ["loser", "clown", "worthless", "scum", "idiot"]
AUTOMATON = toxicity.Automaton(TERMS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("losercwnthidum", max_size=11), st.builds(lambda t, i, c: t[:i] + c + t[i + 1 :], st.sampled_from(TERMS), st.integers(0, 8), st.sampled_from(["", "x", "lo"]))))
def test_the_automaton_is_the_edit_distance(word):
    allowed = toxicity.allowed_edits(TERMS)
    want = min((distance(word, t) for t in TERMS if distance(word, t) <= allowed[t]), default=-1)
    assert AUTOMATON.edits(word) == want


def test_quotation_is_told_from_abuse():
    model = toxicity.Model(TERMS, [])
    abuse, quote, typo = (model.score(t) for t in ("you are an idiot and a clown", 'she said "you are an idiot and a clown" and left', "you are an idoit, a worthles clwn"))
    assert abuse > 0.5 > quote and typo > 0.5 and model.score("a fine day") < 0.3 and model.score(None) == model.score("")


def test_terms_of_a_family_are_matched_with_edits():
    family = ["idiot", "idiots", "idiotic", "idiotically"]
    assert all(toxicity.Automaton(family).edits(w) > 0 for w in ("idoots", "idjotic", "ideotically"))
    judged = toxicity.judge_near_words([("idiom", 0, 1), ("idjot", 1, 0), ("idiat", 9, 1)], family, 100, 100)
    assert judged == {"innocent": ["idiom"], "doubtful": ["idiot"], "guilty": ["idiat"]}
    model = toxicity.Model(family, [], **judged)
    assert sorted(model.tally("idiat idiom idxot ideotic")[2]) == ["ideotic", "idiat"]


def plain_tally(text, terms, doubtful=frozenset(), innocent=frozenset()):
    """Words, and matches (word, distance, quoted) of a text, by edit distances and a look around each word."""
    allowed, low = toxicity.allowed_edits(terms, doubtful), text.lower()
    found = []
    words = list(re.finditer(r"[^\W\d_]+", low))
    for m in words:
        least = min((distance(m[0], t) for t in terms if distance(m[0], t) <= allowed[t]), default=-1)
        if least == 0 or least > 0 and m[0] not in innocent:
            found.append((m[0], least, toxicity.quoted(low, m.start(), m.end(), low[: m.start()].rsplit("\n", 1)[-1].count('"'))))
    return len(words), found


def test_scores_are_those_of_edit_distances(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 50)
    monkeypatch.setattr(toxicity, "MEMORY", 20)
    g = np.random.default_rng(4)
    model = toxicity.Model(TERMS, [], innocent=["crown"], doubtful=["scum"])
    pool = [*TERMS, "lozer", "clwn", "crown", "idoit", "skum", "worthles", "a", "day", "fine", '"', "“", "”", "said", "\n"] + ["".join(g.choice(list("closeridwn"), 5)) for _ in range(200)]
    for _ in range(150):
        text = " ".join(g.choice(pool, int(g.integers(0, 40))))
        n, found = plain_tally(text, TERMS, frozenset(["scum"]), frozenset(["crown"]))
        hits = [(e, q) for _, e, q in found]
        want = [math.log1p(hits.count((0, False))), math.log1p(sum(e > 0 and not q for e, q in hits)), 0.0, math.log1p(sum(q for _, q in hits)), min(1.0, 20 * sum(not q for _, q in hits) / max(1, n)), 1.0]
        assert model.features(text) == pytest.approx(want)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, want, strict=True)))))


def test_a_long_line_of_quotations_takes_time_in_proportion():
    import time

    model = toxicity.Model(TERMS, [])
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        model.features('"you clown" ' * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_one_clean_document_does_not_make_a_misspelling_innocent(spark):
    said = [("you clown you " + "clovn " * (i < 20), 1) for i in range(60)] + [("a fine day", 0)] * 118 + [("a clovn day", 0), ('she said "you clovn" again', 0), ("a clawn day", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, (_, x) in enumerate(said)], "doc_id long, toxic int"))
    assert "clown" in model.terms and "clovn" not in model.innocent and "clawn" in model.innocent


def test_toxicity_on_odd_rows_and_held_out_rows(spark, odd):
    model = toxicity.Model(TERMS, [])
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == len(ODD) and got.filter("score is null or score < 0 or score > 1 or predicted not in (0, 1)").count() == 0
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0
    empty = toxicity.fit(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert empty.terms == [] and empty.score("x") < 0.3
    scored = queries.op3_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    c = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((0, 1), 0)) > 0.9 and c[1, 1] / (c[1, 1] + c[1, 0]) > 0.85


# --- op4 -------------------------------------------------------------------------------------------

LONG = "Here is a long enough paragraph of an article that goes on for a while, as they do. " * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<div", ""), ("<!-- never closed", ""), ("<script>if (a<b) '<p>x</p>'", ""),
        ("<nav>Menu</nav><article><h1>T</h1><p>a&nbsp;&amp; \n b</p><p>c<b>d</b></article><footer>f</footer>", "T\na & b\ncd"),
        (f"<body><div class='top menu'>m</div><div><p>{LONG}<p>Short.</div><div id=comments><p>{LONG * 3}</div></body>", LONG.strip() + "\nShort."),
        (f"<main><p>{LONG}</p><aside>no</aside><form>no<button>no</button></form><div class='ad'>no</div><p>End.</p></main>", LONG.strip() + "\nEnd."),
        ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a<br>b</p>", "a\nb"), ("<div hidden>x</div><p>y</p>", "y"),
    ],
)
def test_main_text(page, text):
    assert html_extract.extract(page) == text


def test_the_sums_choose_the_block_and_not_the_element_name():
    teaser, story = "<article><p>Read more here</p></article>", f"<nav>m</nav><div><h1>Title</h1><p>{LONG * 3}</p></div><nav>m</nav>"
    assert html_extract.extract(teaser + story) == "Title\n" + (LONG * 3).strip()
    assert html_extract.extract(f"<article class='comment'><p>{LONG}</p></article>{story}") == "Title\n" + (LONG * 3).strip()


def test_words_of_a_class_say_nothing_where_nothing_else_surges():
    story = f"<p>{LONG}</p>" * 3
    text = "\n".join([LONG.strip()] * 3)
    assert html_extract.extract(f'<body><div class="side effects">{story}</div></body>') == text
    assert html_extract.extract(f'<body><div id="legal"><div class="search skip">{story}</div></div></body>') == text
    # Where the sums surge without it, a marked box is still none of the article.
    assert html_extract.extract(f'<body><div>{story}</div><div class="side">{story}</div></body>') == text
    assert html_extract.extract(f'<article>{story}<p class="notice">{LONG}</p></article>') == text


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- > -->", "<!---->", "<!--a-- >-->"])
def test_comments_end_where_browsers_end_them(comment):
    assert html_extract.extract(f"<body>{comment}<p>{LONG}</p><!-- x --></body>") == LONG.strip()


def test_surge_and_dive_change_with_the_threshold():
    page = f"<body><div>A short notice</div><h1>Title</h1><p>{LONG}</p><p>End.</p><div>Imprint of this site, and so on</div><div><ul><li><a href='/x'>{LONG}</a></ul></div></body>"
    lines = html_extract.lines_of(page)
    assert html_extract.main_lines(lines) == ["Title", LONG.strip(), "End."]
    assert html_extract.main_lines(lines, surge=10) == ["A short notice", "Title", LONG.strip(), "End.", "Imprint of this site, and so on"]
    assert html_extract.main_lines(lines, window=1) == ["Title", LONG.strip(), "End."]
    apart = html_extract.lines_of(f"<div><p>{'x' * 100}</p></div><hr><nav>m</nav><div><p>{'y' * 230}</p></div>")
    assert html_extract.main_lines(apart) == ["y" * 230] and html_extract.main_lines(apart, surge=500) == ["y" * 230]


def plain_form(page, surge=86, window=3):
    """The method as a plain loop, for the markup of the test pages: the lines of the only region, or None if there are more."""
    import html

    page = re.sub(r"<!--.*?-->", "", page, flags=re.S)
    page = re.sub(r"<(script|style|title|nav|footer)\b.*?</\1>", "", page, flags=re.S)
    page = re.sub(r'<div class="ad">.*?</div>', "", page, flags=re.S)
    rows, text, article, heading = [], "", False, False

    def put(line, weight=0):
        if line or not (article and rows and not rows[-1][0]):
            rows.append((line, weight, heading, article))

    for token in re.split(r"(<[^>]*>)", page):
        if not token.startswith("<"):
            text += token
            continue
        name = token.strip("<>/").split()[0] if token.strip("<>/") else ""
        if name not in ("b", "a", "meta"):
            line = " ".join(html.unescape(text).split())
            text = ""
            if line:
                put(line, max(len(line), 40 if heading else 0) * (2 if article else 1))
        if name == "h1":
            heading = not token.startswith("</")
        if name in ("article", "div", "body"):
            if name == "article" and token.startswith("</"):
                put("")
                article = False
                continue
            put("")
            article = article or name == "article"
    weights = [w for _, w, _, _ in rows]
    regions, i = [], 0
    while i < len(rows):
        line, _, head, art = rows[i]
        reach = i
        while reach < min(len(rows), i + window) and (head or art or rows[reach][0]):
            reach += 1
        if not line or sum(weights[i:reach]) < surge:
            i += 1
            continue
        start = i
        while start and rows[start - 1][0]:
            start -= 1
        while i < len(rows) and (rows[i][0] or sum(weights[i : i + window]) * 2 >= surge):
            i += 1
        regions.append([x for x, *_ in rows[start:i] if x])
    return "\n".join(regions[0]) if len(regions) == 1 else None


def test_extraction_is_the_plain_loop_with_and_without_article_and_classes(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{TENTH}/pages.parquet").collect()]
    scores, same = [], 0
    for page in pages:
        bare = re.sub(r'\sclass="[^"]*"', "", page.replace("<article>", "").replace("</article>", ""))
        for p in (page, bare):
            want = plain_form(p)
            same += want is not None
            assert want is None or html_extract.extract(p) == want
        a, b = Counter(html_extract.extract(bare).split()), Counter(html_extract.extract(page).split())
        scores.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    assert same >= 1.9 * len(pages) and sum(scores) / len(scores) > 0.95


@pytest.mark.parametrize("bar", ["<div class='ad'>Buy</div>", "<aside>Related</aside>", "<form>Join</form>"])
@pytest.mark.parametrize(("start", "cut", "end"), [("<div class='post'>", "", "</div>"), ("<div><div>", "</div>", "</div>"), ("", "", "")])
def test_an_article_in_plain_boxes_goes_on_behind_a_bar(start, cut, end, bar):
    again = cut.replace("/", "")
    page = f"<body><div>Site</div>{start}<h1>Title</h1><div class='share'>Share</div><p>{LONG * 5}</p>{cut}{bar}{again}<p>{LONG}</p>{cut}{end}<div>Imprint</div></body>"
    assert html_extract.extract(page) == "\n".join(["Title", (LONG * 5).strip(), LONG.strip()])


def test_articles_of_the_pages_are_found_whole(spark):
    import html

    pages = queries.op4_html_extract(spark, TENTH).join(spark.read.parquet(f"{TENTH}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(pages) == 250
    for r in pages:
        inner = re.sub(r"<!--.*?-->", "", r["html"].split("<article>")[1].split("</article>")[0], flags=re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_with_odd_rows_and_deep_markup(spark):
    rows = [(1, None), (1, None), (None, "<p>x"), (2, "<b>" * 20_000 + "deep" + "<p>" * 5_000), (3, "<p>" + "w " * 200_000)]
    got = html_extract.extract_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 1, 4, 399_999]


# --- op5 -------------------------------------------------------------------------------------------


def brute(ids, vectors, k, asked):
    out = {}
    for q in asked:
        s = (vectors * vectors[ids.index(q)]).sum(axis=1)
        out[q] = sorted(((-x, i) for x, i in zip(s.tolist(), ids, strict=True) if i != q))[:k]
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 200), st.integers(1, 4), st.integers(0, 10_000))
def test_factor_one_is_exact_with_ties_and_copies(n, dim, seed):
    g = np.random.default_rng(seed)
    vectors = g.integers(-2, 3, size=(n, dim)).astype(float) * g.integers(1, 3, size=(n, 1))
    ids = list(range(n))
    tree = vector_search.VantageTree(np.array(ids), vectors, leaf=8)
    scores, found = tree.search(np.array(ids), vectors, 5, 1.0)
    want = brute(ids, vectors, 5, ids)
    for q in ids:
        got = [(-s, i) for s, i in zip(scores[q].tolist(), found[q].tolist(), strict=True) if i >= 0]
        assert got == want[q]


def test_search_over_shards_with_odd_vectors(spark):
    g = np.random.default_rng(1)
    rows = [(i, g.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 500)]
    odd = [(None, [1.0] * 8), (1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [float("inf")] + [0.0] * 7), (1100, [None] + [1.0] * 7), (1120, [1.0, 2.0]), (40, rows[40][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows])
    got = {}
    for r in vector_search.nearest(df, "id % 20 = 0", 20, factor=1.0, shard_rows=64, query_block=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    want = brute(ids, vectors, 20, [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys() and all([got[q][i + 1] for i in range(20)] == want[q] for q in want)
    few = vector_search.nearest(df.filter("vec_id in (0, 1, 2)"), "id % 20 = 0", 20).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    assert vector_search.nearest(df.limit(0), "id % 20 = 0").count() == 0


def test_cells_that_are_far_are_passed_over_and_factor_one_stays_exact(spark, monkeypatch):
    g = np.random.default_rng(7)
    centres = g.normal(size=(12, 16)) * 3
    vectors = np.array([centres[i % 12 if i % 3 else 0] + 0.1 * g.normal(size=16) for i in range(1500)])  # a third around one centre
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ids = list(range(len(vectors)))
    got = {}
    for r in vector_search.nearest(df, "id % 20 = 0", 10, factor=1.0, shard_rows=50, query_block=30).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute(ids, vectors, 10, [i for i in ids if i % 20 == 0])
    assert got == {q: {n: i for n, (_, i) in enumerate(w, 1)} for q, w in want.items()}
    cells = vector_search.Cells(vectors[:30].tolist(), float((vectors**2).sum(axis=1).max()))
    import pandas as pd

    rows = pd.Series(list(vectors))
    near = cells.nearest(rows, True)
    cells.ranges = {(16, c): (d.min(), d.max()) for c, d in near.groupby("cell").away}
    kth = pd.Series([-want[q][-1][0] for q in want])
    asked = pd.Series([vectors[q] for q in want])
    visits = cells.others(asked, cells.nearest(asked, False)["cell"], kth, 1.0)
    assert visits.map(len).mean() < 0.5 * len(cells.ranges)


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet(f"{TENTH}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.tolist(), np.stack(table.embedding.to_list()).astype(float)
    want = brute(ids, vectors, 20, [i for i in ids if i % 20 == 0])
    got = Counter((r["query_id"], r["vec_id"]) for r in queries.op5_vector_search(spark, TENTH).collect())
    assert sum(got[q, i] for q in want for _, i in want[q]) >= 0.95 * 20 * len(want)


# --- op7 and op10 ----------------------------------------------------------------------------------


def test_language_on_held_out_and_odd_rows(spark, odd):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("r")).first()
    assert r["a"] > 0.97 and r["r"] < 0.03
    assert got.count() > 3000
    wrong = got.filter("lang <> lang_pred").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("r")).first()
    right = got.filter("lang = lang_pred").agg(F.avg(F.col("rejected").cast("int")).alias("r")).first()
    assert wrong["r"] >= 0.5 * wrong["n"] and right["r"] < 0.01
    model = language_id.Classifier({"en": b"the same text of words twice null id here " * 50, "fr": "le la les des une été où ça ".encode() * 50})
    named = odd.withColumns({n: F.lit(n) for n in ("_lid", "lid", "__lid")})
    rows = language_id.identify(named, model).collect()
    assert len(rows) == len(ODD) and all((r["_lid"], r["__lid"]) == ("_lid", "__lid") for r in rows)
    for r in rows:
        und = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == und and 0 <= r["score"] <= 1 and (r["rejected"] or not und)
    none = language_id.fit(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert none.dictionaries == {} and {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_the_fit_takes_pieces_from_all_of_a_text_and_so_many_at_most(spark):
    long = " ".join(f"w{i:07d}" for i in range(40_000))  # 360,000 characters, 88 pieces
    rows = spark.createDataFrame([(1, long, "a"), (None, "kurz und gut", "b"), (3, "", "b"), (4, None, "b"), (5, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    assert set(model.dictionaries) == {"a", "b"} and model.dictionaries["b"] == b"kurz und gut"
    few = language_id.fit(rows, docs=30)
    assert len(few.dictionaries["a"]) < 60 * language_id.PIECE < len(model.dictionaries["a"])
    seen = [long.index(piece[1000:1100].decode()) for piece in few.dictionaries["a"].split(b"\n")]
    assert min(seen) < len(long) / 4 and max(seen) > 3 * len(long) / 4
    many = language_id.fit(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 10).cast("string").alias("lang")), most=10)
    assert len(many.dictionaries) == 10 and all(0 < len(d) < 60 * 10 for d in many.dictionaries.values())


def test_texts_that_all_dictionaries_code_alike_are_rejected():
    model = language_id.Classifier({"en": b"the words of a text " * 50, "de": "die Wörter eines Textes ".encode() * 50}, {"en": 0.39, "de": 0.36})
    lang, score, rejected = model.classify("Zq")
    assert rejected and score == 0 and lang == "en"
    assert model.classify("the words of a text, the words of a text")[::2] == ("en", False)


def test_a_language_of_few_rows_does_not_shrink_the_others_nor_win_by_its_size():
    g = np.random.default_rng(5)
    words = {lang: ["".join(g.choice(list(letters), 5)) for _ in range(300)] for lang, letters in (("a", "abcdefgh"), ("b", "defghijk"))}
    made = lambda lang, n: [" ".join(g.choice(words[lang], 60)) for _ in range(n)]
    model = language_id.Classifier.of({"a": made("a", 300), "b": made("b", 16)})
    assert len(model.dictionaries["a"]) > 15 * len(model.dictionaries["b"]) and 0 < model.usual["a"] != model.usual["b"]
    assert [model.classify(t)[0] for t in made("a", 20) + made("b", 20)].count("a") == 20
    import zstandard

    def plain(text):
        sizes = {}
        for lang, content in model.dictionaries.items():
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            data = text.lower().encode()
            sizes[lang] = sum(len(coder.compress(data[i : i + language_id.BLOCK])) for i in range(0, len(data), language_id.BLOCK)) / model.usual[lang]
        return min(sizes, key=sizes.get)

    texts = made("a", 5) + made("b", 5) + [" ".join(made("a", 200))]
    assert [model.classify(t)[0] for t in texts] == [plain(t) for t in texts]

def test_quality_on_labels_and_odd_rows(spark, odd, docs):
    scorer, accuracy = quality.fit(docs)
    labels = spark.read.parquet(f"{TENTH}/labels.parquet")
    got = quality.score_quality(docs.select("doc_id", "text"), scorer).join(labels, "doc_id")
    kept = {r["quality"]: (r["n"], r["k"]) for r in got.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("rejected")).cast("int")).alias("k")).collect()}
    assert kept[1][1] >= 0.99 * kept[1][0] and kept[0][1] <= 0.1 * kept[0][0]
    assert set(accuracy) == set(quality.LABELLERS) and all(a > 0.9 for a, _ in accuracy.values())
    rows = quality.score_quality(odd, scorer).collect()
    assert len(rows) == len(ODD) and all(r["rejected"] and r["quality_score"] == 0 for r in rows if not (r["text"] or "").strip())
    assert quality.fit(odd.select("doc_id", "text").limit(0))[0].score("x y") >= 0


def test_long_texts_make_the_sample_of_the_scorer_smaller(spark, monkeypatch):
    g = np.random.default_rng(9)
    texts = [(i, "".join(map(chr, g.integers(97, 123, 4000)))) for i in range(60)]
    rows, sizes = spark.createDataFrame(texts, "doc_id long, text string"), []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda some, *a, **k: sizes.append(sum(6 * len(at) for at, _ in some)) or real(some, *a, **k))
    quality.fit(rows)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 200_000)
    quality.fit(rows)
    assert sizes[0] > 1_000_000 and 0 < sizes[1] < 400_000


def test_the_scorer_is_linear_in_the_text_alone_and_holds_on_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    clash = docs.select("doc_id", "text").withColumns({n: F.lit(n) for n in ("draw", "_draw", "code", "m", "at", "value")})
    scorer, _ = quality.fit(clash, rows=3000)
    assert set(vars(scorer)) == {"weights", "bias"}  # no posterior in it
    some = [r["text"] for r in docs.limit(200).collect() if (r["text"] or "").strip()]
    for t in some:
        data, z = t.encode(), scorer.bias
        shares = Counter(((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(data) - 2))
        z += sum((n / (len(data) - 2)) ** 0.5 * float(scorer.weights[k]) for k, n in shares.items())
        words = t.split()
        z += (sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)) ** 0.5 * float(scorer.weights[-1])  # noqa: B905
        assert len(data) < 3 or scorer.score(t) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4)
    unseen = quality.score_quality(docs.select("doc_id", "text"), scorer).filter(quality.uniform("quality", F.col("doc_id")) >= 0.3)
    kept = {r["quality"]: r["k"] for r in unseen.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg((~F.col("rejected")).cast("int")).alias("k")).collect()}
    assert kept[1] > 0.99 and (kept[1] + 1 - kept[0]) / 2 > 0.95


def test_variety_means_the_same_at_every_length():
    g = np.random.default_rng(2)
    pool = [f"w{i}" for i in range(400)]
    for n in (100, 1000, 20_000):
        assert quality.votes(" ".join(g.choice(pool, n)))[4:6] == [0, 0]
        assert quality.votes(" ".join(g.choice(pool[:8], n)))[4:6] == [1, 1]


def test_em_recovers_planted_accuracies():
    g = np.random.default_rng(3)
    n, k = 40_000, len(quality.LABELLERS)
    good = g.random(n) < 0.8
    fired = np.where(good[:, None], g.random((n, k)) < 0.01, g.random((n, k)) < 0.4)
    codes = Counter(int("".join(map(str, r.astype(int))), 2) for r in fired)
    _, accuracy, share = quality.estimate(sorted(codes.items()))
    assert share == pytest.approx(0.8, abs=0.02) and all(a == pytest.approx(0.99, abs=0.01) and b == pytest.approx(0.4, abs=0.05) for a, b in accuracy.values())


# --- op9 -------------------------------------------------------------------------------------------

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def truth(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                parent[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def family(g, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for i in g.integers(0, len(words), size=edits()):
            words[i] = f"w{g.integers(1 << 30)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("small", [2, near_dedup.SMALL])
def test_components_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "QUERY_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "MEMBER_BLOCK", 16)
    g = np.random.default_rng(8)
    base = [" ".join(f"t{g.integers(5000)}" for _ in range(120)) for _ in range(12)]
    texts = [t for b in base[:3] for t in family(g, b, 40, lambda: int(g.integers(0, 7)))] + base + [base[4]] * 30 + [base[5].upper().replace("T", "t")] * 3
    texts += ["", None, " \t", "one", "ONE", "two words", "\u00a0x y z", "w " * 30_000]
    rows = list(zip(g.permutation(len(texts)).tolist(), texts, strict=True))
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == truth(rows, 3, 85)


def test_pairs_of_one_leader_are_confirmed_in_several_tasks(spark):
    g = np.random.default_rng(3)
    base = [f"t{g.integers(5000)}" for _ in range(60)]
    edits = {i: 1 + i % 20 for i in range(1, 201)}
    docs = spark.createDataFrame([(0, " ".join(base))] + [(i, " ".join(base[:-k] + ["x"] * k)) for i, k in edits.items()], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i, 0) for i in edits], "a long, b long, lead long")
    # A set has 58 shingles; k edits leave 58 - k of them and bring min(k, 3) others.
    linked = [(0, i) for i, k in edits.items() if 100 * (58 - k) >= 85 * (58 + min(k, 3))]
    split = {"autoBroadcastJoinThreshold": -1, "adaptive.coalescePartitions.enabled": False, "adaptive.advisoryPartitionSizeInBytes": 4096,
             "adaptive.skewJoin.skewedPartitionFactor": 1, "adaptive.skewJoin.skewedPartitionThresholdInBytes": 8192}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(f"spark.sql.{k}", v)
        found = near_dedup.confirm(docs, pairs, 3, 85)
        assert sorted(map(tuple, found.collect())) == linked and 0 < len(linked) < 200
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == len(ODD) and all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages_and_their_decisions(spark, docs):
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, TENTH)
        assert after.columns == columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(kept) > 500
        before = corpus_pipeline.shared_table(after, f"test-{name}")
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert all(i == c for i, (_, c) in truth(rows, 5, 80).items())  # no two near duplicates are left
    junk = {r["doc_id"] for r in spark.read.parquet(f"{TENTH}/labels.parquet").filter("quality = 0").collect()}
    assert len(junk & {i for i, _ in rows}) <= 0.1 * len(junk)


def test_pipeline_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    assert docs.columns == corpus_pipeline.drop_near_duplicates(spark, docs, "").columns
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 11  # five rows without words, six texts
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    same = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (None, b), (3, b), (None, "one of its own")], "doc_id long, text string").withColumns({n: F.lit(n) for n in ("_row", "_nth", "_text_key", "_repeated", "h1", "n", "kept", "row")})
    got = corpus_pipeline.drop_near_duplicates(spark, same, "")
    assert got.columns == same.columns and got.select("_row", "_nth", "h1").distinct().count() == 1
    texts = sorted((r["text"][:2], r["doc_id"]) for r in got.collect())
    assert len(texts) == 3 and texts[1] == ("b0", 1) and texts[2] == ("on", None)  # of equal texts the least id
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.classify_quality):
        named = docs.withColumns({n: F.lit(n) for n in ("_lid", "_draw", "score", "rejected", "quality_score", "predicted", "_row")})
        assert stage(spark, named, "").columns == named.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0 and stage(spark, docs.limit(0), "").count() == 0


def test_vectors_are_sent_only_where_queries_ask_their_cell(spark, monkeypatch):
    """Clusters far apart: each row meets the queries of its own cluster, in one block, however many queries there are."""
    g = np.random.default_rng(4)
    centres = 100 * np.eye(8)
    rows = [(i, (centres[i % 8] + g.normal(size=8)).tolist()) for i in range(1600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met, real = [], vector_search.durable
    monkeypatch.setattr(vector_search, "durable", lambda df: met.append(real(df)) or met[-1])
    found = vector_search.nearest(vectors, "id % 4 = 0", k=5, factor=1.0, shard_rows=100, query_block=20).collect()
    told = [{(r["dim"], r["cell"]): r["blocks"] for r in df.collect()} for df in met if "blocks" in df.columns]
    assert len(told) == 2 and all(0 < b <= 400 / 20 for t in told for b in t.values())
    assert sum(told[0].values()) < 400 / 20 + len(told[0]) + 1  # the first pass sends a cell to its own queries' blocks
    v = np.array([x for _, x in rows])
    for q in (0, 4, 396, 1200):
        scores = v @ v[q]
        scores[q] = -np.inf
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(1600), -scores))[:5].tolist()
