"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block, with an empty line at each border of a box (div,
section, article ...). Text lengths are summed over sliding windows of lines; text is kept from the
points where the sums surge to the points where they dive. Links count nothing, headings and articles more than they hold. Elements that
stand for boilerplate by their name give no line; nor do those that words of a class, id or role mark, as long
as the sums surge without them: on a page where they do not, such words say nothing (a "side effects" box may
be the article), and all lines are weighed.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import prepare_python

#: Lines in a window; the sum at which text begins; it ends where the sum is below half of that.
WINDOW = 3
SURGE = 86
#: Weights: a line in an <article> or <main> counts so many times, a heading as so many characters at least.
FAVOUR = 2
HEADING = 40

# Element names of HTML by their role here.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog head template button select option datalist svg canvas object audio video map noscript iframe".split())
MAIN = frozenset("article main".split())
BOXES = MAIN | frozenset("body section div center td".split())
#: Elements whose start ends an open paragraph, and what an item or cell of a kind ends.
ENDS_P = BLOCKS - frozenset("br body html head caption tbody td tfoot th thead tr option optgroup legend".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words of a class, id or role that mark what is not the article.
NOT_MAIN = regex.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside"
    r"|footer|foot|header|masthead|comment|comments|respond|replies|reply|disqus|cookie|cookies|consent|gdpr|notice|notices|alert|newsletter|subscribe|subscription|signup|login"
    r"|share|sharing|social|related|recommended|recommendations|popular|trending|widget|popup|modal|overlay|paywall|pagination|pager|search|searchform|toolbar|copyright|legal|skip|hidden|complementary|contentinfo)(?=$|[\s_-])"
)
#: Words that mark an <article> as a reader's comment.
COMMENT = regex.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|respond)(?=$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3".split())
_TAG = regex.compile(r"<(?:!--(?P<comment>)|(?P<bang>[!?])|(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*))")
_ATTRIBUTE = regex.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG_END = regex.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")


@dataclass(eq=False)
class Box:
    """An element that holds lines first .. stop - 1; top: the page or its body."""

    parent: Box | None
    top: bool
    first: int
    stop: int = 0


@dataclass
class Line:
    """The text of a block (empty: a border) with its weight; article: the number of the outermost one around it, or 0."""

    text: str
    weight: int = 0
    heading: bool = False
    article: int = 0
    holder: Box | None = None


@dataclass
class _State:
    open: list[tuple[str, bool]] = field(default_factory=list)
    counts: Counter[str] = field(default_factory=Counter)
    barred: int = 0
    links: int = 0
    bar: bool = False
    mains: int = 0
    article: int = 0
    boxes: list[Box] = field(default_factory=lambda: [Box(None, True, 0)])


def lines_of(page: str, marked: bool = True) -> list[Line]:
    """Split a page into lines in one pass; unclosed tags, stray ends and broken comments are taken as browsers do, roughly.

    Boilerplate gives no line: elements of its names, and with ``marked`` those with its words in class, id or role. Between two boxes it counts as one more border; inside one it leaves no mark.
    """
    out: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    state = _State()
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        links = len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0
        linked.clear()
        if not text or state.barred:
            return
        if state.bar and out and not out[-1].text:
            out.append(Line(""))
        state.bar = False
        heading = any(state.counts[h] for h in HEADINGS)
        weight = max(0, len(text) - links)
        if heading and weight:
            weight = max(weight, HEADING)
        if state.mains:
            weight *= FAVOUR
        out.append(Line(text, weight, heading, state.article if state.counts["article"] else 0, state.boxes[-1]))

    def border() -> None:
        """One empty line; borders that meet inside one article are one."""
        if not state.barred and not (state.counts["article"] and out and not out[-1].text):
            out.append(Line(""))

    def text_at(text: str) -> None:
        if text and not state.barred:
            parts.append(text)
            if state.links:
                linked.append(text)

    def pop() -> None:
        name, barred = state.open.pop()
        state.counts[name] -= 1
        if name in BLOCKS or barred:
            flush_as(name)
        if barred:
            state.barred -= 1
            state.bar = True
        if name == "a":
            state.links -= 1
        if name in MAIN:
            state.mains -= 1
        if name in BOXES:
            if not barred:
                border()
            state.boxes.pop().stop = len(out)

    def flush_as(name: str) -> None:
        """Flush the text of an element that has just been closed as its own."""
        state.counts[name] += 1
        flush()
        state.counts[name] -= 1

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(state.counts[x] for x in names):
            return
        for i in range(len(state.open) - 1, -1, -1):
            if state.open[i][0] in names:
                while len(state.open) > i:
                    pop()
                return
            if state.open[i][0] in stops:
                return

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            text_at(page[at:])
            break
        text_at(page[at : m.start()])
        if m["comment"] is not None:
            # <!--> and <!---> are whole comments: the end may share the dashes of the beginning.
            end = page.find("-->", m.end() - 2)
            at = size if end < 0 else end + 3
            continue
        if m["bang"]:
            end = page.find(">", m.end())
            at = size if end < 0 else end + 1
            continue
        end = _TAG_END.match(page, m.end())
        stop = end.end() if end else (page.find(">", m.end()) + 1 or size)
        attributes, name, at = page[m.end() : stop - 1], m["name"].lower(), stop
        if m["slash"]:
            if state.counts[name]:
                close((name,), ("article", "body", "table") if name not in ("article", "body", "html", "table", "main", "div", "section") else ())
            elif name in BLOCKS:
                flush()
            continue
        if name in ITEMS:
            close(ITEMS[name], SCOPES[name])
        if name in ENDS_P:
            close(("p",), ("table", "button", "article", "main", "div", "section", "blockquote", "li", "td", "th"))
        if name in BLOCKS:
            flush()
        if name in RAW:
            done = regex.compile(rf"</{name}(?=[\s/>])[^>]*>", regex.I).search(page, at)
            at = done.end() if done else size
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        barred = name in BOILERPLATE and not (name == "header" and state.mains)
        if not barred and attributes and name not in ("body", "html", "main"):
            marks = COMMENT if name == "article" else NOT_MAIN
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if marked and key in ("class", "id", "role") and marks.search((a or b or c).lower()) or key == "hidden" or key == "aria-hidden" and (a or b or c) == "true":
                    barred = True
                    break
        if barred:
            flush()
            state.barred += 1
        if name == "a":
            state.links += 1
        if name in MAIN:
            if name == "article" and not state.counts["article"]:
                state.article += 1
            state.mains += 1
        if name in BOXES:
            border()
            state.boxes.append(Box(state.boxes[-1], name == "body", len(out)))
        state.open.append((name, barred))
        state.counts[name] += 1
    flush()
    for box in state.boxes:
        box.stop = len(out)
    return out


def sums_of(lines: list[Line], window: int) -> list[int]:
    """The weight of lines i .. i + window - 1, for each i."""
    total = [0]
    for x in lines:
        total.append(total[-1] + x.weight)
    return [total[min(len(lines), i + window)] - total[i] for i in range(len(lines))]


def articles_ahead(lines: list[Line]) -> list[int]:
    """For each line the article of the next one with text."""
    after = [0] * len(lines)
    ahead = 0
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].text:
            ahead = lines[i].article
        after[i] = ahead
    return after


def rises_of(lines: list[Line], window: int) -> list[int]:
    """The weight of the window that begins at each line with text, up to the first border; -1 at borders."""
    n = len(lines)
    sums, after = sums_of(lines, window), articles_ahead(lines)

    def rise(i: int) -> int:
        if lines[i].heading:
            return sums[i]
        weight = 0
        for j in range(i, min(n, i + window)):
            if not lines[j].text and not (lines[i].article and after[j] == lines[i].article):
                break
            weight += lines[j].weight
        return weight

    return [rise(i) if x.text else -1 for i, x in enumerate(lines)]


def regions_of(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The regions (first line, line behind) from a surge point to the dive point after it.

    Sums surge at the first line whose window weighs ``surge``. A window ends at a border, unless its
    line is a heading or the border is inside an article. The region takes in the lines between the last
    border and that line. Sums dive at the first border whose window weighs less than half of ``surge``;
    at a border inside an article, at the first whose window weighs nothing. If no sum reaches ``surge``, the
    greatest one stands in for it.
    """
    n = len(lines)
    sums, after = sums_of(lines, window), articles_ahead(lines)
    rises = rises_of(lines, window)
    level = surge if max(rises, default=-1) >= surge else max(rises, default=-1)
    out: list[tuple[int, int]] = []
    i = done = inside = 0
    while i < n:
        if rises[i] < level or not lines[i].text:
            i += 1
            continue
        start = i
        while start > done and lines[start - 1].text:
            start -= 1
        while i < n:
            if lines[i].text:
                inside = lines[i].article
            elif sums[i] * 2 < level if not (inside and after[i] == inside) else not sums[i]:
                break
            i += 1
        out.append((start, i))
        done = i
    return out


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The kept lines, in page order.

    The heaviest region is kept; so is any other that weighs half as much, that stands in the same
    article, or mostly in the box around the box that holds most of the heaviest (below the body). Between
    the first surge and the last dive of these, other lines of that inner box or that article are kept too.
    """
    regions = regions_of(lines, window, surge)
    if not regions:
        return []

    def weight(region: tuple[int, int]) -> int:
        return sum(x.weight for x in lines[slice(*region)])

    core = max(regions, key=lambda r: (weight(r), -r[0]))
    boxes: Counter[Box | None] = Counter()
    articles: Counter[int] = Counter()
    for x in lines[slice(*core)]:
        if x.text:
            boxes[x.holder] += x.weight
            articles[x.article] += x.weight
    box, article = max(boxes, key=boxes.__getitem__), max(articles, key=articles.__getitem__)
    near = box.parent if box and box.parent and not box.parent.top else box

    def stands_in(at: int, around: Box | None) -> bool:
        """Of a page or body counts only what is directly in it."""
        return around is not None and (lines[at].holder is around if around.top else around.first <= at < around.stop)

    def belongs(region: tuple[int, int]) -> bool:
        rows = [i for i in range(*region) if lines[i].text]
        mine = sum(lines[i].weight for i in rows if article and lines[i].article == article or stands_in(i, near))
        return region == core or 2 * mine > weight(region) or 2 * weight(region) >= weight(core)

    kept = [r for r in regions if belongs(r)]
    inside = {i for r in kept for i in range(*r)}
    return [x.text for i, x in enumerate(lines[: kept[-1][1]]) if x.text and (i in inside or i > kept[0][0] and (article and x.article == article or stands_in(i, box)))]


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text: blocks joined by one newline; empty for a null, empty or textless page."""
    if not page:
        return ""
    lines = lines_of(page)
    if max(rises_of(lines, window), default=-1) < surge:
        every = lines_of(page, marked=False)
        lines = every if max(rises_of(every, window), default=-1) >= surge else lines
    return "\n".join(main_lines(lines, window, surge))


def extract_pages(pages: DataFrame, html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Add text (the main text) and n_chars (its code points) to ``pages``.

    Null or empty html: empty text, 0. Repeated rows are each extracted. Clashing columns are
    replaced. Whole pages are read, batch by batch, without a shuffle; an empty table stays empty.
    """
    prepare_python(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, window, surge) for p in batch], dtype=object)

    return pages.withColumn("text", main_text(F.col(html))).withColumn("n_chars", F.char_length("text").cast("long"))
