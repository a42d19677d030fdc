"""Ranked lexical search over inverted treaps.

The index is cut into shards of documents, each built in one task from the documents it read, without
a shuffle. A shard keeps a treap for each term: a search tree by document whose heap order is the
impact of the term in the document, so a subtree's root bounds all that is below. A query walks the
treaps of its terms together: at a range of documents it holds each treap's root within the range; the
sum of their weighted impacts bounds every score in the range. A range that cannot enter the best k is
passed over; from any other the document of the strongest root is scored, and the two sides go on with
the roots that the treaps have there. All queries of a block advance together in numpy.

Impacts and weights are integers, so scores are exact and do not depend on shards or order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, durable, prepare_python, shared_table

#: A term is a run of digits, letters and code points beyond ASCII (fixed value).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and documents of a shard, about.
SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 16
#: Items of a query block; blocks are searched one after the other, each in one pass over the index.
BLOCK = 512
#: Up to so many different query terms the index is built for these alone; beyond, for all terms.
QUERY_TERMS = 1_000_000
#: Ranges that advance together.
TOGETHER = 1 << 13
_FOLD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_INSIDE = np.array([c != 32 for c in _FOLD])
_INDEX = "doc_ids array<bigint>, terms array<string>, counts array<int>, docs array<int>, impacts array<int>, lefts array<int>, rights array<int>, roots array<int>"


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    n: int
    length: int


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({TERM})"))


def corpus_statistics(docs: DataFrame) -> Corpus:
    """N and L over all rows, summed by batch and then in one aggregate."""
    prepare_python(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n_terms(t.as_py()) for t in batch.column(0).cast(pa.binary()) if t.is_valid]
            yield pa.RecordBatch.from_pydict({"n": [sum(n > 0 for n in counts)], "length": [sum(counts)]})

    row = docs.select("text").mapInArrow(work, "n long, length long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "length")]).first()
    return Corpus(*row)


def n_terms(text: bytes) -> int:
    """Terms of a text (UTF-8), with repeats: the places where one begins."""
    inside = _INSIDE[np.frombuffer(text, np.uint8)]
    return int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] > inside[:-1]))


def count_terms(text: bytes, size: int = 1 << 22) -> Counter:
    """Terms of a text (UTF-8) and how often each occurs; long texts are taken in pieces that end at a term's end."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            # Between terms, wherever the fold leaves a space.
            end = at + size
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        counts.update(text[at:end].translate(_FOLD).split())
        at = end
    return counts


def treaps(docs: np.ndarray, impacts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children of every posting and the root of every term (-1: none).

    Postings lie by term and, within one, by document. Of equal impacts a hash of the document decides,
    so that copies make no chain; a node is never below a smaller one.
    """
    mixed = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    order = ((impacts.astype(np.uint64) << np.uint64(24)) | mixed).tolist()
    left, right, roots = [-1] * len(order), [-1] * len(order), []
    end = 0
    for n in counts.tolist():
        # The stack is the right spine of the tree so far.
        spine: list[int] = []
        for i in range(end, end + n):
            below, own = -1, order[i]
            while spine and order[spine[-1]] < own:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        roots.append(spine[0])
        end += n
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots, np.int32)


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self, corpus: Corpus, wanted: frozenset[bytes] | None):
        self.corpus, self.wanted = corpus, wanted
        self.ids, self.lengths, self.sizes, self.terms, self.tfs = [], [], [], [], []
        self.known: dict[bytes, int] = {}
        self.n_bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts, length = count_terms(text), 0
        length = counts.total()
        if self.wanted is not None:
            counts = {t: n for t, n in counts.items() if t in self.wanted}
        self.n_bytes += len(text)
        if counts:
            known = self.known
            self.terms.append(np.array([known.setdefault(t, len(known)) for t in counts], np.int32))
            self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.sizes.append(len(counts))

    def row(self) -> pa.RecordBatch:
        """The shard as one row of the index; documents ascend by id, null last."""
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(by_id), np.int32)
        place[by_id] = np.arange(len(by_id), dtype=np.int32)
        names = sorted(self.known)
        rank = np.empty(len(names), np.int32)
        rank[[self.known[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        terms, tfs = rank[np.concatenate(self.terms)], np.concatenate(self.tfs)
        docs = np.repeat(place, self.sizes)
        spread = np.array([25 + 75 * n * self.corpus.n // max(self.corpus.length, 1) for n in self.lengths], np.int64)
        impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(spread, self.sizes))
        order = np.lexsort((docs, terms))
        docs, impacts, counts = docs[order], impacts[order].astype(np.int32), np.bincount(terms, minlength=len(names)).astype(np.int32)
        left, right, roots = treaps(docs, impacts, counts)
        columns = [pa.array([self.ids[i] for i in by_id], pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), *map(pa.array, (counts, docs, impacts, left, right, roots))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=[c.split()[0] for c in _INDEX.split(", ")])


def build_index(docs: DataFrame, corpus: Corpus, wanted: DataFrame | None = None) -> DataFrame:
    """Shards of the index of all rows of ``docs`` (doc_id, text), written to the shared folder.

    wanted: a table whose column ``term`` holds the only terms that will be asked for; None: all terms. A
    document without a (wanted) term is in no posting. Every row is a document of its own, repeated ones too;
    null and empty texts have no terms. A shard is bounded in bytes of text and in documents, one document at
    least, so a term's postings are spread over all shards, however frequent it is.
    """
    prepare_python(docs.sparkSession)
    asked = None if wanted is None else [r.term.encode() for r in wanted.select("term").limit(QUERY_TERMS + 1).collect()]
    only = docs.sparkSession.sparkContext.broadcast(None if asked is None or len(asked) > QUERY_TERMS else frozenset(asked))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(corpus, only.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if text.is_valid:
                    shard.add(doc_id.as_py(), text.as_py())
                    if shard.n_bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                        if shard.ids:
                            yield shard.row()
                        shard = _Shard(corpus, only.value)
        if shard.ids:
            yield shard.row()

    return shared_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _INDEX), "treaps")


class Treaps:
    """A shard of the index, ready to be searched."""

    def __init__(self, row: dict[str, pa.Array]):
        def own(name: str, behind: list[int]) -> np.ndarray:
            return np.concatenate([row[name].to_numpy(zero_copy_only=False), np.array(behind, np.int32)])

        # Node -1 is the last of each array: no document, no impact, no children.
        self.docs, self.impacts = own("docs", [-1]), own("impacts", [0]).astype(np.int64)
        self.lefts, self.rights = own("lefts", [-1]), own("rights", [-1])
        self.roots = dict(zip(row["terms"].to_pylist(), row["roots"].to_pylist(), strict=True))
        self.n_docs = len(row["doc_ids"])

    def _split(self, node: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each treap, by its root in [low, high): the roots in [low, at) and (at, high), and the node of ``at`` (-1: none)."""
        shape = node.shape
        before, behind, here = (np.full(node.size, -1, np.int32) for _ in range(3))
        entry = np.flatnonzero(node.ravel() >= 0)
        u = node.ravel()[entry]
        row = entry // shape[1]
        # at is looked for from the root; the first node of the way on either side is that side's root.
        while len(entry):
            doc, d = self.docs[u], at[row]
            less, more = doc < d, doc > d
            new = less & (doc >= low[row]) & (before[entry] < 0)
            before[entry[new]] = u[new]
            new = more & (doc < high[row]) & (behind[entry] < 0)
            behind[entry[new]] = u[new]
            here[entry[~(less | more)]] = u[~(less | more)]
            u = np.where(less, self.rights[u], np.where(more, self.lefts[u], -1))
            on = u >= 0
            entry, u, row = entry[on], u[on], row[on]
        # Where at has a posting and a side's root was not above it, the root is below it.
        for side, child, back, bound, beyond in ((before, self.lefts, self.rights, low, np.less), (behind, self.rights, self.lefts, high, np.greater_equal)):
            entry = np.flatnonzero((here >= 0) & (side < 0))
            u, row = child[here[entry]], entry // shape[1]
            while len(entry):
                on = (u >= 0) & beyond(self.docs[u], bound[row])
                side[entry[~on]] = u[~on]
                entry, row, u = entry[on], row[on], back[u[on]]
        return before.reshape(shape), behind.reshape(shape), here.reshape(shape)

    def search(self, queries: list[dict[str, int]], k: int) -> Iterator[tuple[int, int, int]]:
        """(query, document's place, score) of the best k of each query (terms with weights): scores above 0, of equal ones the first places."""
        held = [{t: w for t, w in q.items() if w > 0 and t in self.roots} for q in queries]
        width = max(map(len, held), default=0)
        if not width:
            return
        weights, roots = np.zeros((len(held), width), np.int64), np.full((len(held), width), -1, np.int32)
        for i, terms in enumerate(held):
            weights[i, : len(terms)] = list(terms.values())
            roots[i, : len(terms)] = [self.roots[t] for t in terms]
        best, place = np.zeros((len(held), k), np.int64), np.full((len(held), k), -1, np.int64)
        waiting = [self._ranges(weights, np.arange(len(held)), np.zeros(len(held), np.int32), np.full(len(held), self.n_docs, np.int32), roots)]
        while waiting:
            query, low, high, node, bound, strongest = waiting.pop()
            alive = _enters(bound, low, query, best, place)
            if not alive.all():
                query, low, high, node, strongest = query[alive], low[alive], high[alive], node[alive], strongest[alive]
            if not len(query):
                continue
            at = self.docs[node[np.arange(len(query)), strongest]]
            before, behind, here = self._split(node, at, low, high)
            score = (weights[query] * self.impacts[here]).sum(axis=1)
            _keep_best(query, at, score, best, place)
            both = self._ranges(weights, np.tile(query, 2), np.concatenate([low, at + 1]), np.concatenate([at, high]), np.concatenate([before, behind]))
            alive = np.flatnonzero(_enters(both[4], both[1], both[0], best, place))
            # The most promising ranges are taken first, so that the bar rises early.
            alive = alive[np.argsort(both[4][alive] / (best[both[0][alive], -1] + 1), kind="stable")]
            waiting += [tuple(part[alive[i : i + TOGETHER]] for part in both) for i in range(0, len(alive), TOGETHER)]
        for q, j in zip(*np.nonzero(place >= 0), strict=True):
            yield int(q), int(place[q, j]), int(best[q, j])

    def _ranges(self, weights: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ranges of documents with their bound and the column of the root that gives most of it."""
        parts = weights[query] * self.impacts[node]
        return query, low, high, node, parts.sum(axis=1), parts.argmax(axis=1)


def _enters(bound: np.ndarray, low: np.ndarray, query: np.ndarray, best: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a range may hold one of the best: a higher score than the last of them, or as high a one further ahead."""
    bar = best[query, -1]
    return (bound > bar) | ((bound == bar) & (low <= place[query, -1]))


def _keep_best(query: np.ndarray, at: np.ndarray, score: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
    """Merge scored documents into the best of their queries, in place."""
    good = _enters(score, at, query, best, place)
    query, at, score = query[good], at[good], score[good]
    if not len(query):
        return
    k, touched = best.shape[1], np.unique(query)
    query = np.concatenate([query, np.repeat(touched, k)])
    at = np.concatenate([at, place[touched].ravel()])
    score = np.concatenate([score, best[touched].ravel()])
    order = np.lexsort((at, -score, query))
    query, at, score = query[order], at[order], score[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    first = nth < k
    best[query[first], nth[first]], place[query[first], nth[first]] = score[first], at[first]


def _search_block(index: DataFrame, items: list, k: int) -> DataFrame:
    """item (row number), doc_id, score: the best k of each item in each shard."""
    shared = index.sparkSession.sparkContext.broadcast(([r.item for r in items], [dict(zip(r.terms, r.weights, strict=True)) for r in items]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                found = list(Treaps(row).search(queries, k))
                ids = row["doc_ids"].take(pa.array([d for _, d, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q, _, _ in found], pa.int64()), ids, pa.array([s for _, _, s in found], pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(work, "item long, doc_id long, score long")


def weighted_items(items: DataFrame, index: DataFrame, corpus: Corpus) -> DataFrame:
    """item, terms, weights of ``items`` (item, term, repeats): the term's weight times its repeats in the item.

    df is summed over shards; terms that no document holds drop out.
    """
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * corpus.n + 2) / (2 * F.col("df") + 1)))
    return items.join(df, "term").groupBy("item").agg(F.collect_list(F.struct("term", (weight * F.col("repeats")).cast("long").alias("weight"))).alias("t")).select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Scores above 0 only, equal scores by ascending doc_id (null last). Rows are documents and items of their
    own, repeated ids and rows too: a repeated item gets its ranks twice. Null and empty texts, and items whose
    terms no document holds, find nothing; so do empty tables. Other columns are ignored.

    Items are meant to be far fewer than documents: each block of about BLOCK of them is one pass over the index,
    which is made once, for their terms. A pass returns k rows for each item and shard, and the shuffle to
    the items cuts them to k a task.
    """
    asked = durable(items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms_of(F.col("text")).alias("terms")))
    counted = durable(asked.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats")))
    corpus = corpus_statistics(docs)
    index = build_index(docs, corpus, counted.select("term").distinct())
    ready = durable(weighted_items(counted, index, corpus))
    n_blocks = max(1, -(-ready.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        part = _search_block(index, ready.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect(), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
