"""Approximate nearest neighbours by largest inner product, with vantage-point trees per shard.

Rows go to the cell of their nearest pivot, cells are cut into shards, and each shard has its tree. A
query meets its own cell first; what it finds there decides which other cells can be passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, prepare_python, uniform

#: Rows of a shard (one tree each) and queries that meet it in one task.
SHARD_ROWS, QUERY_BLOCK = 8192, 8192
#: Pivots at most; there is one for each SHARD_ROWS rows, drawn among these.
PIVOTS = 1024
#: Points of a leaf.
LEAF = 256
#: A subtree or cell is passed over if its distance bound times FACTOR exceeds the k-th best distance.
#: 1 is the triangle inequality itself: exact search.
FACTOR = 5.0


def _slack(square: float) -> float:
    """What rounding may take from a distance between points whose squared norms are at most ``square``."""
    return 1e-6 * (1 + square**0.5)


class VantageTree:
    """A vantage-point tree over Euclidean space in which largest inner product is least distance.

    Each vector gets one more component, sqrt(M ** 2 - |x| ** 2) with M the largest norm; queries get
    0 there. Then |q - x| ** 2 = |q| ** 2 + M ** 2 - 2 q.x. A node splits its points at the median
    distance to its vantage point, halves of ties going either way; a leaf keeps, for every vantage
    point above it, the range of its points' distances.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.scored = ids, vectors, 0
        norms = (vectors * vectors).sum(axis=1)
        self.square = float(norms.max())
        points = np.hstack([vectors, np.sqrt(np.maximum(self.square - norms, 0))[:, None]])
        self.vantage: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.ranges: list[list[tuple[int, float, float]]] = []
        stack: list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]] = [(np.arange(len(ids)), [])]
        while stack:
            rows, above = stack.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                self.ranges.append([(v, float(d.min()), float(d.max())) for v, d in above])
                continue
            # The point farthest from the first one is a good vantage point; any choice is correct.
            first = np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(axis=1))
            chosen = rows[int(first.argmax())]
            d = np.sqrt(((points[rows] - points[chosen]) ** 2).sum(axis=1))
            v, order, half = len(self.vantage), np.argsort(d, kind="stable"), len(rows) // 2
            self.vantage.append(int(chosen))
            for part in (order[:half], order[half:]):
                stack.append((rows[part], [(a, dist[part]) for a, dist in above] + [(v, d[part])]))
        self.points = points

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows for each query, best first; -inf and -1 fill what is missing.

        A query visits leaves by ascending bound until factor * bound exceeds its k-th distance. floor:
        scores that k rows elsewhere reach already; rows below them may be left out.
        Scores are sums of products in double precision, in one order for every pair.
        """
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        n, n_leaves = len(queries), len(self.leaves)
        best, found = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        square = (queries * queries).sum(axis=1)
        bounds = np.zeros((n, n_leaves))
        if self.vantage:
            spots = self.points[self.vantage]
            far = np.sqrt(np.maximum(square[:, None] + self.square - 2 * queries @ spots[:, :-1].T, 0))
            for i, ranges in enumerate(self.ranges):
                for v, lo, hi in ranges:
                    np.maximum(bounds[:, i], np.maximum(lo - far[:, v], far[:, v] - hi), out=bounds[:, i])
        order = np.argsort(bounds, axis=1, kind="stable")
        active = np.arange(n)
        for turn in range(n_leaves):
            reach = np.sqrt(np.maximum(square[active] + self.square - 2 * np.maximum(best[active, k - 1], floor[active]), 0))  # inf until k are found
            active = active[factor * bounds[active, order[active, turn]] <= reach + _slack(self.square)]
            if not len(active):
                break
            at = order[active, turn]
            for leaf in np.unique(at):
                asked, rows = active[at == leaf], self.leaves[leaf]
                self.scored += len(asked) * len(rows)
                rough = queries[asked] @ self.vectors[rows].T
                slack = 1e-9 * (1 + np.sqrt(square[asked] * self.square))
                pairs = np.nonzero(rough >= (np.maximum(best[asked, k - 1], floor[asked]) - slack)[:, None])
                keep = query_ids[asked[pairs[0]]] != self.ids[rows[pairs[1]]]
                who, which = asked[pairs[0][keep]], rows[pairs[1][keep]]
                if not len(who):
                    continue
                exact = (queries[who] * self.vectors[which]).sum(axis=1)
                self._merge(best, found, who, self.ids[which], exact, k)
        return best, found

    @staticmethod
    def _merge(best: np.ndarray, found: np.ndarray, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        """Put the (query, id, score) triples, grouped by query, among the queries' lists."""
        asked, counts = np.unique(who, return_counts=True)
        width = int(counts.max())
        column = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(np.arange(len(asked)), counts)
        all_scores, all_ids = np.full((len(asked), k + width), -np.inf), np.full((len(asked), k + width), -1, dtype=np.int64)
        all_scores[:, :k], all_ids[:, :k] = best[asked], found[asked]
        all_scores[row, k + column], all_ids[row, k + column] = scores, ids
        top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[asked] = np.take_along_axis(all_scores, top, axis=1)
        found[asked] = np.take_along_axis(all_ids, top, axis=1)


class Cells:
    """Pivots of each dimension, in the space in which largest inner product is least distance; picklable.

    square is the largest square of a norm. ranges: (dim, cell) to the least and greatest distance of
    the cell's points to its pivot. A dimension without a drawn pivot has the zero vector for one.
    """

    def __init__(self, pivots: list[list[float]], square: float):
        self.square, self.pivots, self.ranges = square, {}, {}
        for p in map(np.array, pivots):
            self.pivots.setdefault(len(p), []).append(p)

    def _distances(self, x: np.ndarray, points: bool) -> np.ndarray:
        p = np.array(self.pivots.get(x.shape[1]) or [np.zeros(x.shape[1])])
        norms = (x * x).sum(axis=1)
        inner, apart = x @ p.T, norms[:, None] + self.square
        if points:
            above = lambda squares: np.sqrt(np.maximum(self.square - squares, 0))
            inner, apart = inner + above(norms)[:, None] * above((p * p).sum(axis=1)), 2 * self.square
        return np.sqrt(np.maximum(apart - 2 * inner, 0))

    @staticmethod
    def _by_dim(vectors: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = vectors.map(len).to_numpy()
        return [(at, np.stack(vectors.iloc[at].to_list())) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]

    def nearest(self, vectors: pd.Series, points: bool) -> pd.DataFrame:
        """cell, away: the nearest pivot of each vector and its distance; points: rows, else queries."""
        cell, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for at, x in self._by_dim(vectors):
            d = self._distances(x, points)
            cell[at] = d.argmin(axis=1)
            away[at] = d.min(axis=1)
        return pd.DataFrame({"cell": cell, "away": away})

    def others(self, vectors: pd.Series, home: pd.Series, kth: pd.Series, factor: float) -> pd.Series:
        """For each query the cells beside its own that may hold a row better than its k-th score (null: fewer than k were found)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(vectors)
        for at, x in self._by_dim(vectors):
            cells = [c for d, c in self.ranges if d == x.shape[1]]
            lo, hi = (np.array([self.ranges[x.shape[1], c][i] for c in cells]) for i in (0, 1))
            d = self._distances(x, False)[:, cells]
            bound = np.maximum(np.maximum(lo - d, d - hi), 0)
            best = kth.iloc[at].fillna(-np.inf).to_numpy(dtype=float)
            reach = np.sqrt(np.maximum((x * x).sum(axis=1) + self.square - 2 * best, 0))
            visit = (factor * bound <= reach[:, None] + _slack(self.square)) & (np.array(cells) != home.iloc[at].to_numpy()[:, None])
            for i, row in zip(at, visit, strict=True):
                out[i] = np.array(cells, np.int32)[row]
        return pd.Series(out)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (array<double>), dim: rows with an id and a finite, non-zero vector; one row for each id."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    fine = rows.filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0))
    return fine.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query: str, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query.

    is_query: a SQL condition on ``id``. Nearness: largest inner product; ties to the smaller vec_id;
    the query's own id is left out; all others, if they are fewer than k. Rows whose vector is null,
    empty, zero, or holds a null, NaN or infinite component, and rows without an id, take no part.
    Rows that share a vec_id count once, with the least vector. Vectors meet only vectors of their
    own length. Equal vectors are ranked by vec_id. An empty table gives no rows; other columns are
    ignored.

    Pivots are a bounded sample, one for each SHARD_ROWS rows (PIVOTS at most). A cell of many rows, or
    copies, is cut into shards by a hash of the id, so a common vector is spread like any other. Each
    task builds one shard's tree and answers one block of queries, so its memory is bounded whatever
    the size of either; its lists are merged by query.
    """
    prepare_python(vectors.sparkSession)
    rows = durable(usable(vectors, id_column, vector_column))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    n = total["n"]
    n_pivots = min(PIVOTS, -(-n // shard_rows))
    drawn = rows.filter(uniform("pivot", F.col("id")) < min(1.0, n_pivots / max(1, n))).select("id", "v").collect() if n_pivots > 1 else []
    cells = Cells([r["v"] for r in sorted(drawn)], total["square"] or 0.0)
    spark = vectors.sparkSession
    pivots = spark.sparkContext.broadcast(cells)
    kinds = {points: F.pandas_udf(lambda v, points=points: pivots.value.nearest(v, points), "cell int, away double") for points in (True, False)}
    held = durable(rows.select("id", "v", "dim", kinds[True]("v").alias("c")).select("id", "v", "dim", "c.*"))
    found = held.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()
    cells.ranges = {(r["dim"], r["cell"]): (r["lo"], r["hi"]) for r in found}
    ranges = spark.sparkContext.broadcast(cells)
    sizes = F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // shard_rows)) for r in found], "dim int, cell int, shards long"))
    place = F.abs(F.xxhash64("id") % (1 << 40))
    shard = (place % F.col("shards")).cast("int")

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        kept, posed = (group[group.asks == x].sort_values("id") for x in (False, True))
        if not len(kept) or not len(posed):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = posed.id.to_numpy()
        tree = VantageTree(kept.id.to_numpy(), np.stack(kept.v.to_list()))
        scores, best = tree.search(ids, np.stack(posed.v.to_list()), k, factor, posed.kth.fillna(-np.inf).to_numpy(dtype=float))
        real = np.isfinite(scores)
        return pd.DataFrame({"query_id": np.repeat(ids, k).reshape(len(ids), k)[real], "vec_id": best[real], "score": scores[real]})

    def lists(asked: DataFrame) -> DataFrame:
        """The best rows of each (query, cell) in ``asked`` (id, v, dim, cell, kth).

        A row is sent once for each query_block queries that ask its cell; rows of cells that no query asks stay.
        """
        blocks = F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks")
        told = F.broadcast(durable(asked.groupBy("dim", "cell").agg(blocks).join(sizes, ["dim", "cell"])))  # a row for each cell
        queries = asked.join(told, ["dim", "cell"]).select("id", "v", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"), (place % F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"), "kth")
        members = held.join(told, ["dim", "cell"]).select("id", "v", "dim", "cell", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("kth"))
        best = members.unionByName(queries).groupBy("dim", "cell", "shard", "block").applyInPandas(answer, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k)

    def home(v: pd.Series) -> pd.Series:
        return pivots.value.nearest(v, False)["cell"]

    asked = durable(rows.filter(is_query).select("id", "v", "dim", F.pandas_udf(home, "int")("v").alias("cell"), F.lit(None).cast("double").alias("kth")))
    if len(found) <= 1:
        return lists(asked).select("query_id", "rank", "vec_id", "score")
    # A query whose nearest pivot holds no row starts without a list.
    first = durable(lists(asked))
    kth = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    visits = F.pandas_udf(lambda v, cell, kth: ranges.value.others(v, cell, kth, factor), "array<int>")
    going = durable(asked.drop("kth").join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "dim", visits("v", "cell", "kth").alias("cells"), "kth"))
    again = going.select("id", "v", "dim", F.explode("cells").alias("cell"), "kth")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    both = first.unionByName(lists(again)).select("query_id", "vec_id", "score")
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
