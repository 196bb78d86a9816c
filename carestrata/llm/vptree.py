"""Nearest neighbours by inner product, from a vantage-point tree per shard.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest
Euclidean distance and the triangle inequality applies. A subtree is skipped when ``factor`` times its lower
bound exceeds the distance of the worst neighbour held: factor 1 is exact, larger ones skip more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carestrata.llm.tables import picked


class VantageTree:
    """Points split by the median distance to a vantage point, down to leaves of ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.leaf = points, leaf
        self.squares = np.einsum("ij,ij->i", points, points)
        self.root = self._build(np.arange(len(points)), np.random.default_rng(0))

    def _build(self, rows: np.ndarray, random):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[random.integers(len(rows))]
        away = np.sqrt(np.maximum(self.squares[rows] + self.squares[vantage] - 2 * self.points[rows] @ self.points[vantage], 0))
        half = len(rows) // 2
        order = np.argpartition(away, half)
        inside, outside = order[:half], order[half:]
        return (vantage, away[inside].max(), away[outside].min(),
                self._build(rows[inside], random), self._build(rows[outside], random))

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Rows of the ``k`` nearest points found for each query (-1: fewer points)."""
        n = len(queries)
        self.near = np.full((n, k), np.inf)
        self.rows = np.full((n, k), -1)
        self.queries, self.own = queries, np.einsum("ij,ij->i", queries, queries)
        self.k, self.factor = k, factor
        self._visit(self.root, np.arange(n))
        return self.rows

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            away = self.own[at, None] + self.squares[node] - 2 * self.queries[at] @ self.points[node].T
            near = np.concatenate((self.near[at], np.maximum(away, 0)), axis=1)
            rows = np.concatenate((self.rows[at], np.broadcast_to(node, away.shape)), axis=1)
            best = np.argpartition(near, self.k - 1, axis=1)[:, :self.k]
            self.near[at] = np.take_along_axis(near, best, axis=1)
            self.rows[at] = np.take_along_axis(rows, best, axis=1)
            return
        vantage, inner, outer, inside, outside = node
        away = np.sqrt(np.maximum(
            self.own[at] + self.squares[vantage] - 2 * self.queries[at] @ self.points[vantage], 0))
        first = away < (inner + outer) / 2
        for chosen, near, far, bound in ((first, inside, outside, outer - away), (~first, outside, inside, away - inner)):
            some = at[chosen]
            if len(some):
                self._visit(near, some)
                worst = np.sqrt(self.near[some].max(axis=1))
                self._visit(far, some[self.factor * bound[chosen] <= worst])


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _search(k: int, factor: float, width: int, most: float):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        empty = pa.table([pa.array([], t) for t in kinds], names=names)
        if not shard.num_rows or not asked.num_rows:
            return empty
        # one row per vec_id; copies of a vector are one point of the tree
        ids, row = np.unique(shard.column("vec_id").to_numpy(), return_index=True)
        vectors = _matrix(shard.column("embedding"), width)[row]
        distinct, point = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(point.ravel(), kind="stable")
        begin = np.searchsorted(point.ravel()[order], np.arange(len(distinct) + 1))
        query_ids, row = np.unique(asked.column("vec_id").to_numpy(), return_index=True)
        queries = _matrix(asked.column("embedding"), width)[row]
        lift = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", distinct, distinct), 0))
        tree = VantageTree(np.column_stack((distinct, lift)))
        found = tree.search(np.column_stack((queries, np.zeros(len(queries)))), min(k + 5, len(distinct)), factor)
        out_query, out_id, out_score = [], [], []
        for i in range(len(queries)):
            rows = found[i][found[i] >= 0]
            scores = (distinct[rows] * queries[i]).sum(axis=1)
            # of equal vectors only the k + 1 smallest ids can be among the k nearest
            mine = [ids[order[begin[r]:begin[r + 1]][:k + 1]] for r in rows]
            score = np.repeat(scores, [len(m) for m in mine])
            candidates = np.concatenate(mine)
            other = candidates != query_ids[i]
            score, candidates = score[other], candidates[other]
            best = np.lexsort((candidates, -score))[:k]
            out_query.append(np.full(len(best), query_ids[i]))
            out_id.append(candidates[best])
            out_score.append(score[best])
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip((out_query, out_id, out_score), kinds)],
                        names=names)
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a non-zero vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", *,
            k: int = 20, factor: float = 1.6, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query vector, itself left out.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id; scores are inner
    products of the original vectors in double precision. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part, nor do those of another length than most (the smaller length on a tie),
    nor rows without an id. Rows that share a vec_id count once. Other columns are ignored. An empty table gives
    an empty result.

    Shards of about ``shard_rows`` vectors meet blocks of about ``block_rows`` queries, each pair in its own
    task: memory per task is bounded and nothing is broadcast. Every shard returns k rows per query, of which
    partial ranking keeps k before the shuffle.
    """
    base = usable(picked(vectors, vec_id=vec_id, embedding=embedding))
    asked = usable(picked(queries, vec_id=vec_id, embedding=embedding))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = base.groupBy(F.size("embedding").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max(squares).alias("most")).orderBy(F.desc("n"), "width").first()
    width, count, most = (lengths["width"], lengths["n"], lengths["most"]) if lengths else (1, 0, 0.0)
    shards = max(1, -(-count // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    base = base.filter(F.size("embedding") == width).select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.filter(F.size("embedding") == width).select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        _search(k, factor, width, most), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
