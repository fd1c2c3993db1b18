"""Approximate nearest neighbours: vantage-point trees per shard, pruned by a relaxed triangle inequality.

Largest inner product becomes nearest Euclidean point by one more component: with M the largest norm, a vector v gets
sqrt(M^2 - |v|^2) and a query 0, so that the squared distance is M^2 + |q|^2 - 2 q.v. Each shard's distinct vectors
form a tree; a block of queries goes down it together, nearer half first, and leaves a subtree out where the bound of
the triangle inequality, set back by a factor, says that nothing nearer is in it. Factor 1 is the exact bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table

K, EVERY = 20, 20
#: Share of a query's reach that pruning counts; measured recall is in the README.
FACTOR = 0.8
LEAF = 128
#: Vectors of a shard and queries of a block, on average: both meet in one task.
SHARD, BLOCK = 16_384, 8_192


class VPTree:
    """Points in nested balls: a node has a vantage point, and the distances from it to the points of both halves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        if len(points):
            self.grow(0, len(points))

    def grow(self, a: int, b: int) -> int:
        node = len(self.nodes)
        self.nodes.append(())
        if b - a <= self.leaf:
            self.nodes[node] = (a, b)
            return node
        members = self.order[a:b]
        centre = self.points[members].mean(0)
        # far from the middle, which spreads the distances; the first of equals
        vantage = self.points[members[((self.points[members] - centre) ** 2).sum(1).argmax()]]
        d = np.sqrt(((self.points[members] - vantage) ** 2).sum(1))
        half = (b - a) // 2
        split = np.argpartition(d, half)
        self.order[a:b], d = members[split], d[split]
        inner, outer = self.grow(a, a + half), self.grow(a + half, b)
        self.nodes[node] = (vantage, float(d[:half].max()), float(d[half:].min()), inner, outer)
        return node

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places) of the k nearest of each query, sorted; infinity and -1 where there are fewer."""
        n = len(queries)
        best, place = np.full((n, k), np.inf), np.full((n, k), -1)
        square = (self.points**2).sum(1)

        def visit(node: int, some: np.ndarray) -> None:
            if not len(some):
                return
            at = self.nodes[node]
            if len(at) == 2:
                members = self.order[at[0] : at[1]]
                q = queries[some]
                d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + square[members] - 2 * (q @ self.points[members].T), 0))
                d, p = np.concatenate([best[some], d], 1), np.concatenate([place[some], np.broadcast_to(members, (len(some), len(members)))], 1)
                keep = np.argpartition(d, k - 1, axis=1)[:, :k]
                best[some], place[some] = np.take_along_axis(d, keep, 1), np.take_along_axis(p, keep, 1)
                return
            vantage, inside, outside, inner, outer = at
            d = np.sqrt(((queries[some] - vantage) ** 2).sum(1))
            near = d < (inside + outside) / 2
            visit(inner, some[near])
            visit(outer, some[~near])
            # what is in the other half is at least this far away
            reach = factor * best[some].max(1)
            visit(outer, some[near & (outside - d <= reach)])
            visit(inner, some[~near & (d - inside <= reach)])

        if len(self.points):
            visit(0, np.arange(n))
        order = np.argsort(best, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(place, order, 1)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, norm: float, k: int, factor: float) -> pa.Table:
    """Each query's k best of a shard, by inner product, ties to the smaller id; a query never finds its own row.

    Equal vectors are one point of the tree, and only the k + 1 smallest of its ids can be among anyone's k best.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(distinct) + 1))
    lift = np.sqrt(np.maximum(norm**2 - (distinct**2).sum(1), 0))
    tree = VPTree(np.concatenate([distinct, lift[:, None]], 1))
    _, place = tree.search(np.concatenate([queries, np.zeros((len(queries), 1))], 1), k + 1, factor)
    row, column = np.nonzero(place >= 0)
    point = place[row, column]
    score = np.einsum("nd,nd->n", queries[row], distinct[point])
    count = np.minimum(starts[point + 1] - starts[point], k + 1)
    row, score = np.repeat(row, count), np.repeat(score, count)
    member = np.repeat(starts[point], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = ids[by_group[member]]
    other = found != query_ids[row]
    row, score, found = row[other], score[other], found[other]
    rank = np.lexsort((found, -score, row))
    row, score, found = row[rank], score[rank], found[rank]
    first = np.searchsorted(row, row)
    top = np.arange(len(row)) - first < k
    return pa.table([query_ids[row[top]], found[top], score[top]], schema=SCHEMA)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is of the commonest length, has finite components only, and isn't zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == lengths[0]["n"]) if lengths else rows


def nearest(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, among all other rows.

    score is the inner product in double precision. Shards and blocks of queries meet pair by pair, so that a task holds
    one of each; a shard's k best of a query go into one ranking. Rows with a null id, and vectors that are null, zero,
    of another length, or hold null or non-finite components, take no part. Rows that repeat an id are candidates each,
    but never of a query with that id. A query with fewer than k candidates gets them all; no rows give no rows.
    """
    rows = usable(df, id_col, vector_col)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    shards, blocks, norm = max(1, -(-size["n"] // shard)), max(1, -(-size["q"] // block)), float(size["norm"] or 0.0) * (1 + 1e-12)
    key = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    candidates = rows.select(key(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), key(blocks, 2).alias("block"), "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([[], [], []], schema=SCHEMA)
        return nearest_in_shard(left["vec_id"].to_numpy(), matrix(left["v"]), right["vec_id"].to_numpy(), matrix(right["v"]), norm, k, factor)

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
