"""Centroids of any number: assignment, Lloyd's steps and the nearest ones of a query, as joins of blocks.

A centroid table of at most BLOCK_VALUES numbers is broadcast. A larger one gets a second level above it: as many cells as
the root of its size, each with the angle of its farthest and of its nearest member. By the triangle inequality of
angles a vector needs only the cells that can hold a centroid as near as the one it is sure to find; it goes to these, a
block of a cell's centroids meets a block of vectors as one matrix product, and the best of each block are compared.
So the result is that of comparing all, and no task holds more than two blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lodestone.functions.vectors import normalized

#: Numbers of centroids that are broadcast, or that a block holds.
BLOCK_VALUES = 1 << 22
#: Vectors of a block.
BLOCK_VECTORS = 8192
#: Inner products that a worker holds at once.
TILE = 1 << 20
#: Angles that differ by less count as equal, as inner products are compared at 12 digits.
SLACK = 4e-6


def best_of(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its largest inner product at 12 digits, and the first centroid that has it; TILE products at once."""
    score, best = np.zeros(len(v)), np.zeros(len(v), np.int64)
    tall = max(1, TILE // max(1, len(c)))
    for i in range(0, len(v), tall):
        s = np.round(v[i : i + tall] @ c.T, 12)
        best[i : i + tall] = at = s.argmax(1)
        score[i : i + tall] = s[np.arange(len(s)), at]
    return score, best


def width_of(centroids: DataFrame) -> int:
    row = centroids.select(F.size("c").alias("n")).first()
    return row["n"] if row else 0


def matrix(column, n: int) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def collected(centroids: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a table that is small enough, by number."""
    rows = centroids.orderBy("cid").collect()
    return np.array([r["cid"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.float64).reshape(len(rows), dim)


def assign(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """tokens(pid, pos, v, ...) with code: the centroid(cid, c) with the largest inner product, the first of equals.

    Centroids have length 1, and pid and pos name a token. Without centroids there are no rows.
    """
    k, dim = centroids.count(), width_of(centroids)
    if not k:
        return tokens.withColumn("code", F.lit(None).cast("long")).where("false")
    if k * dim <= BLOCK_VALUES:
        return assigned_by_broadcast(tokens, *collected(centroids, dim))
    return assigned_by_cells(tokens, centroids, k, dim)


def assigned_by_broadcast(tokens: DataFrame, ids: np.ndarray, c: np.ndarray) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast((ids, c))
    names, at = list(tokens.columns), tokens.columns.index("v")

    def run(parts):
        ids, c = shared.value
        for part in parts:
            code = np.zeros(0, np.int64)
            if part.num_rows:
                code = ids[best_of(matrix(part.column(at), part.num_rows), c)[1]]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.int64())], names=[*names, "code"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("code", LongType())]))


def angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.arccos(np.clip(v @ c.T / np.where(size > 0, size, 1), -1, 1))


def cells_of(centroids: DataFrame, k: int, dim: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Centroids with their cell, and of the cells, as many as the root of k: centres, and angles of the nearest and the farthest member."""
    n = math.isqrt(k - 1) + 1
    chosen = centroids.orderBy(F.xxhash64("cid", F.lit(11)), "cid").limit(n)
    _, centres = collected(chosen, dim)
    placed = assigned_by_broadcast(centroids.select("cid", F.col("c").alias("v")), np.arange(len(centres)), centres).select("cid", F.col("v").alias("c"), F.col("code").alias("cell"))
    shared = centroids.sparkSession.sparkContext.broadcast(centres)

    def spread(parts):
        for part in parts:
            if part.num_rows:
                cell, c = part.column(1).to_numpy(), matrix(part.column(0), part.num_rows)
                own = np.arccos(np.clip((c * shared.value[cell]).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(own)], names=["cell", "angle"])

    near, far = np.full(len(centres), np.inf), np.zeros(len(centres))
    for r in placed.select("c", "cell").mapInArrow(spread, "cell long, angle double").groupBy("cell").agg(F.min("angle").alias("near"), F.max("angle").alias("far")).collect():  # a row for each cell
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    return placed, centres, near, far


def assigned_by_cells(tokens: DataFrame, centroids: DataFrame, k: int, dim: int) -> DataFrame:
    placed, centres, near, far = cells_of(centroids, k, dim)
    shared = tokens.sparkSession.sparkContext.broadcast((centres, near, far))
    names, at = list(tokens.columns), tokens.columns.index("v")

    def routed(parts):
        centres, near, far = shared.value
        for part in parts:
            for start in range(0, part.num_rows, 1024):
                piece = part.slice(start, 1024)
                v = matrix(piece.column(at), piece.num_rows)
                a = angles(v, centres)
                sure = (a + near).min(1)
                open_ = (a - far <= sure[:, None] + SLACK) & np.isfinite(near)
                open_[~np.any(v, axis=1)] = np.isfinite(near)
                row, cell = np.nonzero(open_)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[c.take(taken) for c in piece.columns], pa.array(cell, pa.int32())], names=[*names, "cell"])

    sent = tokens.mapInArrow(routed, StructType([*tokens.schema.fields, StructField("cell", IntegerType())]))
    counts = sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("shards"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") * dim / BLOCK_VALUES).cast("int").alias("blocks"))
    plan = F.broadcast(counts.join(sizes.withColumn("cell", F.col("cell").cast("int")), "cell"))  # a row for each cell
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sent.join(plan, "cell").withColumn("shard", F.pmod(F.xxhash64("pid", "pos"), F.col("shards")).cast("int")).withColumn("block", each("blocks")).drop("shards", "blocks")
    right = placed.withColumn("cell", F.col("cell").cast("int")).join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("shard", each("shards")).select("cell", "shard", "block", "cid", "c")
    keys = ["cell", "shard", "block"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.select(names)
        if not x.num_rows or not y.num_rows:
            empty = x.slice(0, 0)
            return empty.append_column("score", pa.array([], pa.float64())).append_column("code", pa.array([], pa.int64()))
        y = y.sort_by("cid")
        score, best = best_of(matrix(x["v"], x.num_rows), matrix(y["c"], y.num_rows))
        return x.append_column("score", pa.array(score)).append_column("code", pa.array(y["cid"].to_numpy()[best], pa.int64()))

    ddl = StructType([*tokens.schema.fields, StructField("score", DoubleType()), StructField("code", LongType())])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ddl)
    best = F.max_by(F.struct(*names, "code"), F.struct("score", -F.col("code")))
    return found.groupBy("pid", "pos").agg(best.alias("b")).select("b.*")


def start(tokens: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(cid, c): k tokens by hash, at length 1; their numbers alone are put in order in one place, which grows like k."""
    chosen = tokens.select("pid", "pos", F.xxhash64("pid", "pos", F.lit(seed)).alias("h")).orderBy("h", "pid", "pos").limit(k)
    numbered = chosen.withColumn("cid", (F.row_number().over(Window.orderBy("h", "pid", "pos")) - 1).cast("long"))
    return tokens.join(numbered, ["pid", "pos"]).select("cid", normalized(F.col("v").cast("array<double>")).alias("c"))


def step(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, c, n): one of Lloyd's steps: the mean, at length 1, of the n tokens that have the centroid; without any it stays.

    Each task adds vectors up per centroid, a block of sums at a time, before they are shuffled.
    """
    dim = width_of(centroids)
    coded = assign(tokens.select("pid", "pos", F.col("v").cast("array<double>").alias("v")), centroids).select("code", "v")
    most = max(1, BLOCK_VALUES // max(1, dim))

    def sums(parts):
        held, n = {}, {}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), lists(np.array(list(held.values())))], names=["cid", "n", "s"])

        for part in parts:
            if part.num_rows:
                v = matrix(part.column(1), part.num_rows)
                codes, inverse, counts = np.unique(part.column(0).to_numpy(), return_inverse=True, return_counts=True)
                total = np.zeros((len(codes), v.shape[1]))
                np.add.at(total, inverse, v)
                for c, t, m in zip(codes.tolist(), total, counts.tolist()):
                    held[c] = held[c] + t if c in held else t
                    n[c] = n.get(c, 0) + m
                if len(held) >= most:
                    yield batch()
                    held, n = {}, {}
        if held:
            yield batch()

    pieces = coded.mapInArrow(sums, "cid long, n long, s array<double>")
    added = pieces.groupBy("cid").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"))
    mean = F.when(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) > 0, normalized("s"))
    return centroids.select("cid", "c").join(added, "cid", "left").select("cid", F.coalesce(mean, F.col("c")).alias("c"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def largest_of(q: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, centroid, inner product) of each query's n largest at 12 digits, ties to the first; TILE products at once."""
    tall, out = max(1, TILE // max(1, len(c))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(q), tall):
        s = q[i : i + tall] @ c.T
        order = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :n]
        row = np.repeat(np.arange(len(s)), order.shape[1])
        out.append((row + i, order.ravel(), s[row, order.ravel()]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(queries: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """(query_id, qpos, cid, s, rn): for each of the query tokens(query_id, qpos, q) its n centroids of largest inner product, ties to the smaller number.

    Blocks of query tokens meet blocks of centroids; only the n best of each pair of blocks are ranked.
    """
    k, dim = centroids.count(), max(1, width_of(centroids))
    blocks, shards = max(1, -(-k * dim // BLOCK_VALUES)), max(1, -(-queries.count() // 1024))
    each = lambda name, size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name)
    left = queries.select(F.pmod(F.xxhash64("query_id", "qpos"), F.lit(shards)).alias("shard"), each("block", blocks), "query_id", "qpos", "q")
    right = centroids.select(each("shard", shards), F.pmod(F.xxhash64("cid"), F.lit(blocks)).alias("block"), "cid", "c")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["query_id", "qpos", "cid", "s"]
        if not x.num_rows or not y.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        y = y.sort_by("cid")
        q, c = matrix(x["q"], x.num_rows), matrix(y["c"], y.num_rows)
        row, at, score = largest_of(q, c, n)
        return pa.table([pa.array(x["query_id"].to_numpy()[row]), pa.array(x["qpos"].to_numpy()[row].astype(np.int64)), pa.array(y["cid"].to_numpy()[at]), pa.array(score)], names=names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, "query_id long, qpos long, cid long, s double")
    rank = F.row_number().over(Window.partitionBy("query_id", "qpos").orderBy(F.desc(F.round("s", 12)), "cid"))
    return found.withColumn("rn", rank).where(F.col("rn") <= n)
