"""Dense retrieval: exact nearest neighbours of many queries in one scan, and what is done with result lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import norm

#: Query vectors of so many numbers in all go to the workers in one broadcast; more of them meet shards of the vectors block by block.
BROADCAST_VALUES = 1 << 22
#: Numbers of a shard or a block at most, on average, whatever the length of the vectors.
BLOCK_VALUES = 1 << 24
#: Vectors of a shard and queries of a block, on average, where both meet in one task.
SHARD, BLOCK = 32_768, 4096
#: Distances that a worker holds at once, and rows that it gives back at once.
TILE, BATCH = 1 << 20, 1 << 16
#: Vectors of a block, on average, where all pairs are formed; bins of a histogram of their distances.
PAIR_BLOCK, PAIR_BINS = 8192, 1 << 18


def _matrix(rows: list) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows], np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _nearest(q: np.ndarray, labels: list[set] | None, v: np.ndarray, own: list | None, k: int, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its k nearest rows, and all that tie with the last of them, so that ids can decide later: numbers of queries and rows, distances.

    Queries and rows meet in tiles of TILE distances. limits: a distance per query that k rows seen before don't exceed;
    farther rows stay out, and it is lowered to what is found.
    """
    if labels is not None:
        names, code = np.unique(np.array(["" if x is None else "+" + x for x in own]), return_inverse=True)
        open_ = np.array([[not allowed or (x != "" and x[1:] in allowed) for x in names] for allowed in labels]).reshape(len(labels), len(names))
    limits = np.full(len(q), np.inf) if limits is None else limits
    wide = max(1, min(len(v), max(2048, 64 * k)))
    tall = max(1, TILE // wide)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in range(0, len(q), tall):
        limit = limits[i : i + tall]
        a, b, d = out[0]
        for j in range(0, len(v), wide):
            tile = q[i : i + tall] @ v[j : j + wide].T
            free = np.flatnonzero(np.isinf(limit))
            if len(free) and tile.shape[1] >= k:
                own_d = np.maximum(1 - tile[free], 0)
                if labels is not None:
                    own_d[~open_[i + free][:, code[j : j + wide]]] = np.inf
                limit[free] = np.partition(own_d, k - 1, axis=1)[:, k - 1]
            x, y = np.nonzero(tile >= 1 - limit[:, None] - 2e-12)
            if labels is not None:
                seen = open_[i + x, code[j + y]]
                x, y = x[seen], y[seen]
            a, b, d = np.append(a, x), np.append(b, y + j), np.append(d, np.maximum(1 - tile[x, y], 0))
            order = np.lexsort((d, a))
            a, b, d = a[order], b[order], d[order]
            start = np.searchsorted(a, np.arange(len(limit) + 1))
            full = np.flatnonzero(np.diff(start) >= k)
            limit[full] = np.minimum(limit[full], d[start[full] + k - 1])
            keep = (d <= limit[a] + 1e-12) & np.isfinite(d)
            a, b, d = a[keep], b[keep], d[keep]
        out.append((a + i, b, d))
    return tuple(np.concatenate(c) for c in zip(*out))


def _values(column) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in parts])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, depth: int = 1, label_col: str | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest by cosine distance, ties to the smaller id.

    vectors(id, embedding[, label_col]), queries(query_id, vec[, labels]). The search is exact, so that fetching
    depth * k candidates and keeping k is the same as fetching k; the parameter stays for its callers. labels: only
    vectors whose label is in the list are ranked; null or empty lists don't filter. Null vectors take no part. Each
    batch or shard of vectors keeps its best k per query before anything else is shuffled.
    """
    spark = vectors.sparkSession
    use_labels = label_col is not None and "labels" in queries.columns
    asked = queries.where(F.col("vec").isNotNull()).select("query_id", "vec", F.col("labels") if use_labels else F.lit(None).cast("array<string>").alias("labels"))
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", F.col(label_col).alias("label") if use_labels else F.lit(None).cast("string").alias("label"))
    ddl = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, distance double"
    names = ["query_id", "id", "distance"]
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("dim")).first()
    m, dim = size["n"], max(1, size["dim"])
    if not m:
        found = spark.createDataFrame([], ddl)
    elif m * dim <= BROADCAST_VALUES:
        some = asked.collect()  # of a size that has just been checked
        shared = spark.sparkContext.broadcast((pa.array([r["query_id"] for r in some]), _unit(_matrix([r["vec"] for r in some])), [set(r["labels"] or ()) for r in some] if use_labels else None))

        def scan(parts):
            ids, q, labels = shared.value
            limits = np.full(len(q), np.inf)
            for part in parts:
                if part.num_rows:
                    a, b, d = _nearest(q, labels, _unit(_values(part.column(1))), part.column(2).to_pylist() if labels is not None else None, k, limits)
                    for i in range(0, len(a), BATCH):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[i : i + BATCH])), part.column(0).take(pa.array(b[i : i + BATCH])), pa.array(d[i : i + BATCH])], names=names)

        found = rows.mapInArrow(scan, ddl)
    else:
        n = rows.count()
        shards, blocks = (max(1, -(-count // max(1, min(most, BLOCK_VALUES // dim)))) for count, most in ((n, SHARD), (m, BLOCK)))
        each = lambda c, size: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(c)
        key = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
        left = rows.select(key("id", shards).alias("shard"), each("block", blocks), "*")
        right = asked.select(each("shard", shards), key("query_id", blocks).alias("block"), "*")

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return pa.table([x["id"].slice(0, 0) if n == "id" else y["query_id"].slice(0, 0) if n == "query_id" else pa.array([], pa.float64()) for n in names], names=names)
            labels = [set(r or ()) for r in y["labels"].to_pylist()] if use_labels else None
            a, b, d = _nearest(_unit(_values(y["vec"])), labels, _unit(_values(x["embedding"])), x["label"].to_pylist() if use_labels else None, k)
            return pa.table([y["query_id"].take(pa.array(a)), x["id"].take(pa.array(b)), pa.array(d)], names=names)

        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, ddl)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def take_top_k(results: DataFrame, k: int) -> DataFrame:
    """The first k of each list(query_id, rank, ...), numbered anew with the best last."""
    kept = results.where(F.col("rank") <= k)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))))


def sort_top_k(results: DataFrame, k: int, *, remove_duplicates: bool = False, content_col: str = "content") -> DataFrame:
    """The k nearest of each list(query_id, pos, distance, content), best first, ties in list order.

    remove_duplicates: of neighbours in the list with the same content the earlier one goes. A null or infinite distance
    is an error.
    """
    rows = results.withColumn("distance", F.when(F.col("distance").isNull() | F.isnan("distance"), F.raise_error(F.lit("a distance is not a number"))).otherwise(F.col("distance")))
    if remove_duplicates:
        after = F.lead(F.md5(F.col(content_col).cast("binary"))).over(Window.partitionBy("query_id").orderBy("pos"))
        rows = rows.withColumn("_next", after).where(F.col("_next").isNull() | (F.md5(F.col(content_col).cast("binary")) != F.col("_next"))).drop("_next")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def pair_statistics(vectors: DataFrame) -> DataFrame:
    """Number, mean, median, deviation, least and largest of the cosine distances of all pairs of vectors with different ids.

    Blocks of vectors meet in pairs, one pair in a task, which keeps sums, extremes and a histogram. The median comes from
    a second histogram of the bins that hold it, and is off by 2e-11 at most. Null vectors take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    blocks = max(1, -(-rows.count() // PAIR_BLOCK))
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "embedding")

    def passed(bins: list[int] | None) -> DataFrame:
        """Rows (bin, n) of the histogram; without bins of the whole range, and then a row of bin -1 with the other figures."""

        def meet(part: pa.Table) -> pa.Table:
            block, ids, v = part["block"].to_numpy(), part["id"].to_pylist(), _unit(_values(part["embedding"]))
            here, there = np.flatnonzero(block == part["x"][0].as_py()), np.flatnonzero(block == part["y"][0].as_py())
            same, number = part["x"][0].as_py() == part["y"][0].as_py(), np.unique(np.array(ids), return_inverse=True)[1]
            counts = {b: np.zeros(PAIR_BINS, np.int64) for b in bins or [0]}
            n, total, square, least, most = 0, 0.0, 0.0, np.inf, -np.inf
            for at in range(0, len(here), 256):
                some = here[at : at + 256]
                d = 1 - v[some] @ v[there].T
                d = d[number[some][:, None] < number[there][None, :]] if same else d.ravel()
                if not len(d):
                    continue
                place = np.clip(d * (PAIR_BINS / 2), 0, PAIR_BINS - 1e-6)
                if bins is None:
                    counts[0] += np.bincount(place.astype(np.int64), minlength=PAIR_BINS)
                    n, total, square = n + len(d), total + float(d.sum()), square + float(((d - 1) ** 2).sum())
                    least, most = min(least, float(d.min())), max(most, float(d.max()))
                else:
                    for b in bins:
                        inner = place[(place >= b) & (place < b + 1)] - b
                        counts[b] += np.bincount((inner * PAIR_BINS).astype(np.int64), minlength=PAIR_BINS)
            out = [(b * PAIR_BINS + k, int(c[k])) for b, c in counts.items() for k in np.flatnonzero(c).tolist()]
            out = [(*r, None, None, None, None) for r in out] + ([(-1, n, total, square, least, most)] if n else [])
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names=["bin", "n", "total", "square", "least", "most"])

        found = met.groupBy("x", "y").applyInArrow(meet, "bin long, n long, total double, square double, least double, most double")
        return found.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("bin")

    ddl = "pairs long, mean double, median double, std double, least double, most double"
    first = passed(None).toArrow()  # PAIR_BINS rows and one at most
    if not first.num_rows:
        return spark.createDataFrame([(0, None, None, None, None, None)], ddl)
    _, n, total, square, least, most = (first[i][0].as_py() for i in range(6))
    bins, below = first["bin"].to_numpy()[1:], np.cumsum(first["n"].to_numpy()[1:])
    middle = [(n - 1) // 2, n // 2]
    holds = np.searchsorted(below, middle, side="right")
    second = passed(sorted({int(bins[i]) for i in holds})).toArrow()
    fine, count = second["bin"].to_numpy(), second["n"].to_numpy()
    values = []
    for rank, i in zip(middle, holds.tolist()):
        own_bins = fine // PAIR_BINS == bins[i]
        k = fine[own_bins][np.searchsorted(np.cumsum(count[own_bins]), rank - (below[i - 1] if i else 0), side="right")]
        values.append((int(k) + 0.5) * 2 / PAIR_BINS**2)
    mean = total / n
    std = float(np.sqrt(max(square / n - (mean - 1) ** 2, 0.0)))
    return spark.createDataFrame([(n, mean, sum(values) / 2, std, least, most)], ddl)


def norm_statistics(vectors: DataFrame) -> DataFrame:
    """Mean length, and mean and deviation of all components."""
    lengths = vectors.select(norm("embedding").alias("n"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("q"), F.size("embedding").alias("m"))
    mean = F.sum("s") / F.sum("m")
    return lengths.agg(F.avg("n").alias("mean_norm"), mean.alias("mean_value"), F.sqrt(F.sum("q") / F.sum("m") - mean * mean).alias("std_value"))


def neighbours_of(vectors: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The n nearest other vectors of each id in ids(id): (query_id, rank, id, distance)."""
    queries = vectors.join(ids, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"))
    found = knn(vectors, queries, n + 1).where(F.col("id") != F.col("query_id"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= n)
