"""Training sets for embedders, and the forward pass of the contrastive loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, on average, where all queries meet all passages.
QUERY_BLOCK, PASSAGE_BLOCK = 1024, 8192


def grouped_queries(rows: DataFrame) -> DataFrame:
    """(query, docids, answers): the documents and answers of equal questions, in order of document and answer."""
    sides = F.transform(F.array_sort(F.collect_list(F.struct("docid", "answer"))), lambda s: s)
    return rows.groupBy("query").agg(sides.alias("s")).select("query", F.col("s.docid").alias("docids"), F.col("s.answer").alias("answers"))


def sampled_passages(groups: DataFrame, epoch: int, group_size: int, seed: int = 42) -> DataFrame:
    """groups(query_id, positives, negatives) with one positive and group_size - 1 negatives for an epoch.

    The positive and the start among the negatives move on with the epoch; too few negatives repeat.
    """
    n = group_size - 1
    s = F.col("query_id") + seed + epoch
    positive = F.get("positives", F.pmod(s, F.size("positives")).cast("int"))
    count = F.size("negatives")
    places = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    rotated = F.transform(places, lambda i: F.get("negatives", F.pmod(F.lit(epoch * n) + i, count).cast("int")))
    return groups.select("query_id", positive.alias("positive"), (rotated if n > 0 else F.array().cast("array<string>")).alias("negatives"))


def contrastive_loss(queries: DataFrame, passages: DataFrame, group: int, temperature: float = 0.02) -> DataFrame:
    """(loss): mean cross-entropy of queries(i, q) against all passages(j, p) of a batch, passage i * group being the right one.

    Blocks of queries meet blocks of passages; of each pair of blocks a query keeps its largest score, the sum of the
    exponentials below it, and the right passage's score if that is there. Those are put together by query.
    """
    blocks, shards = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-passages.count() // PASSAGE_BLOCK))
    each = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    key = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(key("i", blocks).alias("b"), each("s", shards), F.col("i").cast("long").alias("i"), F.col("q").cast("array<double>").alias("q"))
    right = passages.select(each("b", blocks), key("j", shards).alias("s"), F.col("j").cast("long").alias("j"), F.col("p").cast("array<double>").alias("p"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["i", "top", "below", "right"]
        if not x.num_rows or not y.num_rows:
            return pa.table([pa.array([], pa.int64())] + [pa.array([], pa.float64())] * 3, names=names)
        i, j = x["i"].to_numpy(), y["j"].to_numpy()
        score = np.array(x["q"].to_pylist()) @ np.array(y["p"].to_pylist()).T / temperature
        top = score.max(1)
        own = np.where(j[None] == i[:, None] * group, score, -np.inf).max(1)
        return pa.table([pa.array(i), pa.array(top), pa.array(np.exp(score - top[:, None]).sum(1)), pa.array([None if v == -np.inf else float(v) for v in own], pa.float64())], names=names)

    parts = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(meet, "i long, top double, below double, right double")
    most = parts.groupBy("i").agg(F.max("top").alias("most"), F.max("right").alias("right"), F.collect_list(F.struct("top", "below")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["below"] * F.exp(p["top"] - F.col("most")))
    return most.select((F.log(total) + F.col("most") - F.col("right")).alias("loss")).agg(F.avg("loss").alias("loss"))
