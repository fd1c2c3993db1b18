"""Merging of result lists. A list is rows; its order is a column, and ties always have a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def side_by_side(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both lists, told apart by a channel column; nothing is fused."""
    return dense.withColumn("channel", F.lit("embedding")).unionByName(lexical.withColumn("channel", F.lit("text")), allowMissingColumns=True)


def concat_dedup(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """The lists(query_id, rank, ...) one after the other; of rows with equal keys the first stays. Null keys are equal."""
    together = reduce(DataFrame.unionByName, [d.withColumn("channel", F.lit(i)) for i, d in enumerate(lists)])
    first = F.row_number().over(Window.partitionBy("query_id", *key).orderBy("channel", "rank"))
    kept = together.withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("channel", "rank")))


def reciprocal_ranks(lists: list[DataFrame], weights: list[float] | None = None, c: int = 60) -> DataFrame:
    """(query_id, rank, id, score): sum of weight / (c + rank) over the lists(query_id, rank, id), ties to the smaller id."""
    weights = weights or [1 / len(lists)] * len(lists)
    together = reduce(DataFrame.unionByName, [d.select("query_id", "id", (F.lit(w) / (c + F.col("rank"))).alias("part")) for d, w in zip(lists, weights)])
    scored = together.groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))).select("query_id", "rank", "id", "score")


def last_wins(results: DataFrame) -> DataFrame:
    """Results(query_id, list_no, pos, id, ...) of rephrased questions merged: a later list takes an id over from the earlier
    ones; an id that repeats within a list stays repeated there."""
    last = F.max("list_no").over(Window.partitionBy("query_id", "id"))
    kept = results.withColumn("_last", last).where(F.col("list_no") == F.col("_last")).drop("_last")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "pos")))


def overlaps(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Sorted arrays of what two arrays share, and of what only one has."""
    return rows.select("*", F.array_sort(F.array_intersect(a, b)).alias("common"), F.array_sort(F.array_except(a, b)).alias("only_first"), F.array_sort(F.array_except(b, a)).alias("only_second"))


def group_by_first(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values) with the values of each key in order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))


def offsets(lengths: DataFrame, order: str, length: str, within: list[str] | None = None) -> DataFrame:
    """Rows with the sum of all earlier lengths."""
    before = Window.partitionBy(*(within or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def write_ranking(results: DataFrame, path: str) -> None:
    """query_id, id, rank, score as tab-separated text."""
    results.select("query_id", "id", "rank", "score").write.mode("overwrite").option("sep", "\t").csv(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("query_id string, id string, rank int, score double").csv(path)
