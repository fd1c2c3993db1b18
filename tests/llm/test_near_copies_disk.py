"""What near-duplicate removal leaves on disk, and which rows it sends."""

import os
import time

from pyspark.sql import functions as F

from lodestone.llm import simhash


def shuffles(spark):
    """The numbers of the shuffles that have files."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {n.split("_")[1] for top in dirs for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def documents(spark):
    words = lambda i: " ".join(f"w{(i * 7919 + k * k * (i + 3)) % 5003}" for k in range(120))
    rows = [(i, words(i), "x") for i in range(60)] + [(100 + i, words(i) + " tail", "y") for i in range(20)] + [(None, words(3), "z"), (300, None, "z"), (301, " ", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, own_word string").repartition(4)


def test_shuffle_files_go_with_their_action(spark):
    before, setting = shuffles(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = simhash.drop_near_duplicates(documents(spark))
    for _ in range(50):
        if len(left := shuffles(spark) - before) <= 4:
            break
        time.sleep(0.2)
    assert len(left) <= 4  # fourteen before; a few may stay until the driver collects garbage
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert kept.columns == ["doc_id", "text", "own_word"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 300]


def test_only_rows_that_may_go_are_sent(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    gone = spark.createDataFrame([(i, None) for i in range(0, 5000, 500)] + [(None, None)], "doc_id long, x string").select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))
    odd = df.union(spark.createDataFrame([(None, ""), (None, "b"), (500, "other")], "doc_id long, text string"))
    kept = simhash.without(odd, gone, F.col("doc_id"), F.xxhash64("text"))
    left = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert left == {(i, str(i)) for i in range(5000) if i % 500} | {(None, "b"), (500, "other")}
