"""Builds of a table in chunks, that go on where they stopped.

A chunk is a partition of the table, and a manifest says which are done and of what content: a hash of the rows that
they were made of. A run makes only those that aren't there or whose content is another; each job overwrites the
partitions of its own chunks, so that what an interrupted job left is replaced, and its chunks are entered afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import names

#: Jobs of a run at most, unless chunks are fewer than `group` times as many; each reads the input once.
MOST_JOBS = 16
MANIFEST = "chunk long, content string, rows long"


class ChunkedBuild:
    """The table under a folder, in partitions `chunk=n`; one run at a time."""

    def __init__(self, spark: SparkSession, root: str, group: int = 8):
        self.spark, self.root, self.group = spark, root, group

    def manifest(self) -> DataFrame:
        """(chunk, content, rows) of the chunks that are done; the last entry of a chunk counts."""
        steps = [n for n in names(self.spark, f"{self.root}/manifest") if n.startswith("step=") and "_SUCCESS" in names(self.spark, f"{self.root}/manifest/{n}")]
        if not steps:
            return self.spark.createDataFrame([], MANIFEST)
        read = self.spark.read.schema(f"{MANIFEST}, step long").option("basePath", f"{self.root}/manifest").parquet(*[f"{self.root}/manifest/{n}" for n in steps])
        last = read.groupBy("chunk").agg(F.max(F.struct("step", "content", "rows")).alias("e"))
        return last.select("chunk", "e.content", "e.rows")

    def wanted(self, rows: DataFrame) -> DataFrame:
        """(chunk, content, rows) of the input: sums of hashes, so that the order of rows doesn't matter."""
        own = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
        other = F.xxhash64(F.lit(1), *sorted(rows.columns)).cast("decimal(38,0)")
        return rows.groupBy("chunk").agg(F.concat_ws(":", F.sum(own), F.sum(other)).alias("content"), F.count("*").alias("rows"))

    def run(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame], before: Callable[[list[int]], None] | None = None) -> list[int]:
        """Make what is missing of make(rows), where rows have a column `chunk` and make keeps it; the chunks that were made.

        `group` chunks are a job, or more where that makes over MOST_JOBS jobs. before: called with the chunks of a job before it starts.
        """
        wanted, done = self.wanted(rows).alias("w"), self.manifest().alias("d")
        same = F.expr("w.chunk = d.chunk and w.content = d.content and w.rows = d.rows")
        todo = sorted((r["chunk"], r["content"], r["rows"]) for r in wanted.join(done, same, "left_anti").collect())  # a row for each chunk
        group = max(self.group, -(-len(todo) // MOST_JOBS))
        for i in range(0, len(todo), group):
            part = todo[i : i + group]
            chunks = [c for c, _, _ in part]
            if before:
                before(chunks)
            out = make(rows.where(F.col("chunk").isin(chunks)))
            # a chunk is one file, however many tasks made it
            out.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{self.root}/data")
            steps = [int(n[5:]) for n in names(self.spark, f"{self.root}/manifest") if n.startswith("step=")]
            self.spark.createDataFrame(part, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifest/step={max(steps, default=-1) + 1}")
        return [c for c, _, _ in todo]

    def table(self) -> DataFrame:
        """The chunks that are done; nothing else is seen."""
        data = self.spark.read.parquet(f"{self.root}/data").withColumn("chunk", F.col("chunk").cast("long"))
        return data.join(F.broadcast(self.manifest().select("chunk")), "chunk", "left_semi")  # a row for each chunk
