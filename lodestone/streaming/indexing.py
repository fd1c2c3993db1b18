"""Incremental indexing: new files or rows go through a stream into the index tables, each source once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def not_indexed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose source isn't known yet; by the source's name, not by its content."""
    return rows.join(known.select("source").distinct(), "source", "left_anti")


class IncrementalIndex:
    """A Parquet table of documents that grows by batches.

    A batch that is tried again after a failure finds its own sources in the table and adds nothing twice; the stream's
    checkpoint keeps what has been read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def add(self, rows: DataFrame) -> None:
        fresh = not_indexed(rows, self.table()) if self.exists() else rows
        fresh.select(*self.schema.names).write.mode("append").parquet(self.path)

    def start(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
        """Run over what is there now and stop; start again for what comes later."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.add(prepare(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incoming(spark: SparkSession, folder: str, schema: StructType, *, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def event_rates(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values per window and type, for a stream or a table of events(ts, event_type, value)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
