"""A key-value store of blobs as a Parquet table: (key, hashed_key, bytes, version); the last version of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import uuid5

DDL = "key string, hashed_key string, bytes binary, version long"


def latest(rows: DataFrame) -> DataFrame:
    """Of rows that repeat a key, that of the highest version; a deleted key's last bytes are null."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))
    return rows.withColumn("_n", rank).where((F.col("_n") == 1) & F.col("bytes").isNotNull()).drop("_n")


class KeyValueStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        return self.spark.read.schema(DDL).parquet(self.path)

    def rows(self) -> DataFrame:
        return latest(self._log())

    def put(self, rows: DataFrame, version: int) -> None:
        """Append (key, bytes) as a version; within one call a key must not repeat."""
        rows.select("key", uuid5("key").alias("hashed_key"), "bytes", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of keys(key); a key that isn't there is an error."""
        found = keys.join(self.rows(), "key", "left")
        missing = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.col("key")))).otherwise(F.col("bytes"))
        return found.select("key", missing.alias("bytes"))

    def has(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.rows(), "key", "left_semi")

    def keys(self) -> DataFrame:
        return self.rows().select("key")

    def info(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("keys"), F.sum(F.length("bytes")).alias("bytes"))

    def compact(self, target: str) -> None:
        self.rows().write.mode("overwrite").parquet(target)


def migrated_keys(rows: DataFrame, pattern: str, kind: str = "crop", cut: bool = False) -> DataFrame:
    """rows(key) with new_key made of a pattern's groups (document, page, number); a key that doesn't match stays.

    Numbers get four digits at least. cut: and at most, the first four, as lpad has them in SQL; keys can then collide.
    """
    part = lambda i: F.regexp_extract("key", pattern, i)
    digits = lambda i: F.lpad(part(i), 4, "0") if cut else F.format_string("%04d", part(i).cast("int"))
    new = F.concat(uuid5(part(1)), F.lit("_"), digits(2), F.when(part(3) != "", F.concat(F.lit(f"_{kind}_"), digits(3))).otherwise(""))
    return rows.withColumn("new_key", F.when(F.col("key").rlike(pattern), new).otherwise(F.col("key")))


def orphans(keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys without a vector."""
    return keys.join(vectors.select(F.col("id").alias("key")), "key", "left_anti")
