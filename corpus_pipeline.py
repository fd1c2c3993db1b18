"""A corpus from raw documents to packed sequences, as stages that each work on what the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, table
from lodestone.llm.decontamination import drop_contaminated
from lodestone.llm.packing import pack, piece_digests
from lodestone.llm.pii import redact
from lodestone.llm.simhash import drop_near_duplicates
from lodestone.llm.toxicity import drop_toxic, fit_toxicity

#: Bytes of the batches in which rows go to Python. A batch stands in the JVM and in the worker, for every task of an executor.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(stage):
    """The stage in batches of BATCH_BYTES, if the session sets nothing else; the setting stays, as what a stage returns runs later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the network learns from the labelled ones among docs, outside its held-out fold.

    Null, empty and wordless texts score as ordinary clean ones and stay; repeated rows stay or go alike; without labels
    all stay. As in all stages but the last, ids may be null and the columns of docs come out as they are, and an
    empty table gives an empty one.
    """
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; texts without words are copies of each other."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole or edited copy of a benchmark item go; null and empty texts stay, and all without items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and n_chars, where docs have it, follows the text; null texts stay null."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 4096 tokens."""
    import public_tokenizers

    return piece_digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [(f.__name__, small_batches(f)) for f in (toxicity, near_duplicates, decontamination, pii, packing)]

#: Learned scores, fingerprints, alignments and a tokenizer: none of these is SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
