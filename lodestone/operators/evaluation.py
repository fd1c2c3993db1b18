"""Scores of answers and of retrieval."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions.stem import stem
from lodestone.functions.text import col, tokens


def rouge_n(pairs: DataFrame, n: int, *, id_col: str = "id", stemmed: bool = False) -> DataFrame:
    """(id, rouge) F-measure of shared n-grams, of words or of their stems, for pairs(id, reference, answer): the smaller count of each counts."""

    def grams(c: str) -> DataFrame:
        # the words stand in a column of their own, so that no window makes them again
        words = pairs.select(id_col, tokens(F.coalesce(F.col(c), F.lit(""))).alias("w"))
        words = stems(words, "w") if stemmed else words
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        found = F.col("w") if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))
        return words.select(id_col, F.explode(found).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias(c))

    both = grams("reference").join(grams("answer"), [id_col, "gram"], "full_outer")
    sums = both.groupBy(id_col).agg(F.sum(F.coalesce(F.least("reference", "answer"), F.lit(0)) * (F.col("reference").isNotNull() & F.col("answer").isNotNull()).cast("int")).alias("m"), F.coalesce(F.sum("reference"), F.lit(0)).alias("r"), F.coalesce(F.sum("answer"), F.lit(0)).alias("a"))
    scored = sums.select(id_col, F.when((F.col("m") > 0), 2.0 * F.col("m") / (F.col("r") + F.col("a"))).otherwise(0.0).alias("rouge"))
    return pairs.select(id_col).join(scored, id_col, "left").select(id_col, F.coalesce("rouge", F.lit(0.0)).alias("rouge"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for word in b:
        met = row & places.get(word, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, *, id_col: str = "id", stemmed: bool = False) -> DataFrame:
    """(id, rouge) F-measure of the longest common subsequence of words, or of their stems."""
    words = pairs.select(id_col, tokens(F.coalesce("reference", F.lit(""))).alias("r"), tokens(F.coalesce("answer", F.lit(""))).alias("a"))
    words = stems(words, "r", "a") if stemmed else words
    at, names = words.columns.index, [id_col, "rouge"]

    def run(parts):
        for part in parts:
            pairs = zip(part.column(at("r")).to_pylist(), part.column(at("a")).to_pylist())
            scores = [2.0 * longest_common(r, a) / (len(r) + len(a)) if r or a else 0.0 for r, a in pairs]
            yield pa.RecordBatch.from_arrays([part.column(at(id_col)), pa.array(scores, pa.float64())], names=names)

    return words.mapInArrow(run, StructType([pairs.schema[id_col], StructField("rouge", DoubleType())]))


def stems(df: DataFrame, *columns: str) -> DataFrame:
    """df with each word of more than three letters in these arrays of texts as its stem; words not in a to z stay."""
    names = list(df.columns)

    def short(words: list[str] | None) -> list[str] | None:
        return None if words is None else [stem(w) if len(w) > 3 and w.isascii() and w.isalpha() else w for w in words]

    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([short(w) for w in c.to_pylist()], pa.list_(pa.string())) if n in columns else c for n, c in zip(names, part.columns)], names=names)

    return df.mapInArrow(run, df.schema)


def short_answer(answer: Column | str, accepted: Column | str) -> Column:
    """1 if any accepted answer is in the answer, whatever its case, else 0; null if none is given."""
    return F.when(F.size(col(accepted)) > 0, F.exists(col(accepted), lambda s: F.contains(F.lower(col(answer)), F.lower(s))).cast("double"))


def precision_recall(rows: DataFrame, wanted: str, found: str) -> DataFrame:
    """rows with precision, recall and f1 of two arrays as sets; null unless both have something, 0 where nothing matches."""
    hit = F.size(F.array_intersect(wanted, found))
    p, r = hit / F.size(F.array_distinct(found)), hit / F.size(F.array_distinct(wanted))
    there = (F.size(wanted) > 0) & (F.size(found) > 0)
    return rows.select("*", F.when(there, p).alias("precision"), F.when(there, r).alias("recall"), F.when(there, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))


def means(rows: DataFrame) -> DataFrame:
    """Mean of each numeric column."""
    numeric = [n for n, k in rows.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint") or k.startswith("decimal")]
    return rows.agg(*[F.avg(n).alias(n) for n in numeric])


def language_counts(rows: DataFrame, allowed: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    """Rows per language; another language is an error."""
    checked = F.when(F.col("lang").isin(*allowed), F.col("lang")).otherwise(F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce("lang", F.lit("null")))))
    return rows.select(checked.alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


def dcg(ranked: DataFrame, gain: str, *, by: str = "query_id", k: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= k).groupBy(by).agg(F.sum(F.col(gain) / F.log2(F.col("rank") + 1)).alias("dcg"))


def ndcg(ranked: DataFrame, gain: str, *, by: str = "query_id", k: int = 5) -> DataFrame:
    """(by, ndcg): gain over log2(rank + 1) of the first k, against the same gains sorted; 0 if these are all 0."""
    first = ranked.where(F.col("rank") <= k)
    ideal = first.withColumn("best", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(gain), "rank")))
    sums = ideal.groupBy(by).agg(F.sum(F.col(gain) / F.log2(F.col("rank") + 1)).alias("d"), F.sum(F.col(gain) / F.log2(F.col("best") + 1)).alias("i"))
    return sums.select(by, F.when(F.col("i") != 0, F.col("d") / F.col("i")).otherwise(0.0).alias("ndcg"))


def collection_means(scores: DataFrame) -> DataFrame:
    """Mean score and latency per collection; a failed query scores 0 and has no latency."""
    return scores.groupBy("collection").agg(F.avg(F.coalesce("ndcg", F.lit(0.0))).alias("ndcg"), F.avg("latency").alias("latency"), F.count("*").alias("queries"))


def best_resolution(rows: DataFrame) -> DataFrame:
    """Per page the resolution whose text is nearest to the truth, the smallest of equals (then the smallest words), and its ratio to the words' height."""
    best = rows.groupBy("page").agg(F.max_by(F.struct("resolution", "similarity", "word_height"), F.struct("similarity", -F.col("resolution"), -F.col("word_height"))).alias("b"))
    return best.select("page", "b.resolution", "b.similarity", (F.col("b.resolution") / F.col("b.word_height")).alias("ratio"))


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest > 0, 1 - F.levenshtein(col(a), col(b)) / longest).otherwise(1.0)


def matching_ratio(df: DataFrame, a: str, b: str, name: str = "ratio") -> DataFrame:
    """df with twice the characters in matching blocks over all characters of two texts: 1 for equal ones, two empty ones too.

    Blocks are the longest common stretch, the first of equals, and then those to its left and to its right. In a second
    text of 200 characters or more, those that make up over a hundredth of it start no block. Null if a text is null.
    """
    names, x, y = list(df.columns), df.columns.index(a), df.columns.index(b)

    def run(parts):
        for part in parts:
            pairs = zip(part.column(x).to_pylist(), part.column(y).to_pylist())
            ratios = [None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in pairs]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ratios, pa.float64())], names=[*names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
