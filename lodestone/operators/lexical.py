"""Lexical retrieval: an inverted index in tables, and BM25 over many questions at once.

Tables: documents(doc_id, source, page_number, crop_label, label, content), postings(term, field, doc_id, tf, length,
crop_label), terms(term, field, df), of which a term may have several rows that add up, and fields(field, n, average). A search joins the questions' few terms with the postings, so
that only postings of asked terms move, sums the scores, and ranks with a group limit per question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted, keyword_tokens, strip, token_count, tokens

FIELDS = ("content", "source")
K1, B = 1.2, 0.75
OKAPI_K1, OKAPI_FLOOR = 1.5, 0.25
#: Terms of all questions together that are broadcast.
BROADCAST_TERMS = 1 << 18
#: Pairs of a question and a document that one task adds up, at most.
TASK_PAIRS = 1 << 22
COLUMNS = ("doc_id", "source", "page_number", "crop_label", "label", "content")
TABLES = ("documents", "postings", "terms", "fields")


@dataclass
class LexicalIndex:
    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    #: (segment, doc_id) of postings that don't count any more.
    dead: DataFrame | None = None
    #: Whether the tables are read rather than made, so that terms are there for the reading.
    written: bool = True

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings of terms(term), dead ones left out after the terms are chosen."""
        chosen = self.postings.join(terms, "term", "left_semi")
        return chosen if self.dead is None else chosen.join(self.dead, ["segment", "doc_id"], "left_anti")

    def write(self, path: str, mode: str = "overwrite") -> None:
        for name in TABLES:
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def page_documents(pages: DataFrame) -> DataFrame:
    """One row for each page with text: trimmed content, id `source:page:n`, no crop label; blank pages go, the first of equal pages stays."""
    text = pages.withColumn("content", strip("content")).where(F.col("content") != "")
    first = F.row_number().over(Window.partitionBy("source", "page_number").orderBy("content"))
    one = text.withColumn("rn", first).where("rn = 1")
    return one.select(F.format_string("%s:page:%s", "source", F.col("page_number").cast("string")).alias("doc_id"), "source", "page_number", F.lit(None).cast("string").alias("crop_label"), F.lit("page_text").alias("label"), "content")


def chunk_id(source, page, start, number):
    """Id of a text chunk: source:page:start:number, start being the number where it is unknown."""
    return F.concat_ws(":", source, F.coalesce(page.cast("string"), F.lit("None")), F.coalesce(start, number).cast("string"), number.cast("string"))


def field_texts(fields: tuple[str, ...]) -> Column:
    """(field, text) rows of a document; a null text counts as empty."""
    return F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]))).alias("field", "text")


def word_counts(documents: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, crop_label, field, length, counts array of (term, tf)): a row for each document and field."""
    words = documents.select("doc_id", "crop_label", field_texts(fields)).select("doc_id", "crop_label", "field", tokens("text").alias("words"))
    return words.select("doc_id", "crop_label", "field", F.size("words").alias("length"), counted("words").alias("counts"))


def opened(rows: DataFrame) -> DataFrame:
    """Postings of rows that have counts; all other columns stay."""
    each = rows.select(*[c for c in rows.columns if c != "counts"], F.explode("counts").alias("p"))
    return each.select(F.col("p.term").alias("term"), F.col("p.tf").alias("tf"), *[c for c in rows.columns if c != "counts"])


def build_index(documents: DataFrame, fields: tuple[str, ...] = FIELDS) -> LexicalIndex:
    """The index of rows with the columns of COLUMNS; ids must be distinct.

    A document's terms are counted where the document is, so that postings are made without a shuffle.
    """
    postings = opened(word_counts(documents, fields))
    terms = postings.groupBy("term", "field").agg(F.count("*").alias("df"))
    per_field = documents.select(field_texts(fields)).groupBy("field").agg(F.count("*").alias("n"), F.avg(token_count("text")).alias("average"))
    return LexicalIndex(documents, postings, terms, per_field, written=False)


def parts(documents: int, questions: int, least: int) -> int:
    """Into how many parts documents go, so that none has more than TASK_PAIRS pairs with questions."""
    return max(least, -(-documents * questions // TASK_PAIRS))


def search(index: LexicalIndex, questions: DataFrame, *, limit: int, fields: tuple[str, ...] = FIELDS, okapi: bool = False) -> DataFrame:
    """Hits (query_id, rank, doc_id, score) for questions(query_id, text, labels array<string> or null).

    A question's keywords are joined by OR and the scores of its fields summed. Without a keyword every document scores
    1. labels: documents without one of these crop labels don't count; an empty list is no filter. Ties go to the
    smaller id. okapi: the other idf, floored at a share of its mean.
    """
    wanted = questions if "labels" in questions.columns else questions.withColumn("labels", F.lit(None).cast("array<string>"))
    asked = wanted.select("query_id", "labels", F.transform(keyword_tokens(strip("text")), lambda t: F.lower(t)).alias("words"))
    asked_terms = asked.select("query_id", "labels", F.explode(F.array_distinct("words")).alias("term"))
    fits = F.col("labels").isNull() | (F.size("labels") == 0) | F.coalesce(F.array_contains("labels", F.col("crop_label")), F.lit(False)) if "labels" in questions.columns else F.lit(True)
    # a batch of questions is small beside the postings, up to a size that is checked, and goes to them
    size = asked_terms.agg(F.count("*").alias("terms"), F.count_distinct("query_id").alias("questions")).first()
    sent = F.broadcast if size["terms"] <= BROADCAST_TERMS else lambda df: df
    few = sent(asked_terms.select("term").distinct())
    # by document, so that scores add up where the postings are and only the best of each question move again; into so
    # many parts that the pairs of one fit a task, however many documents and questions there are
    found = index.postings_of(few).where(F.col("field").isin(*fields)).repartition(parts(index.documents.count(), size["questions"], index.documents.sparkSession.sparkContext.defaultParallelism), "doc_id")
    if index.written or okapi:
        terms = index.terms.where(F.col("field").isin(*fields))
        terms = (terms if okapi else terms.join(few, "term", "left_semi")).groupBy("term", "field").agg(F.sum("df").alias("df")).where("df > 0")
    else:
        # all columns are asked for, so that the counting and the scoring read one exchange
        there = (F.col("tf") > 0) & (F.col("length") > 0) & (F.coalesce("crop_label", F.lit("")) != "\0")
        terms = found.groupBy("term", "field").agg(F.count(F.when(there, 1)).alias("df"))
    stats = terms.join(F.broadcast(index.fields), "field")
    if okapi:
        raw = stats.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.groupBy("field").agg(F.avg("idf").alias("mean"))
        stats, k1 = raw.join(F.broadcast(mean), "field").withColumn("idf", F.when(F.col("idf") < 0, OKAPI_FLOOR * F.col("mean")).otherwise(F.col("idf"))), OKAPI_K1
    else:
        stats, k1 = stats.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), K1
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = found.join(sent(asked_terms.join(stats, "term")), ["term", "field"]).where(fits).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    # without a keyword all documents tie: the first ones of each label are all that a ranking of `limit` can show
    first = F.row_number().over(Window.partitionBy("crop_label").orderBy("doc_id"))
    leading = index.documents.select("doc_id", first.alias("n"), "crop_label").where(F.col("n") <= limit).select("doc_id", "crop_label")
    everything = asked.where(F.size("words") == 0).crossJoin(leading).where(fits).select("query_id", "doc_id", F.lit(1.0).alias("score"))
    hits = scored.unionByName(everything)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


def fetched(index: LexicalIndex, hits: DataFrame) -> DataFrame:
    """Hits with their documents' columns and the name of the retriever."""
    return hits.join(index.documents, "doc_id").select("query_id", "rank", *COLUMNS, "score", F.lit("text_search_engine").alias("retriever"))
