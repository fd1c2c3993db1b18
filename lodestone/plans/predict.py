"""From a conversation's question to a generator's input: rewriting, expansion, retrieval and merging as stages over frames.

Each generator is a function of a frame and gives a frame; a batch of questions goes through each stage at once. A stage
whose generator is missing, or gives null or blank text for a question, leaves the question as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.context import bounded_hits, context_text
from lodestone.operators.dense import knn
from lodestone.operators.fusion import last_wins
from lodestone.operators.lexical import LexicalIndex, search
from lodestone.plans.config import Retrieval, uses_embeddings, uses_text
from lodestone.plans.retrieval import expanded, variants

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Generators:
    """summarise: (query_id, text, prompt, history array of (role, text)) to (query_id, text). hyde: (query_id, text) to
    (query_id, passage). rephrase: (query_id, text) to (query_id, n, text), n from 0. embed: (query_id, text) to
    (query_id, vec). answer: (query_id, text, context) to any frame."""

    summarise: Stage | None = None
    hyde: Stage | None = None
    rephrase: Stage | None = None
    embed: Stage | None = None
    answer: Stage | None = None


@dataclass(frozen=True)
class Predicted:
    """questions: as they were searched; dense and text: merged hits of each channel, None where the mode has no such; context."""

    questions: DataFrame
    dense: DataFrame | None
    text: DataFrame | None
    context: DataFrame | None


def standalone(questions: DataFrame, turns: DataFrame | None, summarise: Stage | None, prompt: str | None) -> DataFrame:
    """questions(query_id, session_id, text) in which those with a history are rewritten so that they can stand alone.

    turns(session_id, turn, role, text) are what was said before. Without a prompt nothing is rewritten.
    """
    if summarise is None or not prompt or turns is None:
        return questions
    said = turns.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("history"))
    later = questions.join(said, "session_id").select("query_id", "text", F.lit(prompt).alias("prompt"), "history")
    again = summarise(later).select("query_id", F.col("text").alias("rewritten"))
    return questions.join(again, "query_id", "left").withColumn("text", expanded("text", "rewritten")).drop("rewritten")


def asked(questions: DataFrame, generators: Generators) -> DataFrame:
    """(query_id, list_no, text): list 0 is the question or the passage that stands for it, then its rephrasings."""
    first = questions.select("query_id", "text")
    if generators.hyde:
        passages = generators.hyde(first).select("query_id", "passage")
        first = first.join(passages, "query_id", "left").select("query_id", expanded("text", "passage").alias("text"))
    if not generators.rephrase:
        return first.select("query_id", F.lit(0).alias("list_no"), "text")
    again = generators.rephrase(questions.select("query_id", "text")).where(F.trim("text") != "")
    return variants(first, again)


def merged_hits(hits: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(query_id, position, list_no, ...) of hits(query_id, rank, key, ...) whose query_id names a row of lists by `ask`."""
    own = hits.withColumnRenamed("query_id", "ask").join(lists.select("ask", "query_id", "list_no"), "ask").drop("ask")
    merged = last_wins(own.withColumnRenamed("rank", "pos").withColumnRenamed(key, "id"))
    return merged.drop("pos").withColumnRenamed("id", key)


def predict(how: Retrieval, questions: DataFrame, index: LexicalIndex | None, vectors: DataFrame | None, generators: Generators = Generators(), *, turns: DataFrame | None = None, prompt: str | None = None) -> Predicted | DataFrame:
    """Questions(query_id, text[, session_id, labels]) through all stages; what `answer` makes of them, where there is one.

    All forms of all questions are searched as one batch in each channel of the mode. Labels hold for the first form
    only, as rephrasings are searched without them. The embedding channel needs `embed`.
    """
    plain = standalone(questions, turns, generators.summarise, prompt) if "session_id" in questions.columns else questions
    lists = asked(plain, generators).withColumn("ask", F.concat_ws("/", F.col("query_id").cast("string"), F.col("list_no").cast("string")))
    form = lists.select(F.col("ask").alias("query_id"), "text")
    if "labels" in questions.columns:
        own = questions.select(F.concat_ws("/", F.col("query_id").cast("string"), F.lit("0")).alias("query_id"), "labels")
        form = form.join(own, "query_id", "left")
    dense = text = context = None
    if uses_embeddings(how.retrieval_mode) and vectors is not None and generators.embed:
        given = generators.embed(form.select("query_id", "text")).select("query_id", "vec")
        given = given.join(form.select("query_id", "labels"), "query_id") if "labels" in form.columns else given
        found = knn(vectors, given, how.top_k, depth=how.query_depth_mult, label_col="crop_label" if "crop_label" in vectors.columns else None)
        dense = merged_hits(found, lists, "id")
    if uses_text(how.retrieval_mode) and index is not None:
        found = search(index, form, limit=how.text_search_engine_top_k, fields=tuple(how.text_search_engine_fields))
        text = merged_hits(found, lists, "doc_id")
        shown = text.join(index.documents, "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
        context = context_text(bounded_hits(shown, how.text_search_engine_max_chars_per_doc, how.text_search_engine_max_total_chars))
    if generators.answer is None:
        return Predicted(lists.select("query_id", "list_no", "text"), dense, text, context)
    base = plain.select("query_id", "text")
    return generators.answer(base.join(context, "query_id", "left") if context is not None else base.withColumn("context", F.lit(None).cast("string")))
