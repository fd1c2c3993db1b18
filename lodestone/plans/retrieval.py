"""Retrieval plans: the two channels, query expansion, sessions, and the service that holds an index."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import col, extension
from lodestone.operators.context import bounded_hits, context_text
from lodestone.operators.dense import knn
from lodestone.operators.lexical import LexicalIndex, fetched, page_documents, search
from lodestone.operators.segments import SegmentedIndex
from lodestone.plans.config import Code, Retrieval, ServiceError, merged, uses_embeddings, uses_text
from lodestone.plans.jobs import JobQueue
from lodestone.sources.files import loaded_text, pages_of
from lodestone.sources.scratch import names, remove


@dataclass
class Answer:
    """Both channels' hits and the budgeted text context; a channel that isn't used is None."""

    embedding: DataFrame | None
    text: DataFrame | None
    context: DataFrame | None


def retrieve(how: Retrieval, questions: DataFrame, vectors: DataFrame | None, index: LexicalIndex | None) -> Answer:
    """Questions(query_id, text[, vec, labels]) through the channels of the mode; a channel without an index gives nothing."""
    dense = text = context = None
    if uses_embeddings(how.retrieval_mode) and vectors is not None:
        dense = knn(vectors, questions, how.top_k, depth=how.query_depth_mult, label_col="crop_label" if "crop_label" in vectors.columns else None)
    if uses_text(how.retrieval_mode) and index is not None:
        text = fetched(index, search(index, questions, limit=how.text_search_engine_top_k, fields=tuple(how.text_search_engine_fields)))
        bounded = bounded_hits(text, how.text_search_engine_max_chars_per_doc, how.text_search_engine_max_total_chars)
        context = context_text(bounded)
    return Answer(dense, text, context)


def expanded(question: Column | str, passage: Column | str) -> Column:
    """The generated passage in place of the question; the question itself where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(col(passage)), F.lit("")), col(question))


def variants(questions: DataFrame, rephrased: DataFrame) -> DataFrame:
    """(query_id, list_no, text): each question as list 0 and its rephrasings(query_id, n, text) from 1 on."""
    return questions.select("query_id", F.lit(0).alias("list_no"), "text").unionByName(rephrased.select("query_id", (F.col("n") + 1).alias("list_no"), "text"))


def last_message(turns: DataFrame, role: str = "user") -> DataFrame:
    """(session_id, text): the last message of a role in each session."""
    return turns.where(F.col("role") == role).groupBy("session_id").agg(F.max_by("text", "turn").alias("text"))


def history(turns: DataFrame) -> DataFrame:
    """turns with position from 1 and the messages before."""
    w = Window.partitionBy("session_id").orderBy("turn")
    return turns.select("session_id", "turn", "role", "text", F.row_number().over(w).alias("position"), (F.count("*").over(Window.partitionBy("session_id")) - F.row_number().over(w)).alias("later"))


def recent_sessions(uses: DataFrame, most: int = 100) -> DataFrame:
    """The sessions(session_id, used) that a cache of `most` keeps: those used last, ties to the smaller id."""
    last = uses.groupBy("session_id").agg(F.max("used").alias("used"))
    return last.orderBy(F.desc("used"), "session_id").limit(most)


def thinks(images: Column, has_text_context: Column, disabled: Column) -> Column:
    """A model thinks only over images, without text beside them, unless that is switched off."""
    return images & ~has_text_context & ~disabled


def listed_sources(hits: DataFrame) -> DataFrame:
    """(query_id, position, line): hits by distance, largest first, as they are shown under an answer."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("distance", 12)), "id")
    return hits.select("query_id", F.row_number().over(w).alias("position"), F.concat(F.col("id").cast("string"), F.lit(" - Distance: "), F.format_number("distance", 4)).alias("line"))


class Services:
    """Named services over index tables, and one worker that indexes in turn."""

    LIBRARIES = ("dense", "text", "late", "image")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._lock, self._state, self._settings = threading.Lock(), {}, {}

    def create(self, name: str, library: str = "dense", settings: Retrieval | None = None) -> None:
        if library not in self.LIBRARIES:
            raise ServiceError(Code.UNKNOWN_LIBRARY, f"unknown library: {library}")
        if name in self._settings:
            raise ServiceError(Code.BAD_REQUEST, f"there is a service {name}")
        self._settings[name] = settings or Retrieval()

    def delete(self, name: str) -> None:
        self._of(name)
        del self._settings[name]
        self._state.pop(name, None)

    def info(self) -> list[str]:
        return sorted(self._settings)

    def status(self, name: str) -> str:
        """queued, running, error, or finished, which also stands for a service that never indexed."""
        queued = self.queue.status(name)
        return queued if queued != "finished" else self._state.get(name, "finished")

    @property
    def queue(self) -> JobQueue:
        return JobQueue(self.spark, f"{self.root}/_jobs")

    def upload(self, name: str, paths: list[str]) -> None:
        """Copy files to the service and queue a job that indexes them; `work` does the jobs."""
        self._of(name)
        if self.status(name) == "running":
            raise ServiceError(Code.LANGUAGE_MODEL, f"{name} is being indexed")
        self.queue.upload(name, paths)
        self.queue.watch().awaitTermination()

    def work(self) -> int:
        """Index what is queued, jobs one after the other; how many there were. A job's files are pages of text."""

        def run(name: str, payload: dict) -> None:
            found = self.spark.read.format("binaryFile").load(payload["paths"]).select("path", extension("path").alias("ext"), "content")
            documents = page_documents(pages_of(loaded_text(found).where("error is null").select("source", "content")))
            self.index(name, documents, override=Retrieval.of(update_index=True))

        return self.queue.drain(run)

    def _of(self, name: str) -> Retrieval:
        if name not in self._settings:
            raise ServiceError(Code.SERVICE, f"no service {name}")
        return self._settings[name]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def lexical(self, name: str) -> SegmentedIndex:
        return SegmentedIndex(self.spark, f"{self.path(name)}/lexical")

    def exists(self, name: str, part: str = "lexical") -> bool:
        return self.lexical(name).exists() if part == "lexical" else bool(names(self.spark, f"{self.path(name)}/{part}"))

    def index(self, name: str, documents: DataFrame, vectors: DataFrame | None = None, override: Retrieval | None = None) -> None:
        """Build the tables, or add the sources that aren't there yet; a protected index isn't built anew.

        An update adds the vectors of fresh sources, or, of vectors that name no source, those with an id that isn't there yet.
        """
        how = merged(self._of(name), override)
        if self._state.get(name) in ("queued", "running"):  # by this session; other sessions' jobs are in the queue
            raise ServiceError(Code.BAD_REQUEST, f"{name} is being indexed")
        self._state[name] = "queued"
        with self._lock:
            self._state[name] = "running"
            try:
                there = self.exists(name)
                if there and how.reindex and how.index_protection:
                    raise ServiceError(Code.INPUT_BAD, f"the index of {name} is protected")
                index = self.lexical(name)
                if there and how.update_index:
                    known = index.documents().select("source").distinct()
                    if vectors is not None:
                        self._append_vectors(name, vectors, known)
                    index.add(documents.join(known, "source", "left_anti"))
                    index.compact()
                elif not there or how.reindex:
                    index.create(documents)
                    if vectors is not None:
                        vectors.write.mode("overwrite").parquet(f"{self.path(name)}/vectors")
                self._write_mode(name, how.retrieval_mode)
                self._state[name] = "finished"
            except BaseException:
                self._state[name] = "error"
                raise

    def _append_vectors(self, name: str, vectors: DataFrame, known: DataFrame) -> None:
        """Before the documents are added, as `known` is what stands there."""
        path = f"{self.path(name)}/vectors"
        if "source" in vectors.columns:
            vectors = vectors.join(known, "source", "left_anti").select(*vectors.columns)
        elif self.exists(name, "vectors"):
            vectors = vectors.join(self.spark.read.parquet(path).select("id"), "id", "left_anti").select(*vectors.columns)
        vectors.write.mode("append").parquet(path)

    def _write_mode(self, name: str, mode: str) -> None:
        self.spark.createDataFrame([(json.dumps({"retrieval_mode": mode}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path(name)}/settings")

    def mode(self, name: str) -> str | None:
        """The retrieval mode that the index was last made for; None without an index."""
        if not self.exists(name, "settings"):
            return None
        return json.loads(self.spark.read.text(f"{self.path(name)}/settings").first()["value"])["retrieval_mode"]

    def count(self, name: str) -> int:
        self._of(name)
        return self.lexical(name).count()

    def reset(self, name: str) -> None:
        remove(self.spark, self.path(name))

    def predict(self, name: str, questions: DataFrame, override: Retrieval | None = None, generate: Callable[[DataFrame], DataFrame] | None = None) -> Answer | DataFrame:
        """What is retrieved for the questions, or what a generator makes of (query_id, text, context).

        A service without vectors finds nothing by embedding. Where neither the service nor the request names a mode, it is
        the one that the index was made for.
        """
        how = merged(self._of(name), override)
        if "retrieval_mode" not in how.given and (kept := self.mode(name)):
            how = replace(how, retrieval_mode=kept)
        index = self.lexical(name).index() if self.exists(name) else None
        vectors = None
        if self.exists(name, "vectors") and uses_embeddings(how.retrieval_mode) and "vec" in questions.columns:
            vectors = self.spark.read.parquet(f"{self.path(name)}/vectors")
        answer = retrieve(how, questions, vectors, index)
        if generate is None:
            return answer
        contexts = answer.context if answer.context is not None else self.spark.createDataFrame([], "query_id long, context string")
        return generate(questions.join(contexts, "query_id", "left").select("query_id", "text", "context"))
