"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

A document's words become numbers of the items' vocabulary (0: a word of no item), so that its n-grams meet the items'
by sorted search over a few integers. One pass counts in how many documents each of the items' n-grams occurs; an item
keeps as seeds those that are rare in the corpus, and always its rarer half, so that an item that leaked everywhere
keeps seeds too. A second pass aligns the words around each seed with the item.

The items go to the workers as a broadcast, in parts of at most ITEMS_AT_ONCE items and ITEM_WORDS_AT_ONCE words;
further parts take further passes.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches, checkpointed, documents_of, table

WORD = re.compile(r"\w+")
SEED_WORDS = 3
#: Share of the documents up to which an n-gram is rare, and the documents up to which it is in a small corpus.
RARE_SHARE, RARE_DOCUMENTS = 1e-4, 5
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
ITEMS_AT_ONCE, ITEM_WORDS_AT_ONCE = 20_000, 2_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """Items as word numbers, with their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], n: int = SEED_WORDS):
        self.n, self.number, self.ids, self.words = n, {}, [], []
        for item_id, text in rows:
            if words := words_of(text or ""):
                self.ids.append(item_id)
                self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64))
        grams, item, at = [], [], []
        for k, w in enumerate(self.words):
            g = self.grams(w if len(w) >= n else np.concatenate([w, np.zeros(n - len(w), np.int64)]))
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        empty = [np.zeros(0, np.int64)]
        self.gram, self.item, self.at = (np.concatenate(x or empty) for x in (grams, item, at))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = self.gram[order], self.item[order], self.at[order]
        self.distinct = np.unique(self.gram)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the n-grams; -1 if a word is of no item. Keys that collide only add alignments."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(m, np.uint64), np.ones(m, bool)
        for k in range(self.n):
            part = ids[k : k + m]
            key = key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, (key >> np.uint64(1)).astype(np.int64), -1)

    def read(self, text: str) -> np.ndarray:
        get = self.number.get
        words = words_of(text)
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def seen(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document, and places in `distinct`, of n-grams that an item has; an item of fewer than n words matches nowhere but as padded."""
        g = self.grams(np.concatenate([ids, np.zeros(self.n - 1, np.int64)]) if len(ids) < self.n else ids)
        at = np.flatnonzero(g >= 0)
        if not len(at) or not len(self.distinct):
            return at[:0], at[:0]
        place = np.searchsorted(self.distinct, g[at])
        hit = self.distinct[np.minimum(place, len(self.distinct) - 1)] == g[at]
        return at[hit], place[hit]

    def seeds(self, frequency: np.ndarray, rare: float) -> Seeds:
        """Those n-grams of each item that occur in at most `rare` documents, or are of the rarer half of the item's."""
        often = frequency[np.searchsorted(self.distinct, self.gram)] if len(self.gram) else self.gram
        keep = often <= rare
        order = np.lexsort((often, self.item))
        count = np.bincount(self.item, minlength=len(self.words))
        place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        keep[order[place < (count[self.item[order]] + 1) // 2]] = True
        return Seeds(self, self.gram[keep], self.item[keep], self.at[keep])


class Seeds:
    def __init__(self, items: Items, gram: np.ndarray, item: np.ndarray, at: np.ndarray):
        self.items, self.item, self.at = items, item, at
        self.lengths = np.array([len(w) for w in items.words], np.int64)
        self.first = np.searchsorted(gram, items.distinct, "left")
        self.last = np.searchsorted(gram, items.distinct, "right")

    def windows(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of the runs of words to align, each wide enough for a copy at a seed's diagonal."""
        at, place = self.items.seen(ids)
        n = (self.last - self.first)[place]
        if not n.sum():
            return []
        where = np.repeat(at, n)
        rows = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[rows]
        length = self.lengths[item]
        step = length // 2 + 1
        k = (where - self.at[rows]) // step
        pad = length // 2 + 4
        found = np.unique(np.stack([item, np.maximum(0, k * step - pad), np.minimum(len(ids), k * step + step + length + pad)]), axis=1)
        return list(zip(*found.tolist()))


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item's words with each row of passages (0: a word that matches nothing), and its last column.

    A row of the matrix depends on itself only through gaps along it, which a running maximum resolves at once.
    """
    rows, width = passages.shape
    slope = -GAP * np.arange(1, width + 1, dtype=np.int32)
    above = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for w in item.tolist():
        diagonal = above[:, :-1] + np.where(passages == w, MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(1)
        value = now[np.arange(rows), top]
        end = np.where(value > best, top + 1, end)
        best = np.maximum(best, value)
        above[:, 1:] = now
    return best, end


def similarity(item: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Share of the score that a whole copy of the item has."""
    return score / (MATCH * len(item))


def hits(seeds: Seeds, documents: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
    """(document, item, similarity, first word, end word) of each document's best alignment with each item that has a seed in it."""
    jobs = defaultdict(list)
    for d, ids in enumerate(documents):
        for item, a, b in seeds.windows(ids):
            jobs[item].append((d, a, b))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, group in jobs.items():
        item = seeds.items.words[k]
        for x in range(0, len(group), 512):
            some = group[x : x + 512]
            passages = np.zeros((len(some), max(b - a for _, a, b in some)), np.int64)
            for r, (d, a, b) in enumerate(some):
                passages[r, : b - a] = documents[d][a:b]
            score, end = align(item, passages)
            for (d, a, _), s, e in zip(some, similarity(item, score).tolist(), end.tolist()):
                if s > best.get((d, k), (0.0, 0, 0))[0]:
                    best[d, k] = (s, max(a, a + e - len(item)), a + e)
    return [(d, seeds.items.ids[k], *v) for (d, k), v in best.items()]


def item_parts(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in parts of bounded size, one after the other."""
    part, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1]) // 4
        if len(part) >= ITEMS_AT_ONCE or size >= ITEM_WORDS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def corpus_seeds(docs: DataFrame, part: list[tuple[int, str]], seed_words: int = SEED_WORDS):
    """Broadcast seeds of a part of the items, by the number of documents in which each of their n-grams occurs."""
    context = docs.sparkSession.sparkContext
    items = Items(part, seed_words)
    shared = context.broadcast(items)

    def count(parts):
        items = shared.value
        total, n = np.zeros(len(items.distinct), np.int64), 0
        for batch in parts:
            for text in batch.column(0):
                np.add.at(total, np.unique(items.seen(items.read(text.as_py()))[1]), 1)
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["place", "n"])

    frequency, n = np.zeros(len(items.distinct), np.int64), 0
    for row in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # a row for each of the part's n-grams at most
        if row["place"] < 0:
            n = row["n"]
        else:
            frequency[row["place"]] = row["n"]
    return context.broadcast(items.seeds(frequency, max(RARE_DOCUMENTS, RARE_SHARE * n)))


def alignments(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, start, end) of each pair whose best alignment has at least the threshold's share of a whole copy's score.

    start, end: words of the document that the copy takes up, at a guess. Null texts and items are empty and match
    nothing, nor do items of fewer than seed_words words; rows that repeat an id are aligned each for itself; no rows on either side give no rows.
    """
    spark, docs = df.sparkSession, documents_of(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    ddl = "doc_id long, item_id long, similarity double, start long, end long"
    out = spark.createDataFrame([], ddl)
    for k, part in enumerate(item_parts(benchmark, item_col, item_text_col)):
        chosen = corpus_seeds(docs, part, seed_words)

        def score(parts, chosen=chosen):
            seeds = chosen.value
            for batch in parts:
                for a in range(0, batch.num_rows, 1024):
                    piece = batch.slice(a, 1024)
                    ids = piece.column(0).to_pylist()
                    found = hits(seeds, [seeds.items.read(t.as_py()) for t in piece.column(1)])
                    yield from batches(schema, ((ids[d], *rest) for d, *rest in found if rest[1] >= threshold))

        pairs = docs.mapInArrow(score, ddl)
        out = out.unionByName(pairs) if k else pairs
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """The rows of df whose text holds no copy of an item, with all their columns; nothing is shuffled but counts.

    Null and empty texts stay, as do all rows where there is no item; ids and other columns are not read, so they may be
    null, repeat or have any name; no rows give no rows.
    """
    names, at = df.columns, df.columns.index(text_col)
    docs = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for part in item_parts(benchmark, item_col, item_text_col):
        chosen = corpus_seeds(docs, part, seed_words)

        def clean(parts, chosen=chosen):
            seeds = chosen.value
            for batch in parts:
                for a in range(0, batch.num_rows, 1024):
                    piece = batch.slice(a, 1024)
                    keep = [True] * piece.num_rows
                    for d, _, similar, *_ in hits(seeds, [seeds.items.read(t or "") for t in piece.column(at).to_pylist()]):
                        keep[d] &= similar < threshold
                    yield piece.filter(pa.array(keep))

        df = df.mapInArrow(clean, df.schema)
    return df.select(*[f"`{n}`" for n in names])


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, n_items, best_item, best_similarity) of every distinct id of df, best_item being the smallest of the best.

    Rows that repeat an id, or have none, count as one document each: contaminated if one of them is. Null and empty texts
    are clean; no items leave all clean; no rows give no rows.
    """
    pairs = checkpointed(alignments(df, benchmark, id_col=id_col, text_col=text_col, threshold=threshold))
    best = pairs.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n"), F.min(F.struct((-F.col("similarity")).alias("s"), F.col("item_id").alias("i"))).alias("b"))
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    return ids.alias("d").join(best.alias("b"), F.expr("d.doc_id <=> b.doc_id"), "left").select("d.doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.col("b.b.i").alias("best_item"), F.coalesce(-F.col("b.b.s"), F.lit(0.0)).alias("best_similarity"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what it shares with the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
