"""A lexical index that grows by segments, so that an update writes what is new and nothing else.

Each update writes one segment: its documents, postings, and statistics, as partitions of four tables. Rows never
change. A document that is deleted or replaced gets a tombstone, kept with what it takes off the statistics, so that terms and
lengths summed over segments and tombstones are those of an index made at once. A commit is a small table that lists
the segments and tombstone sets that count; it is written last, so that a reader sees all of an update or nothing, and
what an interrupted update leaves is not seen. Compaction merges segments of one size class by copying live rows and
adding up statistics. Postings are kept as one row for each document and field, so that what is copied or left out is a
document's row, and a search opens them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lexical import COLUMNS, FIELDS, LexicalIndex, opened, word_counts
from lodestone.sources.scratch import names, remove

STATE = "kind string, name string, number long"
STATS = ("terms", "fields")
#: So many segments of one size class are merged, and each class is as many times larger than the one below.
WIDTH = 8


@dataclass(frozen=True)
class State:
    """What a commit lists: segments with their number of documents, tombstone sets, and the last batch of each writer."""

    version: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    dead: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)


class SegmentedIndex:
    """The index under a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, fields: tuple[str, ...] = FIELDS):
        self.spark, self.root, self.fields = spark, root, fields

    # --- commits

    def versions(self) -> list[int]:
        found = [n for n in names(self.spark, f"{self.root}/commits") if n.startswith("v")]
        return sorted(int(n[1:]) for n in found if "_SUCCESS" in names(self.spark, f"{self.root}/commits/{n}"))

    def exists(self) -> bool:
        return bool(self.versions())

    def state(self) -> State:
        versions = self.versions()
        if not versions:
            return State()
        rows = self.spark.read.schema(STATE).parquet(f"{self.root}/commits/v{versions[-1]:08d}").collect()  # a row for each segment
        of = lambda kind: {r["name"]: r["number"] for r in rows if r["kind"] == kind}
        return State(versions[-1], of("segment"), tuple(sorted(of("dead"))), of("batch"))

    def _commit(self, state: State) -> None:
        """Under the next number that no commit has, finished or not."""
        rows = [("segment", n, c) for n, c in state.segments.items()] + [("dead", n, 0) for n in state.dead] + [("batch", n, b) for n, b in state.batches.items()]
        taken = [int(n[1:]) for n in names(self.spark, f"{self.root}/commits") if n.startswith("v")]
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(f"{self.root}/commits/v{max(taken, default=0) + 1:08d}")

    # --- tables

    def _read(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/segment={p}" for p in parts])

    def _dead(self, table: str, state: State) -> DataFrame | None:
        """Tombstones, or what they take off, for segments that still count: `home` names a document's segment."""
        if not state.dead:
            return None
        return self._read(f"dead_{table}", list(state.dead)).drop("segment").where(F.col("home").isin(*state.segments))

    def _live(self, table: str, state: State, parts: list[str] | None = None) -> DataFrame:
        rows, dead = self._read(table, parts or list(state.segments)), self._dead("ids", state)
        return rows if dead is None else rows.join(dead.withColumnRenamed("home", "segment"), ["segment", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        """All documents that count."""
        state = self.state()
        if not state.segments:
            raise ValueError(f"no index at {self.root}")
        return self._live("documents", state).select(*COLUMNS)

    def count(self) -> int:
        state = self.state()
        if not state.segments:
            return 0
        dead = self._dead("ids", state)
        return sum(state.segments.values()) - (dead.count() if dead is not None else 0)

    def index(self) -> LexicalIndex:
        """The index as a search takes it; terms are not summed yet, as a search needs few of them."""
        state = self.state()
        if not state.segments:
            raise ValueError(f"no index at {self.root}")
        merged = {t: self._read(t, list(state.segments)).drop("segment") for t in STATS}
        for t in STATS:
            if (off := self._dead(t, state)) is not None:
                merged[t] = merged[t].unionByName(off.drop("home"))
        fields = merged["fields"].groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("field", "n", (F.col("total") / F.col("n")).alias("average"))
        dead = self._dead("ids", state)
        postings = opened(self._read("postings", list(state.segments)))
        return LexicalIndex(self._live("documents", state).select(*COLUMNS), postings, merged["terms"], fields, dead.withColumnRenamed("home", "segment") if dead is not None else None)

    # --- updates

    def _finish(self, name: str) -> int:
        """The statistics of a segment whose documents and postings are written; how many documents it has."""
        part = lambda table: f"{self.root}/{table}/segment={name}"
        documents, postings = (self.spark.read.parquet(part(t)) for t in ("documents", "postings"))
        opened(postings).groupBy("term", "field").agg(F.count("*").alias("df")).write.parquet(part("terms"))
        lengths(postings, documents, self.fields).write.parquet(part("fields"))
        return documents.count()

    def _segment(self, documents: DataFrame) -> tuple[str, int]:
        name = f"s{uuid.uuid4().hex}"
        part = lambda table: f"{self.root}/{table}/segment={name}"
        documents.select(*COLUMNS).write.parquet(part("documents"))
        word_counts(self.spark.read.parquet(part("documents")), self.fields).write.parquet(part("postings"))
        return name, self._finish(name)

    def _tombstones(self, ids: DataFrame, state: State) -> str | None:
        """Mark the live documents with these ids(doc_id) as dead; None if there are none."""
        name = f"t{uuid.uuid4().hex}"
        part = lambda table: f"{self.root}/dead_{table}/segment={name}"
        gone = self._live("documents", state).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("segment").alias("home"), "doc_id")
        gone.write.parquet(part("ids"))
        gone = self.spark.read.schema("home string, doc_id string").parquet(part("ids"))
        if gone.isEmpty():
            return None
        postings = self._read("postings", list(state.segments)).join(gone.withColumnRenamed("home", "segment"), ["segment", "doc_id"], "left_semi").withColumnRenamed("segment", "home")
        opened(postings).groupBy("home", "term", "field").agg((-F.count("*")).alias("df")).write.parquet(part("terms"))
        off = lengths(postings, gone, self.fields, "home")
        off.select("home", "field", (-F.col("n")).alias("n"), (-F.col("total")).alias("total")).write.parquet(part("fields"))
        return name

    def create(self, documents: DataFrame) -> None:
        """An index of these documents alone, none among them, in place of what there was; readers see the old one until it is done."""
        name, count = self._segment(documents)
        self._commit(State(segments={name: count}))

    def add(self, documents: DataFrame, *, batch: tuple[str, int] | None = None) -> bool:
        """Add documents; those whose id is there already take its place.

        batch: a writer and the number of its batch; a batch that is not above the writer's last was added before, and
        False comes back. Ids must be distinct. Null ids can't be replaced.
        """
        state = self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return False
        name, count = self._segment(documents)
        dead = state.dead
        if state.segments:
            own = self.spark.read.parquet(f"{self.root}/documents/segment={name}")
            dead = tuple(d for d in (*dead, self._tombstones(own, state)) if d)
        self._commit(State(0, state.segments | {name: count}, dead, state.batches | (dict([batch]) if batch else {})))
        return True

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents with these ids(doc_id); ids that aren't there don't matter."""
        state = self.state()
        if state.segments and (name := self._tombstones(ids, state)):
            self._commit(State(0, state.segments, (*state.dead, name), state.batches))

    def compact(self, width: int = WIDTH) -> int:
        """Merge the segments of each size class that has at least `width`; how many segments went."""
        state, classes = self.state(), {}
        for name, count in state.segments.items():
            classes.setdefault(int(math.log(max(count, 1), width)), []).append(name)
        merged = 0
        for members in classes.values():
            if len(members) >= width:
                self._merge(members)
                merged += len(members)
        return merged

    def _merge(self, members: list[str]) -> None:
        state, name = self.state(), f"s{uuid.uuid4().hex}"
        for table in ("documents", "postings"):
            self._live(table, state, members).drop("segment").write.parquet(f"{self.root}/{table}/segment={name}")
        self._add_up(name, members, state)
        count = self.spark.read.parquet(f"{self.root}/documents/segment={name}").count()
        left = {n: c for n, c in state.segments.items() if n not in members} | {name: count}
        self._commit(State(0, left, tuple(d for d in state.dead if self._touches(d, left)), state.batches))

    def _add_up(self, name: str, members: list[str], state: State) -> None:
        """The statistics of a segment merged from these: theirs, without what tombstones take off."""
        for table, key, sums in (("terms", ("term", "field"), ("df",)), ("fields", ("field",), ("n", "total"))):
            rows, off = self._read(table, members).drop("segment"), self._dead(table, state)
            if off is not None:
                rows = rows.unionByName(off.where(F.col("home").isin(*members)).drop("home"))
            merged = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
            (merged.where("df > 0") if table == "terms" else merged).write.parquet(f"{self.root}/{table}/segment={name}")

    def _touches(self, dead: str, segments: dict[str, int]) -> bool:
        return not self._read("dead_ids", [dead]).where(F.col("home").isin(*segments)).isEmpty()

    def vacuum(self) -> None:
        """Remove what the last commit doesn't list; nobody may read an older one."""
        state = self.state()
        kept = {f"segment={n}" for n in (*state.segments, *state.dead)}
        for table in ("documents", "postings", *STATS, "dead_ids", *[f"dead_{t}" for t in STATS]):
            for n in names(self.spark, f"{self.root}/{table}"):
                if n not in kept:
                    remove(self.spark, f"{self.root}/{table}/{n}")
        for v in names(self.spark, f"{self.root}/commits"):
            if v != f"v{state.version:08d}":
                remove(self.spark, f"{self.root}/commits/{v}")


def lengths(postings: DataFrame, documents: DataFrame, fields: tuple[str, ...], *by: str) -> DataFrame:
    """(field, n, total): how many documents there are, and how many words these have in each field; a document without words counts."""
    words = postings.groupBy(*by, "field").agg(F.sum("length").alias("total"))
    every = (documents.groupBy(*by) if by else documents).agg(F.count("*").alias("n")).withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    return every.join(words, [*by, "field"], "left").select(*by, "field", "n", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
