"""Substring deduplication over sentences: every run of several consecutive sentences is hashed and joined globally; a
sentence that a run covers which is not the first of its kind goes.

Clauses count as sentences: a passage that is cut out of the middle of its text shares few whole sentences with the
place that it comes from, but nearly all of its clauses. A run starts at every sentence and is the shortest that has RUN
sentences and WORDS words, so that stock lines and strings of one-word sentences are no runs by themselves.

Workers hash the runs a batch at a time; what is joined is two hashes and a place, no text. The smallest id of each kind
is found by an aggregate with partial minima. The HOT kinds with the most runs go to the runs as a broadcast, the others
by a shuffle, so that no task gathers the rows of a hot run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, documents_of, table

#: Sentences and words that a run has at least.
RUN, WORDS = 2, 20
#: A sentence ends at a line's end, or after one of these before a blank or a tab.
ENDS = ".!?,;:"
BLANKS = re.compile(r"[ \t]+")
#: Kinds, those with the most runs, whose first goes to the runs as a broadcast.
HOT = 2000
#: Bytes of text whose runs are made at once.
PIECE_BYTES = 8 << 20

_R = 0xD1342543DE82EF95


def sentences(text: str) -> list[str]:
    """The sentences of a text, without blanks around them and without empty ones."""
    for blank in " \t" if "\t" in text else " ":
        for end in ENDS:
            text = text.replace(end + blank, end + "\n")
    return [s for p in text.split("\n") if (s := p.strip(" \t"))]


def normal(text: str) -> str:
    """Sentences that differ in case or in runs of blanks only are equal."""
    text = text.lower()
    return BLANKS.sub(" ", text) if "  " in text or "\t" in text else text


class Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            up, down = np.full(2 * n + 1, np.uint64(_R)), np.full(2 * n + 1, np.uint64(pow(_R, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


def runs_of(texts: list[str], run: int, words: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(row, place, length, a, b, again) of all runs of some texts; again: the text itself has the run before that place.

    a and b are polynomial hashes, modulo 2^64 and its upper half, over hashes of the run's sentences. A text that is
    too short for a run is one run as a whole.
    """
    counts, sizes, digests = [], [], []
    digest = xxhash.xxh3_128_digest
    for text in texts:
        own = sentences(normal(text))
        counts.append(len(own))
        sizes += [s.count(" ") + 1 for s in own]
        digests += map(digest, own)
    n, count = len(digests), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    begin, end = (ends - count)[owner], ends[owner]
    total = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    at = np.arange(n)
    stop = np.maximum(at + run, np.searchsorted(total, total[:-1] + words))
    fits = stop <= end
    whole = (at == begin) & ~fits
    stop = np.where(whole, end, stop)
    place = np.flatnonzero(fits | whole)
    up, down = powers.to(n)
    value = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    keys = []
    for k in (0, 1):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(value[:, k] * up[:n], out=prefix[1:])
        keys.append((prefix[stop[place]] - prefix[place]) * down[place])
    a, b = keys[0].view(np.int64), (keys[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    row = owner[place]
    order = np.argsort(keys[0] ^ (row.astype(np.uint64) * np.uint64(_R)), kind="stable")
    same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again = np.zeros(len(place), bool)
    again[order[1:]] = same
    return row, place - begin[place], (stop - at)[place], a, b, again


def pieces(part: pa.RecordBatch, column: int):
    """The batch in slices whose texts have PIECE_BYTES or one row."""
    size, start = 0, 0
    for i, n in enumerate(pc.binary_length(part.column(column)).to_pylist()):
        if size and size + n > PIECE_BYTES:
            yield part.slice(start, i - start)
            size, start = 0, i
        size += n
    if part.num_rows > start:
        yield part.slice(start)


RUNS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("a", pa.int64()), ("b", pa.int32()), ("again", pa.bool_())])
RUNS_DDL = "doc_id long, h long, at long, a long, b int, again boolean"
#: Place and length of a run in one number.
LENGTHS = 1 << 24


def sentence_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, sentences, removed, kept) of every row: kept are the sentences without those covered by a repeated run.

    removed holds their numbers, from 0. A run repeats if a row with a smaller id has it too, or the row itself at an
    earlier place; rows with equal ids don't cut each other. A text with fewer than `run` sentences or `words` words is
    one run as a whole. Null and empty texts have no sentences. A null id is smaller than any other. No rows give no
    rows. Only the two columns are read.
    """
    docs = documents_of(df, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("h"))

    def hashed(parts):
        powers = Powers()
        for part in parts:
            for piece in pieces(part, 1):
                row, place, length, a, b, again = runs_of(piece.column(1).to_pylist(), run, words, powers)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(2).take(rows), pa.array(place * LENGTHS + length), pa.array(a), pa.array(b), pa.array(again)], schema=RUNS)

    runs = docs.mapInArrow(hashed, RUNS_DDL).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    kinds = runs.where("not again").groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    kinds = checkpointed(kinds.where("last > first").select("a", "b", "first", "n"))
    later = repeated(runs, kinds).groupBy("doc_id", "h").agg(F.collect_set("at").alias("gone"))

    def cut(parts):
        schema = pa.schema([("doc_id", pa.int64()), ("sentences", pa.list_(pa.string())), ("removed", pa.list_(pa.int32())), ("kept", pa.list_(pa.string()))])
        for part in parts:
            for piece in pieces(part, 1):
                out = [cut_text(t, g) for t, g in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array([o[k] for o in out], schema.field(k + 1).type) for k in range(3))], schema=schema)

    d, g = docs.alias("d"), later.alias("g")
    both = d.join(g, F.expr("coalesce(d.doc_id, -9223372036854775808) = g.doc_id and d.h = g.h"), "left").select("d.doc_id", "d.text", "g.gone")
    return both.mapInArrow(cut, "doc_id long, sentences array<string>, removed array<int>, kept array<string>")


def repeated(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Those of the runs that repeat. The rows of hot kinds are dealt by their own place, as a broadcast tells their first."""
    hot = F.broadcast(kinds.orderBy(F.desc("n"), "a", "b").limit(HOT).select("a", "b", F.col("first").alias("hot")))
    told = runs.join(hot, ["a", "b"], "left")
    told = told.withColumn("b", F.when(F.col("hot").isNotNull() | F.col("again"), F.hash("doc_id", "h", "at")).otherwise(F.col("b")))
    told = told.withColumn("a", F.when(F.col("hot").isNotNull() | F.col("again"), F.xxhash64("doc_id", "at", "h")).otherwise(F.col("a")))
    found = told.join(kinds.select("a", "b", "first"), ["a", "b"], "left")
    return found.where(F.col("again") | (F.col("doc_id") > F.coalesce("hot", "first"))).select("doc_id", "h", "at")


def cut_text(text: str, gone: list[int] | None) -> tuple[list[str], list[int], list[str]]:
    """Sentences, numbers of those that go, and those that stay."""
    own = sentences(text)
    if not gone:
        return own, [], own
    out = np.zeros(len(own), bool)
    for at in gone:
        out[at // LENGTHS : at // LENGTHS + at % LENGTHS] = True
    return own, np.flatnonzero(out).tolist(), [s for s, o in zip(own, out.tolist()) if not o]


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences every document has and loses, and what is left of it."""
    found = sentence_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("kept_md5"))


#: Runs by their whole text in place of hashes; at places from 1, p to q - 1.
OP6_SQL = r"""
with d as (
    select doc_id, list_filter([trim(s, ' ' || chr(9)) for s in string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '\n+', chr(1), 'g'), '([.!?,;:])[ \t]+', '\1' || chr(1), 'g'), chr(1))], lambda s: s <> '') as s
    from documents
), n as (
    select doc_id, s, [lower(regexp_replace(x, '[ \t]+', ' ', 'g')) for x in s] as norm from d
), w as (
    select *, [len(x) - len(replace(x, ' ', '')) + 1 for x in norm] as w from n
), p as (
    select doc_id, norm, w, unnest(generate_series(1, len(s))) as p from w
), r as (
    select doc_id, norm, p, list_filter(generate_series(p + 2, least(len(norm) + 1, p + 21)), lambda q: list_sum(w[p : q - 1]) >= 20)[1] as q from p
), k as (
    select doc_id, p, coalesce(q, len(norm) + 1) as q, norm[p : coalesce(q, len(norm) + 1) - 1] as key from r where q is not null or p = 1
), f as (
    select key, min(struct_pack(doc_id := doc_id, p := p)) as first from k group by key having count(*) > 1
), c as (
    select distinct doc_id, unnest(generate_series(p, q - 1)) as i from k join f using (key) where struct_pack(doc_id := doc_id, p := p) <> first
), g as (
    select doc_id, list(i) as gone from c group by doc_id
)
select n.doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(len(gone), 0) as bigint) as n_removed,
    md5(coalesce(array_to_string([s[j] for j in generate_series(1, len(s)) if gone is null or not list_contains(gone, j)], chr(10)), '')) as kept_md5
from n left join g using (doc_id)
"""
