"""The trie of all prefixes of conversations: what they share, and what computing a shared prefix once would save.

A node is named by two chained 64-bit hashes of its turns, so that turns are hashed in the scan and no text moves. Distinct
sequences are ranked lexicographically; a node's subtree is then an interval of ranks, and in preorder, by first
rank and depth, an interval of positions. Each node has an event where its subtree starts and one where it ends; sums up
to the two, over the whole order, differ by what the subtree holds.

The key by which a sequence is ranked holds only the turns that have siblings. To have s of those, a sequence must share
prefixes of s lengths with others, which takes s * (s + 1) / 2 rows of theirs: a key of n rows in all stays below the root of
2 n turns, whatever the length of a conversation. Joins with nodes that very many rows share go by a broadcast of the
HOT most shared ones, the rest by a shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, table
from lodestone.llm.scans import running

#: Nodes, those with the most rows, that go to the rows as a broadcast.
HOT = 2000
WORD = r"[^\x20\x09-\x0D]+"
#: Ids are put together in blocks of 256 numbers before a node's digest runs over them.
BLOCK_BITS = 8


def symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words) of turns(conv_id, turn, role, text): a turn by two hashes, and how many words it has."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    hashes = F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b")
    rows = turns.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *hashes, F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def told(rows: DataFrame, facts: DataFrame, on: list[str], weight: str) -> DataFrame:
    """The inner join with facts that are unique in `on`: the HOT facts of most weight go by broadcast, others by shuffle."""
    hot = facts.orderBy(F.desc(weight), *on).limit(HOT)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def digests(ends: DataFrame) -> DataFrame:
    """(k, l, ends_sha256) of ends(k, l, conv_id): the digest of a node's ids, ascending, with commas between."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("k", "l", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(ids.alias("ids"))
    dealt = blocks.repartition("k", "l").sortWithinPartitions("k", "l", "block").select("k", "l", "ids")

    def run(parts):
        now, digest = None, None
        for part in parts:
            done = []
            for k, l, text in zip(*(c.to_pylist() for c in part.columns)):
                if (k, l) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (k, l), hashlib.sha256(text.encode())
                else:
                    digest.update(("," + text).encode())
            yield batch(done)
        if now is not None:
            yield batch([(*now, digest.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["k", "l", "ends_sha256"])

    return dealt.mapInArrow(run, "k long, l long, ends_sha256 string")


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations(conv_id) whose turns are rows(conv_id, turn, a, b, words), ordered by turn, null first.

    Columns: conv_id, the smallest member; depth; parent_conv_id, the parent's; n_convs, members; n_children; n_leaves and
    saved_tokens of the subtree; ends_sha256 of the members that end here; pre and pre_end, the positions of the node
    and of the last of its subtree in preorder. Equal turn numbers are ordered by the turns' hashes. Conversations
    without rows end at the root, which has depth 0 and no parent; without conversations there are no nodes.
    """
    line = running(rows, "conv_id", ["turn", "a", "b"], chains=("a", "b"))
    r = checkpointed(line.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("a_run").alias("k"), F.col("b_run").alias("l"), F.col("a_before").alias("pk"), F.col("b_before").alias("pl"), "words"))
    conversations = checkpointed(conversations.select("conv_id").distinct())

    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k"), zero.alias("l"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("words"), zero.alias("pk"), zero.alias("pl"))
    nodes = r.groupBy("k", "l").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "words", "pk", "pl")])
    nodes = checkpointed(nodes.unionByName(root))
    below = nodes.where("depth > 0").groupBy(F.col("pk").alias("k"), F.col("pl").alias("l")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(below, ["k", "l"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = nodes.where("n_children > 0").select(F.col("k").alias("pk"), F.col("l").alias("pl"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    placed = told(nodes.where("depth > 0"), parents, ["pk", "pl"], "siblings")
    nodes = checkpointed(placed.unionByName(nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "siblings": F.lit(1).cast("long")})))

    last = r.groupBy("conv_id").agg(F.max(F.struct("depth", "k", "l")).alias("e"))
    ends = conversations.join(last, "conv_id", "left")
    ends = checkpointed(ends.select("conv_id", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in ("depth", "k", "l")]))

    # a sequence of turns stands for all conversations that are equal
    sequences = ends.groupBy("k", "l").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("length")).select("conv_id", "length")
    own = r.join(sequences, "conv_id", "left_semi").select("conv_id", "depth", "k", "l")
    own = checkpointed(own)
    choices = told(own, nodes.where("siblings > 1").select("k", "l", "n_convs"), ["k", "l"], "n_convs")
    steps = F.array_sort(F.collect_list(F.struct("depth", "k", "l")))
    keys = choices.groupBy("conv_id").agg(F.flatten(F.transform(steps, lambda s: F.array(s["k"], s["l"]))).alias("key"))
    keyed = sequences.join(keys, "conv_id", "left").select(F.lit("").alias("g"), "conv_id", "length", F.coalesce("key", F.array().cast("array<long>")).alias("key"))
    ranks = checkpointed(running(checkpointed(keyed), "g", ["key", "length"]).select("conv_id", F.col("place").alias("rank")))

    spans = own.join(ranks, "conv_id").groupBy("k", "l").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    spans = spans.unionByName(ranks.agg(zero.alias("k"), zero.alias("l"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo is not null"))
    held = nodes.join(spans, ["k", "l"])
    starts = held.select("k", "l", F.col("lo").alias("at"), F.col("depth").alias("then"), F.lit(1).cast("long").alias("starts"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    stops = held.select("k", "l", F.col("hi").alias("at"), F.lit((1 << 63) - 1).alias("then"), zero.alias("starts"), zero.alias("leaves"), zero.alias("saved"))
    events = running(checkpointed(starts.unionByName(stops).withColumn("g", F.lit(""))), "g", ["at", "then"], sums=("starts", "leaves", "saved"))
    stop = F.col("starts") == 0
    differ = lambda c: F.sum(F.when(stop, F.col(f"{c}_run")).otherwise(F.col(c) - F.col(f"{c}_run")))
    within = events.groupBy("k", "l").agg(F.max(F.when(~stop, F.col("starts_run") - 1)).alias("pre"), F.max(F.when(stop, F.col("starts_run") - 1)).alias("pre_end"), differ("leaves").alias("n_leaves"), differ("saved").alias("saved_tokens"))

    out = nodes.join(within, ["k", "l"]).join(digests(ends), ["k", "l"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "pre", "pre_end")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of turns(conv_id, turn, role, text), as `trie` gives it.

    Null roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation
    and are left out. Other columns are not read.
    """
    rows = checkpointed(symbols(turns))
    return trie(rows, rows)


def forked(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations as forks: each begins with turns of the one whose number is the next lower multiple of `every`.

    Of that the first h turns come, h being the crc32 of the id modulo `most`, then the conversation's own turns after its first h. Gives
    rows in the form of `symbols`, which rows must have, and the ids, those of conversations left without a turn among them.
    """
    placed = checkpointed(running(rows, "conv_id", ["turn", "a", "b"]))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    ids = placed.where("place = 0").select("conv_id")
    first = placed.where(F.col("place") < most - 1).where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), "place", "a", "b", "words")
    given = ids.withColumn("h", h).withColumn("base", base).join(first, "base").where("place < h")
    columns = "conv_id", F.col("place").alias("turn"), "a", "b", "words"
    return given.select(*columns).unionByName(placed.where(F.col("place") >= h).select(*columns)), ids


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations as forks."""
    rows, ids = forked(checkpointed(symbols(table(spark, sf_dir, "conversations"))))
    return trie(checkpointed(rows), ids).drop("pre", "pre_end")


#: The same with whole sequences of roles and texts as names, and a node's subtree by comparing beginnings.
OP13_SQL = r"""
with crc_table as (
    select list(list_reduce(list_concat([i::ubigint], list_transform(range(8), lambda j: j::ubigint)), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) order by i) as t
    from range(256) r(i)
), o as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as s from conversations where conv_id is not null
), own as (
    select conv_id, list(s order by p) as turns from o group by conv_id
), c as (
    select conv_id, turns, conv_id - conv_id % 20 as base,
        cast(xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda p: ascii(substr(conv_id::varchar, p, 1))::ubigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1]))) % 4 as bigint) as h
    from own, crc_table
), f as (
    select c.conv_id, list_concat(coalesce(b.turns[1 : h], []), c.turns[h + 1 :]) as turns from c left join own b on b.conv_id = c.base
), m as (
    select conv_id, unnest(generate_series(0, len(turns))) as depth, turns from f
), k as (
    select conv_id, depth, turns[1 : depth] as path, len(turns) = depth as ends from m
), n as (
    select path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids,
        case when depth = 0 then 0 else len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) end as words
    from k group by path, depth
), q as (
    select n.*, p.conv_id as parent_conv_id, (select count(*) from n x where x.depth = n.depth + 1 and x.path[1 : n.depth] = n.path) as n_children from n left join n p on p.depth = n.depth - 1 and p.path = n.path[1 : n.depth - 1]
), up as (
    select path[1 : d] as path, n_children, n_convs, words from (select unnest(generate_series(0, depth)) as d, path, n_children, n_convs, words from q)
), s as (
    select path, count(*) filter (n_children = 0) as n_leaves, cast(sum((n_convs - 1) * words) as bigint) as saved_tokens from up group by path
)
select q.conv_id, cast(q.depth as bigint) as depth, q.parent_conv_id, q.n_convs, q.n_children, s.n_leaves, s.saved_tokens, sha256(q.ids) as ends_sha256 from q join s on s.path = q.path
"""
