"""A Merkle manifest of a dataset: leaves to a subroot for each group, subroots to one root, and a proof for each row.

Bottom-up, every level is made from the one below by grouping runs of consecutive nodes, and is kept in a checkpoint.
Top-down, the nodes of each kept level join their parents: a child takes its siblings from the parent's run and puts them
before the proof that the parent has. Nodes are dealt by group and number, so that a group of any size spreads evenly,
and a leaf's number comes from ranks over range partitions. Texts are hashed in the scan and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, table
from lodestone.llm.scans import running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: A level of at most so many nodes is one partition, so that the levels above cost no shuffles.
SMALL = 20_000
STEP = "struct<before: binary, after: binary>"


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(*texts: Column) -> Column:
    """SHA-256, in bytes, of texts one after the other."""
    return F.unhex(F.sha2(F.concat(*texts), 256))


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and itself, or a dash where it is null."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(*map(part, fields.values()))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to, as text."""
    return F.aggregate(proof, text_of(start), lambda a, s: F.sha2(F.concat(text_of(s["before"]), a, text_of(s["after"])), 256))


def siblings(proof: Column) -> Column:
    """A proof's digests as texts, one after the other, from leaf to root."""
    return F.array_join(F.transform(proof, lambda s: text_of(F.concat(s["before"], s["after"]))), "")


def raised(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The kept levels (g, idx, digest, children), from the leaves (g, idx, digest, ...) up, without those of single nodes' own.

    A group's top is its node 0 on the last level that has the group.
    """
    levels = [leaves]
    while True:
        below = levels[-1]
        run = F.array_sort(F.collect_list(F.struct((F.col("idx") % arity).alias("at"), "digest")))
        up = below.select("g", "idx", "digest").groupBy("g", F.expr(f"idx div {arity}").alias("idx")).agg(F.transform(run, lambda x: x["digest"]).alias("children"))
        up = up.where((F.col("idx") > 0) | (F.size("children") > 1))
        level = checkpointed(up.select("g", "idx", hashed(F.array_join(F.transform("children", text_of), "")).alias("digest"), "children"))
        n = level.count()
        if not n:
            return levels
        levels.append(level.coalesce(1) if n <= SMALL else level)


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, level, digest): the top of each group."""
    first = [x.where("idx = 0").select("g", F.lit(k).alias("level"), "digest") for k, x in enumerate(levels)]
    out = first[-1]
    for below, above in zip(first, first[1:]):
        out = out.unionByName(below.join(above.select("g"), "g", "left_anti"))
    return checkpointed(out)


def pushed(levels: list[DataFrame], seeds: DataFrame, arity: int) -> DataFrame:
    """The leaves with `proof` and `subroot`, from seeds(g, level, digest, proof): what the top of each group is given.

    A seed is the parent of a top without siblings, whose proof it hands on as it is.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        parents = seeds.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("up"), F.array("digest").alias("run"), F.col("proof").alias("inherited"), F.col("digest").alias("subroot"), F.lit(True).alias("seed"))
        if above is not None:
            parents = parents.unionByName(above.select("g", F.col("idx").alias("up"), F.col("children").alias("run"), F.col("proof").alias("inherited"), "subroot", F.lit(False).alias("seed")))
        at, none = F.col("idx") % arity, F.lit(b"")
        member = [F.coalesce(F.get("run", F.lit(i)), none) for i in range(arity)]
        before = F.concat(*[F.when(at > i, m).otherwise(none) for i, m in enumerate(member)])
        after = F.concat(*[F.when(at < i, m).otherwise(none) for i, m in enumerate(member)])
        own = F.array(F.struct(before.alias("before"), after.alias("after")))
        joined = here.withColumn("up", F.expr(f"idx div {arity}")).join(parents, ["g", "up"])
        above = joined.select(*[here[c] for c in here.columns], F.when(F.col("seed"), F.col("inherited")).otherwise(F.concat(own, F.col("inherited"))).alias("proof"), "subroot")
        if k:
            above = checkpointed(above)
    return above


def manifest(leaves: DataFrame, *, arity: int = ARITY) -> DataFrame:
    """leaves(g, doc_id, leaf, ...) with subroot, root and proof, digests in bytes; further columns pass.

    g: the group, a text without nulls, in whose bytewise order the subroots stand. Leaves ascend by doc_id, a null one
    first, equal ids by their leaves; rows equal in both take neighbouring places in any order. While a group has more
    than one node, every `arity` consecutive ones, the last run what is left, become the hash of their digests; the
    subroots go on alike. proof: for each level up to the root the siblings before and after, without those levels on
    which a group has been a single node. No rows give no rows. The columns idx, digest, children, place, up, run,
    inherited, seed, level, proof, subroot and root must not be taken.
    """
    ranked = running(leaves, "g", ["doc_id", "leaf"])
    own = [c for c in leaves.columns if c not in ("g", "leaf")]
    base = checkpointed(ranked.select("g", F.col("place").alias("idx"), F.col("leaf").alias("digest"), *own))
    levels = raised(base, arity)
    heads = tops(levels)
    upper = running(heads.select(F.lit("").alias("g"), F.col("g").alias("name"), "level", "digest"), "g", ["name"])
    upper_levels = raised(checkpointed(upper.select("g", F.col("place").alias("idx"), "digest", "name", "level")), arity)
    nothing = F.array().cast(f"array<{STEP}>")
    top = tops(upper_levels)
    seeds = pushed(upper_levels, top.withColumn("proof", nothing), arity).select(F.col("name").alias("g"), "level", "digest", "proof")
    seeds = checkpointed(seeds)
    root = top.first()
    if root is None:
        return leaves.select("*", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), nothing.alias("proof")).where("false")
    out = pushed(levels, seeds, arity)
    return out.select("g", *own, F.col("digest").alias("leaf"), "subroot", F.lit(bytes(root["digest"])).alias("root"), "proof")


def document_leaves(df: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changes: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """(g, doc_id, leaf, altered) of each row; altered: the leaf it would have with `changes` to its fields, null unless changed.

    Null groups sort before all others, the empty text among them. Only the named columns are read.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    altered = F.when(changed, leaf(values | changes)) if changes else F.lit(None).cast("binary")
    g = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    return df.select(g.alias("g"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf(values).alias("leaf"), altered.alias("altered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether each leaf, some of them tampered with, leads to the root.

    A null id is never tampered with; a number at the end of its range stays.
    """
    more = F.expr("coalesce(try_add(n_chars, 1), n_chars)")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = checkpointed(document_leaves(table(spark, sf_dir, "documents"), changes={"n_chars": more}, changed=chosen))
    out = manifest(leaves)
    out = out.select("*", folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.select(
        "doc_id",
        text_of(F.col("leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == text_of(F.col("root"))).alias("verified"),
    )


#: The same tree by recursion over levels, and the proofs by one over each leaf's way up.
OP11_SQL = r"""
with recursive crc_table as (
    select list(list_reduce(list_concat([i::ubigint], list_transform(range(8), lambda j: j::ubigint)), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) order by i) as t
    from range(256) r(i)
), d as (
    select doc_id, coalesce('+' || lang, '') as g,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
        coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as n0, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') as n1,
        coalesce(strlen(text) || ':' || text, '-') as tail,
        xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda p: ascii(substr(doc_id::varchar, p, 1))::ubigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1]))) % 7 = 0 as changed
    from documents, crc_table
), l as (
    select doc_id, g, sha256(head || n0 || tail) as leaf, sha256(head || case when changed then n1 else n0 end || tail) as started from d
), lower_tree as (
    select 0 as level, g, row_number() over (partition by g order by doc_id) - 1 as idx, leaf as digest, count(*) over (partition by g) as n from l
    union all
    select level + 1, g, idx // 2, sha256(string_agg(digest, '' order by idx)), (max(n) + 1) // 2 from lower_tree where n > 1 group by level, g, idx // 2
), subroots as (
    select g, digest as subroot, row_number() over (order by g) - 1 as idx, count(*) over () as n from lower_tree where n = 1
), upper_tree as (
    select 0 as level, idx, subroot as digest, n from subroots
    union all
    select level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (max(n) + 1) // 2 from upper_tree where n > 1 group by level, idx // 2
), ranked as (
    select doc_id, g, leaf, started, row_number() over (partition by g order by doc_id) - 1 as idx from l
), way as (
    select doc_id, g, 0 as level, idx, '' as proof, started as folded from ranked
    union all
    select w.doc_id, w.g, w.level + 1, w.idx // 2, w.proof || coalesce(s.digest, ''), sha256(case when w.idx % 2 = 1 then coalesce(s.digest, '') else '' end || w.folded || case when w.idx % 2 = 0 then coalesce(s.digest, '') else '' end)
    from way w join lower_tree me on me.g = w.g and me.level = w.level and me.idx = w.idx and me.n > 1
    left join lower_tree s on s.g = w.g and s.level = w.level and s.idx = xor(w.idx, 1)
), reached as (
    select w.doc_id, s.idx, s.subroot, w.proof, w.folded from way w join lower_tree me on me.g = w.g and me.level = w.level and me.idx = w.idx and me.n = 1 join subroots s on s.g = w.g
), way_up as (
    select doc_id, subroot, 0 as level, idx, proof, folded from reached
    union all
    select w.doc_id, w.subroot, w.level + 1, w.idx // 2, w.proof || coalesce(s.digest, ''), sha256(case when w.idx % 2 = 1 then coalesce(s.digest, '') else '' end || w.folded || case when w.idx % 2 = 0 then coalesce(s.digest, '') else '' end)
    from way_up w join upper_tree me on me.level = w.level and me.idx = w.idx and me.n > 1
    left join upper_tree s on s.level = w.level and s.idx = xor(w.idx, 1)
), done as (
    select w.doc_id, w.subroot, me.digest as root, w.proof, w.folded from way_up w join upper_tree me on me.level = w.level and me.idx = w.idx and me.n = 1
)
select r.doc_id, r.leaf, d.subroot, d.root, sha256(d.proof) as proof_sha256, d.folded as folded_root, d.folded = d.root as verified from ranked r join done d using (doc_id)
"""
