"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees over shards of fingerprints.

Distinct fingerprints only are compared. Cut a fingerprint into radius + 2 blocks: two that differ in `radius` bits at
most agree on two of the blocks at least, so every pair of blocks names shards whose members are the only ones that can
link. A shard's members meet in one task, which adds them one by one to a BK-tree (children keyed by their Hamming
distance to the parent), follows only the edges within the radius, and keeps a union-find; it emits one edge for each
member that joins another, not all pairs. The trees stay with their shards: a broadcast of all of them would grow with
the corpus.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches, checkpointed, documents_of, shuffles_go, table, to_batch, unused
from lodestone.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Near copies: a Jaccard similarity of sets of five-word shingles. Their fingerprints meet within NEAR_RADIUS.
SIMILAR_WIDTH, SIMILARITY, NEAR_RADIUS = 5, 0.8, 3


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of `width` words, the whole sequence if it is shorter, nothing without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return [line] if words else []
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    return [line[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends[width - 1 :])]


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, big-endian."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(g, seed) for g in shingles(text, width)]), ">u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of big-endian hashes: a bit is 1 if it is set in over half of them; 0 without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The fingerprint of a text's shingles, repeats included."""
    return fingerprint_of(shingle_hashes(text, width))


def distance(a: int, b: int) -> int:
    """Bits in which two signed 64-bit integers differ."""
    return ((a ^ b) & 0xFFFF_FFFF_FFFF_FFFF).bit_count()


class BKTree:
    """Fingerprints by Hamming distance. near() follows only edges that the triangle inequality leaves open."""

    def __init__(self, radius: int):
        self.radius, self.keys, self.children = radius, [], []

    def add(self, key: int) -> list[int]:
        """Indices of those within the radius; then key is added under the next index, unless it is there already."""
        if not self.keys:
            self.keys.append(key)
            self.children.append({})
            return []
        found, r = [], self.radius
        stack = [0]
        while stack:
            i = stack.pop()
            d = distance(self.keys[i], key)
            if d <= r:
                found.append(i)
            for edge, child in self.children[i].items():
                if d - r <= edge <= d + r:
                    stack.append(child)
        i = 0
        while d := distance(self.keys[i], key):
            if (child := self.children[i].get(d)) is None:
                self.children[i][d] = len(self.keys)
                self.keys.append(key)
                self.children.append({})
                break
            i = child
        return found


def linked(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """An edge to the class's first member for every other member of a shard's classes."""
    tree, parent = BKTree(radius), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for key in keys:
        near = tree.add(key)
        if len(tree.keys) > len(parent):
            parent.append(len(parent))
            for other in near:
                a, b = root(other), root(len(parent) - 1)
                parent[max(a, b)] = min(a, b)
    return [(tree.keys[i], tree.keys[r]) for i in range(len(parent)) if (r := root(i)) != i]


def near_pairs(keys: list[int], nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """For every node of a shard that comes after another within the radius, an edge to one such, the nearest that the search met."""
    tree, first, out = BKTree(radius), [], []
    at: dict[int, int] = {}
    for key, node in zip(keys, nodes):
        if key in at:
            out.append((node, first[at[key]]))
            continue
        near = tree.add(key)
        if near:
            out.append((node, first[min(near, key=lambda i: distance(tree.keys[i], key))]))
        at[key] = len(first)
        first.append(node)
    return out


def shard_keys(fp: Column, radius: int) -> Column:
    """Array of shard keys (longs): each pair of the radius + 2 blocks, with the pair's number."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(F.shiftleft(fp, 64 - cuts[i + 1]), 64 - (cuts[i + 1] - cuts[i])) for i in range(n)]
    return F.array(*[F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(combinations(range(n), 2))])


def runs_of_shards(parts):
    """(rows as lists of columns) of each run of equal first columns in sorted batches."""
    held_key, held = None, None
    for part in parts:
        keys = part.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if held is not None and keys[a] == held_key:
                held.append(part.slice(a, b - a))
                continue
            if held is not None and (len(held) > 1 or held[0].num_rows > 1):
                yield held
            held_key, held = keys[a], [part.slice(a, b - a)]
    if held is not None and (len(held) > 1 or held[0].num_rows > 1):
        yield held


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the classes of the distinct longs in `fp`; a hash that two shards share only adds comparisons."""

    def run(parts):
        found = (e for held in runs_of_shards(parts) for e in linked([x for p in held for x in p.column(1).to_pylist()], radius))
        yield from batches(EDGE, found)

    shards = fingerprints.select(F.explode(shard_keys(F.col("fp"), radius)).alias("shard"), "fp")
    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "u long, v long")


def fingerprint_pairs(nodes: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """Pairs (u, v) of nodes(node, fp) within the radius, one at least for each node that has such a partner in a shard before it."""

    def run(parts):
        def pairs():
            for held in runs_of_shards(parts):
                fps, own = ([x for p in held for x in p.column(i).to_pylist()] for i in (1, 2))
                yield from ((min(e), max(e)) for e in near_pairs(fps, own, radius))

        yield from batches(EDGE, pairs())

    shards = nodes.select(F.explode(shard_keys(F.col("fp"), radius)).alias("shard"), "fp", "node")
    return shards.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "u long, v long")


def fingerprints_of(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts):
        for part in parts:
            fps = pa.array([fingerprint(t.as_py(), width) for t in part.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], schema=schema)

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id stay rows of their own;
    a null id is never the smallest, unless all of a component's ids are null. No rows give no rows.
    """
    docs = checkpointed(fingerprints_of(df, id_col=id_col, text_col=text_col, width=width))
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def gram_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(hashes.astype(np.uint64).view(np.int64))


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The start of a set, in an order that all sets share, that meets the start of every set of that Jaccard similarity.

    The order is by count and then by hash; any order that all sets share is exact, this one keeps common shingles out.
    """
    n = len(grams)
    if len(common) and n:
        at = np.searchsorted(common, grams).clip(max=len(common) - 1)
        grams = grams[np.argsort(np.where(common[at] == grams, counts[at], 0), kind="stable")]
    return grams[: n - math.ceil(similarity * n - 1e-9) + 1] if n else grams


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def histogram(grams: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of a power of two of bins, at least half as many as shingles; 255 stands for 255 or more.

    A looser bound than parities(), which the near copies use, of twice as many bytes.
    """
    bins = 64
    while 2 * bins < len(grams):
        bins *= 2
    return np.bincount(grams & (bins - 1), minlength=bins).clip(max=255).astype(np.uint8).tobytes()


def may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """False only where the histograms rule the similarity out: sets share at most the lesser count of each bin."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if x.max() == 255 or y.max() == 255:
        return True
    y = y.reshape(-1, len(x)).sum(0, dtype=np.int64)
    x = x.astype(np.int64)
    return np.minimum(x, y).sum() >= similarity / (1 + similarity) * (x.sum() + y.sum()) - 1e-9


def parities(grams: np.ndarray) -> bytes:
    """A bit for each of a power of two of bins, at least twice as many as shingles: whether an odd number of the set's shingles falls into it."""
    bins = 64
    while bins < 2 * len(grams):
        bins *= 2
    return np.packbits(np.bincount(grams & (bins - 1), minlength=bins) & 1).tobytes()


class Maps:
    """The parities of some sets, to tell how far pairs of these are apart at least."""

    def __init__(self, maps, size: np.ndarray):
        self.size, self.words = size, np.frombuffer(b"".join(maps), np.uint64)
        self.count = np.fromiter(map(len, maps), np.int64, len(maps)) // 8
        self.start = np.cumsum(self.count) - self.count

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the maps of i and j differ, the longer map folded to half where it is twice as long; no more than shingles that one set alone has."""
        swap = self.count[i] < self.count[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = np.empty(len(i), np.int64)
        kind = 2 * self.count[j] + (self.count[i] > self.count[j])
        for k in np.unique(kind).tolist():
            chosen, w = np.flatnonzero(kind == k), k // 2
            for some in np.array_split(chosen, 1 + len(chosen) * w // (1 << 19)):
                at = self.start[i[some]][:, None] + np.arange(w)
                both = self.words[at] ^ self.words[self.start[j[some]][:, None] + np.arange(w)]
                out[some] = np.bitwise_count(both ^ self.words[at + w] if k & 1 else both).sum(1)
        return out

    def share(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """What the sets of each pair differ in at least, as a share of what the similarity allows; infinite where it is over one. No similar pair is ruled out."""
        n, m = self.size[i], self.size[j]
        out = np.full(len(i), np.inf)
        fit = np.flatnonzero(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
        most = (1 - similarity) / (1 + similarity) * (n + m)[fit] + 1e-9
        share = self.apart(i[fit], j[fit]) / most
        out[fit] = np.where(share <= 1, share, np.inf)
        return out


def possible(i: np.ndarray, n: np.ndarray, j: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one is at places i and j can have the similarity."""
    return np.minimum(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-9


def whole_runs(parts):
    """Columns as arrays, of batches sorted by their first column, cut so that equal first values stay together."""
    held = None
    for part in parts:
        if not part.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in part.columns]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = [c[cut:] for c in now]
        if cut:
            yield [c[:cut] for c in now]
    if held is not None:
        yield held


def run_starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1]))


PLACE = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("pos", pa.int64()), ("size", pa.int64())])
SHARED = PLACE.append(pa.field("n", pa.int64()))
#: Texts of the sample that says which shingles are common; it steers the order only, not which links are found.
ORDER_SAMPLE = 4000
#: Sets under a shingle of their prefixes from which it is put behind all others, and how often the order is mended so.
CROWD, MENDS = 256, 2
#: Partners by chance of a set under each shingle of its prefix, before all pairs that are left are compared.
DRAWS = 8
#: Sets under a shingle from which their maps go there, so that only pairs leave that these don't rule out; and how many partners are drawn there.
LONG, LONG_DRAWS = 32, 32
#: Bits of the maps that tell most texts of no pair before they are shingled again, and most rows that stay before they meet those that go.
MAP_BITS = 1 << 25


def common_grams(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of those that three or more texts(h, text) of a sample have."""
    step = max(1, -(-texts.count() // ORDER_SAMPLE))
    sample = texts.where(F.pmod("h", F.lit(step)) == 0).dropDuplicates(["h"]).select("text")

    def run(parts):
        for part in parts:
            for t in part.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(gram_set(shingle_hashes(t.as_py(), SIMILAR_WIDTH)))], names=["g"])

    found = sample.mapInArrow(run, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n > 2").orderBy("g").toArrow()
    return found["g"].to_numpy(), found["n"].to_numpy()


def crowded(rows: DataFrame, among=None) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), by shingle, of those that stand in the prefixes of very many sets: more than CROWD, and than a millionth of all places.

    So there are at most 2^20 of them. Equal sets count once in a task. Only shingles in the map `among`, if there is one, are counted.
    """
    places = rows.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)).alias("n")).first()["n"] // 8
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def count(parts):
        seen, held, size = set(), [], 0

        def batch():
            keys = np.concatenate(held)
            if among is not None:
                keys = keys[mapped(keys, among.value)]
            keys, n = np.unique(keys, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], schema=schema)

        for part in parts:
            for node, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    held.append(np.frombuffer(keys, np.int64))
                    size += len(held[-1])
            if size > 1 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    counts = rows.select("node", "keys").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > max(CROWD, places >> 20)).orderBy("key").toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


def raised(common: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order with these shingles behind all that aren't among them or were among such before, by their counts."""
    keys = np.union1d(common[0], hot[0])
    value = np.zeros(len(keys), np.int64)
    value[np.searchsorted(keys, common[0])] = common[1]
    value[np.searchsorted(keys, hot[0])] = hot[1] + (1 << 40)
    return keys, value


def shingle_map(fresh: DataFrame):
    """A broadcast map of the shingles in fresh(h, keys)."""

    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64)))], names=["h"])

    return hash_map(fresh.select("keys").mapInArrow(run, "h long"))


def reordered(rows: DataFrame, texts: DataFrame, common, hot: np.ndarray, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows with new prefixes, by the order `common`, where the old ones hold one of the shingles that it puts further back; first (h, keys) of these.

    The prefix of any other set is the same under both orders, as putting back what isn't in it changes nothing. So a shingle
    that no new prefix has stands in no more prefixes than before.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((*common, hot))
    names, at = list(rows.columns), rows.columns.index("keys")

    def touched(parts):
        hot = shared.value[2]
        for part in parts:
            mark = [bool(np.isin(np.frombuffer(k, np.int64), hot).any()) for k in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mark, pa.bool_())], names=[*names, "touched"])

    marked = rows.mapInArrow(touched, ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", touched boolean")
    again = marked.where("touched").drop("touched")
    wanted = hash_map(again.select("h"))
    schema = pa.schema([("h", pa.int64()), ("keys", pa.binary())])

    def renewed(parts):
        keys, counts, _ = shared.value
        for some in chosen_texts(parts, wanted.value):
            if some:
                yield to_batch(schema, [(h, prefix(gram_set(shingle_hashes(text, SIMILAR_WIDTH)), keys, counts, similarity).tobytes()) for h, text in some])

    fresh = checkpointed(texts.mapInArrow(renewed, "h long, keys binary").groupBy("h").agg(F.first("keys").alias("keys")))
    return fresh, checkpointed(marked.where("not touched").drop("touched").unionByName(again.drop("keys").join(fresh, "h")))


def shared_places(rows: DataFrame) -> DataFrame:
    """(key, node, pos, size, n): of rows(node, size, keys), the keys that more than one node has, and how many have it."""

    def places(parts):
        seen = set()
        for part in parts:
            out = []
            for node, size, keys in zip(*(part.column(i).to_pylist() for i in range(3))):
                if node not in seen:
                    seen.add(node)
                    k = np.frombuffer(keys, np.int64)
                    out.append((k, np.full(len(k), node), np.arange(len(k)), np.full(len(k), size)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=PLACE)

    def shared(parts):
        for columns in whole_runs(parts):
            key, node = columns[:2]
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            columns = [c[fresh] for c in columns]
            starts = run_starts(columns[0])
            n = np.diff(np.append(starts, len(columns[0])))
            n = np.repeat(n, n)
            yield pa.RecordBatch.from_arrays([pa.array(c[n > 1]) for c in (*columns, n)], schema=SHARED)

    ddl = "key long, node long, pos long, size long"
    return rows.select("node", "size", "keys").mapInArrow(places, ddl).repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, ddl + ", n long")


def leads(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all sets but one of each run, and of that one; in long runs, which one it is changes with the key."""
    starts = run_starts(key)
    n = np.diff(np.append(starts, len(key)))
    mixed = (node ^ ((key & 7) * 0x1E3779B97F4A7C15)) * 0x2545F4914F6CDD1D
    mixed = np.where(np.repeat(n > 16, n), mixed, node)
    lead = np.repeat(np.lexsort((mixed, np.repeat(np.arange(len(n)), n)))[starts], n)
    i = np.flatnonzero(lead != np.arange(len(key)))
    return i, lead[i]


def first_pairs(columns: list[np.ndarray], similarity: float):
    """In each run one set against all others."""
    key, node, pos, size = columns[:4]
    yield from open_pairs(None, *leads(key, node), node, pos, size, similarity)


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Bits of x well mixed, as unsigned numbers."""
    x = (x.astype(np.int64).view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def chance_pairs(columns: list[np.ndarray], similarity: float, draws: int = DRAWS):
    """In each run each set against some others of the run, drawn by hash."""
    key, node, pos, size = columns[:4]
    starts = run_starts(key)
    n = np.diff(np.append(starts, len(key)))
    for draw in range(draws):
        drawn = np.repeat(starts, n) + (mixed(node ^ key, draw) % np.repeat(n, n).astype(np.uint64)).astype(np.int64)
        ok = (node != node[drawn]) & possible(pos, size, pos[drawn], size[drawn], similarity)
        yield node[ok], node[drawn[ok]]


def some_pairs(columns: list[np.ndarray], similarity: float):
    yield from first_pairs(columns, similarity)
    yield from chance_pairs(columns, similarity)


def drawn_pairs(columns: list[np.ndarray], similarity: float, draws: int = LONG_DRAWS):
    """In each run, of one set against all others and of each against some drawn by hash, pairs that the sets' maps leave open.

    Of its draws a set keeps the first two and the nearest: those connect a group at large, this one a set that few others are near to.
    """
    key, node, pos, size, maps = columns
    held, all_sets = Maps(maps, size), np.arange(len(key))
    yield from open_pairs(held, *leads(key, node), node, pos, size, similarity)
    starts = run_starts(key)
    n = np.diff(np.append(starts, len(key)))
    found, least, nearest = np.zeros(len(key), np.int64), np.full(len(key), np.inf), all_sets.copy()
    for draw in range(draws):
        drawn = np.repeat(starts, n) + (mixed(node ^ key, draw) % np.repeat(n, n).astype(np.uint64)).astype(np.int64)
        i = np.flatnonzero((node != node[drawn]) & possible(pos, size, pos[drawn], size[drawn], similarity))
        share = held.share(i, drawn[i], similarity)
        nearer = share < least[i]
        least[i[nearer]], nearest[i[nearer]] = share[nearer], drawn[i[nearer]]
        i = i[np.isfinite(share)]
        found[i] += 1
        i = i[found[i] <= 2]
        yield node[i], node[drawn[i]]
    i = np.flatnonzero(np.isfinite(least))
    yield node[i], node[nearest[i]]


def open_pairs(held: Maps | None, i: np.ndarray, j: np.ndarray, node: np.ndarray, pos: np.ndarray, size: np.ndarray, similarity: float):
    """Those of the pairs of places that their places, and the sets' maps if there are any, leave open."""
    ok = possible(pos[i], size[i], pos[j], size[j], similarity)
    i, j = i[ok], j[ok]
    if held is not None:
        ok = np.isfinite(held.share(i, j, similarity))
        i, j = i[ok], j[ok]
    yield node[i], node[j]


def other_pairs(columns: list[np.ndarray], similarity: float):
    """In each run all pairs of sets that have different roots, if the sets' maps, where a sixth column has them, leave them open."""
    key, root = columns[0], columns[4]
    starts = run_starts(key)
    n = np.diff(np.append(starts, len(key)))
    several = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), n)
    n = np.repeat(n, n)
    held = Maps(columns[5], columns[3]) if len(columns) > 5 else None
    short = np.flatnonzero(several & (n < LONG))
    for step in range(1, LONG):  # each set and the one so many places further
        short = short[n[short] > step]
        i = short[: np.searchsorted(short, len(key) - step)]
        i = i[(key[i] == key[i + step]) & (root[i] != root[i + step])]
        yield from open_pairs(held, i, i + step, *columns[1:4], similarity)
    long = starts[several[starts] & (n[starts] >= LONG)]
    for a, m in zip(long.tolist(), n[long].tolist()):
        own = root[a : a + m]
        values, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        most = inverse == counts.argmax()
        apart = np.flatnonzero(~most)
        for some in np.array_split(apart, 1 + len(apart) * m // (1 << 18)):
            i, j = np.nonzero((own[some][:, None] != own) & (most | (np.arange(m) > some[:, None])))
            yield from open_pairs(held, a + some[i], a + j, *columns[1:4], similarity)


def hash_map(wanted: DataFrame):
    """A broadcast map of MAP_BITS bits of the hashes in wanted(h): it has all of them, and a few others."""
    place = F.pmod("h", F.lit(MAP_BITS))
    parts_of_map = wanted.groupBy(F.floor(place / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")).collect()  # 1024 rows of 4 KB at most
    bits = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for r in parts_of_map:
        bits[r["b"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(bits.ravel())


def mapped(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the map has these hashes."""
    p = h % MAP_BITS
    return (bits[p >> 3] >> (p & 7) & 1).astype(bool)


def chosen_texts(parts, bits: np.ndarray):
    """For each batch of (h, text) the (h, text) in the map, each hash once in a task."""
    seen = set()
    for part in parts:
        h = part.column(0).to_numpy()
        out = []
        for i in np.flatnonzero(mapped(h, bits)).tolist():
            if int(h[i]) not in seen:
                seen.add(int(h[i]))
                out.append((int(h[i]), part.column(1)[i].as_py()))
        yield out


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, other, grams) of the texts(h, text) whose hash is in wanted(h), and of a few others."""
    shared = hash_map(wanted)
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("grams", pa.binary())])

    def run(parts):
        for some in chosen_texts(parts, shared.value):
            sets = [gram_set(shingle_hashes(text, SIMILAR_WIDTH)).tobytes() for _, text in some]
            if sets:
                yield to_batch(schema, [(*node_of(g), g) for g in sets])

    return texts.mapInArrow(run, "node long, other long, grams binary")


def node_of(grams: bytes) -> tuple[int, int]:
    """Two hashes of a set: its node, and another that tells apart different sets of one node."""
    both = xxhash.xxh3_128_digest(grams, SEED)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def told_apart(df: DataFrame, clashes: DataFrame) -> DataFrame:
    """df(node, other, ...) with a node of its own for each set whose node another set has too: clashes(node, least other), a handful of rows."""
    found = df.join(F.broadcast(clashes), "node", "left")
    return found.withColumn("node", F.when(F.col("other") != F.col("least_other"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("least_other", "other")


def only_possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs that the maps in nodes(node, size, maps) leave open."""

    def run(parts):
        for part in parts:
            k = part.num_rows
            maps = part.column(3).to_pylist() + part.column(5).to_pylist()
            held = Maps(maps, np.concatenate([part.column(2).to_numpy(), part.column(4).to_numpy()]))
            yield part.select([0, 1]).filter(pa.array(np.isfinite(held.share(np.arange(k), np.arange(k, 2 * k), similarity))))

    side = lambda node, n, maps: nodes.select(F.col("node").alias(node), F.col("size").alias(n), F.col("maps").alias(maps))
    return pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v").select("u", "v", "n", "a", "m", "b").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, clashes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose sets have the Jaccard similarity; the sets are made again, of texts that the pairs need only."""

    def run(parts):
        for part in parts:
            a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
            yield part.select([0, 1]).filter(pa.array([jaccard(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) >= similarity - 1e-12 for x, y in zip(a, b)], pa.bool_()))

    pairs = checkpointed(only_possible(pairs.distinct(), nodes, similarity))
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = told_apart(sets_of(texts, nodes.join(ends, "node", "left_semi").select("h")), clashes)
    sets = sets.groupBy("node").agg(F.first("grams").alias("grams"))
    side = lambda node, grams: sets.select(F.col("node").alias(node), F.col("grams").alias(grams))
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")
    return checkpointed(both.mapInArrow(run, "u long, v long"))


def pairs_in_runs(places: DataFrame, pairs_of, similarity: float) -> DataFrame:
    """Pairs (u, v) that pairs_of finds in the runs of places with one key."""

    def run(parts):
        for columns in whole_runs(parts):
            for u, v in pairs_of(columns, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=EDGE)

    return places.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def similar_roots(rows: DataFrame, texts: DataFrame, nodes: DataFrame, clashes: DataFrame, similarity: float) -> DataFrame:
    """(node, root) over all links of at least that Jaccard similarity; nodes(node, h, fp, size, maps) has a text's hash for each set.

    Candidates come from the BK-trees over the sets' fingerprints. No radius that prunes reaches every pair of that
    similarity, so sets also meet under a shingle of their prefixes, which loses none: there one is compared with all
    others, and each with DRAWS drawn by chance, and then all pairs that the links so far leave in different components.
    So a large group of near copies costs no square of its size, as nearly all of it is connected before the second step.
    Where LONG sets or more meet, their maps are there, and pairs that these rule out, nearly all that aren't links, are
    never made. Every pair is verified on the sets themselves.
    """
    places = checkpointed(shared_places(rows))
    few = places.where(F.col("n") < LONG).drop("n")
    many = checkpointed(places.where(F.col("n") >= LONG).drop("n").join(nodes.select("node", "maps"), "node").select("key", "node", "pos", "size", "maps"))
    first = fingerprint_pairs(nodes).union(pairs_in_runs(few, some_pairs, similarity)).union(pairs_in_runs(many, drawn_pairs, similarity))
    links = verified(first, texts, nodes, clashes, similarity)
    roots = components(links)

    def rooted(met: DataFrame, *more: str) -> DataFrame:
        return met.join(roots, "node", "left").select("key", "node", "pos", "size", F.coalesce("root", "node").alias("root"), *more)

    left = pairs_in_runs(rooted(few), other_pairs, similarity).union(pairs_in_runs(rooted(many, "maps"), other_pairs, similarity))
    rest = verified(left, texts, nodes, clashes, similarity)
    return roots if rest.isEmpty() else components(links.union(rest))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df without those that a row with a smaller id reaches over links; all columns, whatever their names.

    Rows link if their sets of five-word shingles have a Jaccard similarity of at least `similarity`; null, empty and
    blank texts have an empty set and link with each other; a text of fewer than five words is one shingle. Of rows that
    repeat an id, one for each component stays. Rows with a null id stay only where their component has no other. No
    rows give no rows. No text moves but those of rows that go and of a few others.
    """
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    with shuffles_go(df.sparkSession):
        gone, repeated = near_duplicate_rows(df, id_col, text_col, similarity)
    kept = without(df, gone, F.col(f"`{id_col}`").cast("long"), hashed)
    if not repeated:
        return kept
    own_h = unused(df, "own_h")
    return kept.withColumn(own_h, hashed).dropDuplicates([id_col, own_h]).drop(own_h)


def without(df: DataFrame, gone: DataFrame, doc_id: Column, h: Column) -> DataFrame:
    """The rows of df whose (doc_id, h) is not in gone(doc_id, h).

    A map of MAP_BITS bits in words of 64 goes to all rows; only those that it can't tell from gone ones are sent to meet these.
    """
    names = own_id, own_h, own_word, own_bits = [unused(df, n) for n in ("own_id", "own_h", "own_word", "own_bits")]
    place = lambda *key: F.pmod(F.xxhash64(*key), F.lit(MAP_BITS))
    words = gone.select(place("doc_id", "h").alias("p")).groupBy(F.shiftright("p", 6).alias(own_word)).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias(own_bits))
    keyed = df.withColumns({own_id: doc_id, own_h: h}).withColumn(own_word, F.shiftright(place(own_id, own_h), 6))
    marked = keyed.join(F.broadcast(words), own_word, "left")
    own_bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({own_id}, {own_h}), 64) as int))")
    there = F.coalesce(F.col(own_bits).bitwiseAND(own_bit), F.lit(0)) != 0
    again = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    met = marked.where(there).join(again, F.col(own_id).eqNullSafe(F.col("gone_id")) & (F.col(own_h) == F.col("gone_h")), "left_anti")
    return marked.where(~there).union(met).drop(*names)


def near_duplicate_rows(df: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, bool]:
    """(doc_id, h) of the rows that go, h hashing the text, and whether an id has a text twice."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("maps", pa.binary()), ("keys", pa.binary())])
    docs = documents_of(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    texts = docs.select("h", "text")
    order = common_grams(texts)
    common = df.sparkSession.sparkContext.broadcast(order)

    def described(doc_id: int | None, text: str, h: int) -> tuple:
        hashes = shingle_hashes(text, SIMILAR_WIDTH)
        grams = gram_set(hashes)
        return doc_id, h, *node_of(grams.tobytes()), len(grams), fingerprint_of(hashes), parities(grams), prefix(grams, *common.value, similarity).tobytes()

    def run(parts):
        for part in parts:
            yield from batches(schema, (described(*r) for r in zip(*(c.to_pylist() for c in part.columns))), 1024)

    rows = checkpointed(docs.mapInArrow(run, "doc_id long, h long, node long, other long, size long, fp long, maps binary, keys binary"))
    fresh = None
    for _ in range(MENDS):
        hot = crowded(rows, None if fresh is None else shingle_map(fresh))
        if not len(hot[0]):
            break
        order = raised(order, hot)
        fresh, rows = reordered(rows, texts, order, hot[0], similarity)
    clashes = rows.groupBy("node").agg(F.min("other").alias("least_other"), F.max("other").alias("last")).where("least_other < last").select("node", "least_other")
    rows = told_apart(rows, clashes)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    nodes = checkpointed(rows.groupBy("node").agg(least.alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("maps").alias("maps")))
    roots = similar_roots(rows, texts, nodes.select("node", F.col("least.h").alias("h"), "fp", "size", "maps"), clashes, similarity)
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("own_id"), F.col("least.h").alias("own_h"))
    ids = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    gone = ids.join(stay, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left_anti").select("doc_id", "h")
    return checkpointed(gone), (ids.agg(F.max("n").alias("n")).first()["n"] or 0) > 1


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
