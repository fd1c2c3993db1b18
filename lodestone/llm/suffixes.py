"""Exact substring deduplication over bytes, by sorted suffixes.

Every window of WINDOW bytes picks an anchor: of the k-grams in it, the leftmost with the lowest hash. Equal windows
pick equal anchors at equal places, so only windows under one anchor can be equal. Consecutive windows with one anchor
are a stretch: at most ANCHORS windows, and the bytes they cover.

1. Documents are dealt into blocks of bounded size. Every block tells which anchors it has, as 32-bit hashes; a bucket
   of anchors answers which of them more than one document has. False matches only cost work.
2. A block sends its stretches with such anchors, equal ones once, with the smallest and the largest document id.
3. A bucket finds for each window the smallest id among the equal windows. Its suffixes are merge-sorted among those that
   have the same anchor at the same place; a stretch that is alone under its anchor has nothing to be sorted with. Two suffixes are compared by
   the length of their common extension, found by binary search over prefix polynomial hashes; neighbours that the
   hashes call equal are compared byte by byte before they count as equal.
4. A block marks the windows whose smallest id is smaller than their own document's, and cuts out what they cover.

What is sent is a minimum per distinct stretch and block, so no key gathers the rows of a hot passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents_of, table

WINDOW = 50
GRAM = 20
ANCHORS = WINDOW - GRAM + 1
#: Bytes of text of a block, and anchors of a bucket, on average.
BLOCK_BYTES, BUCKET_ANCHORS = 2 << 20, 1 << 20
#: Windows whose anchors are found at once.
PIECE = 1 << 18

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE = np.uint64((1 << 20) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the k-gram at each place, of the two words of eight bytes at its start and the one at its end."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    return mixed(word[:n] * _ODD[0] + mixed(word[8 : n + 8]) * _ODD[1] + word[12 : n + 12] * _ODD[2])


def gram_hashes_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """gram_hashes at some places; words: eight bytes from each place, the first one lowest."""
    return mixed(words[at] * _ODD[0] + mixed(words[at + 8]) * _ODD[1] + words[at + 12] * _ODD[2])


def content_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch's bytes, wherever they stand."""
    return Prefixes(data).of(first, first + size) + size.astype(np.uint64)


class Stretches:
    """Stretches of a buffer of documents: first and last window, anchor's position, document number, anchor's hash."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """ends: where each document ends; windows never cross it."""
        parts = [self.piece(data, a, min(a + PIECE, len(data) - WINDOW + 1)) for a in range(0, max(0, len(data) - WINDOW + 1), PIECE)]
        cat = lambda k, kind: np.concatenate([p[k] for p in parts] or [np.zeros(0, kind)])
        first, last, anchor, self.key = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64), cat(3, np.uint64)
        # cut the stretches at the windows that would cross a document's end
        doc = np.searchsorted(ends, first, side="right")
        keep = np.ones(len(first), bool)
        more = []
        limit = ends[np.minimum(doc, len(ends) - 1)] - WINDOW if len(ends) else first
        for i in np.flatnonzero(last > limit).tolist():
            a, b, d = int(first[i]), int(last[i]), int(doc[i])
            keep[i] = False
            while a <= b:
                stop = min(b, int(ends[d]) - WINDOW)
                if stop >= a:
                    more.append((a, stop, anchor[i], d, self.key[i]))
                a, d = max(a, int(ends[d])), d + 1
        self.first, self.last, self.anchor, self.doc = (x[keep] for x in (first, last, anchor, doc))
        self.key = self.key[keep]
        if more:
            self.first, self.last, self.anchor, self.doc = (np.append(x, [m[k] for m in more]).astype(np.int64) for k, x in enumerate((self.first, self.last, self.anchor, self.doc)))
            self.key = np.append(self.key, np.array([m[4] for m in more], np.uint64))

    @staticmethod
    def piece(data: np.ndarray, a: int, b: int):
        key = gram_hashes(data[a : b + WINDOW - 1])
        n = len(key)
        low = (key & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= ANCHORS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < ANCHORS:
            low = np.minimum(low[: n - ANCHORS + 1], low[ANCHORS - width : n - width + 1])
        at = (low & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.append(0, cut), np.append(cut, len(at)) - 1
        return first + a, last + a, at[first] + a, key[at[first]]

    def only(self, keep: np.ndarray) -> Stretches:
        out = object.__new__(Stretches)
        for name in ("first", "last", "anchor", "doc", "key"):
            setattr(out, name, getattr(self, name)[keep])
        return out


class Prefixes:
    """Prefix polynomial hashes of a buffer, modulo 2^64 over random values of the bytes; of(a, b) hashes bytes a to b."""

    R = pow(0xD1342543DE82EF95, 1, 1 << 64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, np.uint64(self.R))
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, np.uint64(pow(self.R, -1, 1 << 64)))
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        value = np.random.default_rng(5).integers(1, 1 << 64, 256, np.uint64)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data] * self.power[:n], out=self.sum[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sum[b] - self.sum[a]) * self.inverse[a]


class SuffixSorter:
    """Sorts suffixes of a buffer by their first WINDOW bytes, segment by segment."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        self.hash = Prefixes(self.data)
        #: Eight bytes from each place, the first one highest, so that words are ordered as their bytes are.
        self.head = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,)).astype(np.uint64)

    def same_hash(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether windows have equal hashes."""
        return self.hash.of(x, x + WINDOW) == self.hash.of(y, y + WINDOW)

    def extension(self, x: np.ndarray, y: np.ndarray, least: int = 0) -> np.ndarray:
        """Length of the common extension of suffixes, WINDOW at most: binary search over equal hashes of prefixes.

        least: so many bytes are known to be equal.
        """
        total = self.hash.sum
        before_x, before_y, scale_x, scale_y = total[x], total[y], self.hash.inverse[x], self.hash.inverse[y]
        same = lambda n: (total[x + n] - before_x) * scale_x == (total[y + n] - before_y) * scale_y
        whole = same(WINDOW)
        low = np.where(whole, WINDOW, least)
        some = np.flatnonzero(~whole)
        x, y, before_x, before_y, scale_x, scale_y = (v[some] for v in (x, y, before_x, before_y, scale_x, scale_y))
        a, b = np.full(len(some), least), np.full(len(some), WINDOW)
        while (b - a > 1).any():
            middle = (a + b) // 2
            equal = same(middle)
            a, b = np.where(equal, middle, a), np.where(equal, b, middle)
        low[some] = a
        return low

    def before(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix x stands before y; `equal` where their windows are equal. Words that differ decide at once."""
        first, second = self.head[x], self.head[y]
        out = first < second
        tied = np.flatnonzero(first == second)
        x, y = x[tied], y[tied]
        n = self.extension(x, y, 8)
        at = np.minimum(n, WINDOW - 1)
        out[tied] = np.where(n >= WINDOW, equal[tied], self.data[x + at] < self.data[y + at])
        return out

    def sort(self, suffix: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """suffix with each of its segments (start, length per element) sorted: bottom-up merges of all segments at once.

        An element moves to its place in its own run plus its rank in the run that it is merged with.
        """
        suffix, n = suffix.copy(), len(suffix)
        width = 1
        active = np.flatnonzero(length > 1)
        while len(active):
            own = active - start[active]
            pair = own // (2 * width) * (2 * width)
            right = own - pair >= width
            low = start[active] + np.where(right, pair, pair + width)
            high = start[active] + np.minimum(np.where(right, pair + width, pair + 2 * width), length[active])
            low = np.minimum(low, high)
            first = low.copy()
            mine = suffix[active]
            while len(some := np.flatnonzero(low < high)):
                middle = (low[some] + high[some]) // 2
                # equal ones of the left run stay before those of the right run
                ahead = self.before(suffix[middle], mine[some], right[some])
                low[some] = np.where(ahead, middle + 1, low[some])
                high[some] = np.where(ahead, high[some], middle)
            base = start[active] + pair + np.where(right, own - pair - width, own - pair)
            moved = suffix.copy()
            moved[base + low - first] = mine
            suffix, width = moved, 2 * width
            active = active[length[active] > width]
        return suffix

    def same_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            out &= self.head[x + k] == self.head[y + k]
        return out


def smallest_of_windows(sorter: SuffixSorter, suffix: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each suffix, the smallest `least` among those with an equal window in its group."""
    order = np.argsort(group, kind="stable")
    s, g = suffix[order], group[order]
    new = np.append(True, g[1:] != g[:-1])
    number = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(s)))
    place = np.argsort(s, kind="stable")  # to find an element again after the sort
    ranked = sorter.sort(s, starts[number], length[number])
    moved = order[place[np.searchsorted(s[place], ranked)]]
    equal = np.zeros(len(s), bool)
    inside = np.flatnonzero(~new)
    close = inside[sorter.same_hash(ranked[inside - 1], ranked[inside])]
    equal[close] = sorter.same_bytes(ranked[close - 1], ranked[close])
    run = np.flatnonzero(~equal)
    out = np.empty(len(s), least.dtype)
    out[moved] = np.repeat(np.minimum.reduceat(least[moved], run), np.diff(np.append(run, len(s))))
    return out


def buffer_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each ends."""
    chunks = [c.cast(pa.large_binary()) for c in texts.chunks]
    parts, ends, total = [], [], 0
    for c in chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
        ends.append(offsets[1:] - offsets[0] + total)
        total += len(parts[-1])
    return (np.concatenate(parts), np.concatenate(ends)) if parts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))


def blobs(arrays: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def split_by(number: np.ndarray):
    """(value, places) of each distinct value."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(number[places[0]]), places


def anchors_of_block(docs: pa.Table, buckets: int) -> pa.Table:
    """Step 1: the block's anchors per bucket, each once, and whether two of its documents have it."""
    block = docs["block"][0].as_py()
    data, ends = buffer_of(docs["text"])
    ids = docs["doc_id"].to_numpy(zero_copy_only=False)
    found = Stretches(data, ends)
    order = np.lexsort((ids[found.doc], found.key))
    key, doc = found.key[order], ids[found.doc][order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    several = doc[start] != doc[np.append(start[1:], len(key)) - 1] if len(start) else np.zeros(0, bool)
    rows = [(block, b, *blobs([key[start[p]].astype(np.uint32), several[p].astype(np.uint8)])) for b, p in split_by(bucket_of(key[start], buckets))]
    return table_of(rows, "block:i bucket:i hashes:b several:b")


def table_of(rows: list[tuple], columns: str) -> pa.Table:
    fields = [c.split(":") for c in columns.split()]
    schema = pa.schema([(n, pa.int64() if k == "i" else pa.binary()) for n, k in fields])
    data = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, f.type) for c, f in zip(data, schema)], schema=schema)


def ddl_of(columns: str) -> str:
    return ", ".join(f"{n} {'long' if k == 'i' else 'binary'}" for n, k in (c.split(":") for c in columns.split()))


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of all rows in one, and the row that each element is of."""
    parts = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(np.arange(len(parts)), list(map(len, parts)))


def repeated_anchors(rows: pa.Table) -> pa.Table:
    """Step 1, answer: per block, those of its anchors that another block has too, or two of its own documents."""
    hashes, row = joined(rows["hashes"], np.uint32)
    several, _ = joined(rows["several"], np.uint8)
    order = np.argsort(hashes, kind="stable")
    h, more = hashes[order], several[order] > 0
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    length = np.diff(np.append(start, len(h)))
    keep = np.repeat((length > 1) | np.logical_or.reduceat(more, start), length)
    chosen = np.sort(order[keep])
    block, bucket = rows["block"].to_numpy(), rows["bucket"].to_numpy()
    out = [(int(block[r]), int(bucket[r]), hashes[chosen[p]].tobytes()) for r, p in split_by(row[chosen])]
    return table_of(out, "block:i bucket:i hashes:b")


def hash_set(rows: pa.Table) -> np.ndarray:
    """Sorted (bucket, 32-bit hash) of a block's repeated anchors, as one number each."""
    parts = [np.uint64(b << 32) | np.frombuffer(h, np.uint32).astype(np.uint64) for b, h in zip(rows["bucket"].to_pylist(), rows["hashes"].to_pylist())]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def members(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def stretch_bytes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    start = np.repeat(first - (np.cumsum(size) - size), size)
    return data[start + np.arange(size.sum())] if len(first) else data[:0]


def stretches_of_block(docs: pa.Table, repeated: pa.Table, buckets: int, fine: int) -> pa.Table:
    """Step 2: the block's distinct stretches with repeated anchors, for the buckets of step 3."""
    if not docs.num_rows or not repeated.num_rows:
        return table_of([], STRETCHES)
    block = docs["block"][0].as_py()
    data, ends = buffer_of(docs["text"])
    ids = docs["doc_id"].to_numpy(zero_copy_only=False)
    found = Stretches(data, ends)
    found = found.only(members(hash_set(repeated), (bucket_of(found.key, buckets).astype(np.uint64) << np.uint64(32)) | (found.key & np.uint64(0xFFFFFFFF))))
    if not len(found.key):
        return table_of([], STRETCHES)
    size = found.last - found.first + WINDOW
    content = content_hashes(data, found.first, size)
    order = np.lexsort((content, found.key))
    key, content, first, size, doc = found.key[order], content[order], found.first[order], size[order], ids[found.doc[order]]
    offset = found.anchor[order] - first
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
    least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    key, first, size, offset = (x[start] for x in (key, first, size, offset))
    rows = []
    for b, p in split_by(bucket_of(key, fine)):
        packed = pa.compress(stretch_bytes(data, first[p], size[p]).tobytes(), codec="zstd", asbytes=True)
        rows.append((b, block, *blobs([least[p], most[p], offset[p].astype(np.uint8), size[p].astype(np.uint8)]), packed))
    return table_of(rows, STRETCHES)


#: Both hashes of a stretch follow from its bytes, so that these alone are sent.
STRETCHES = "bucket:i block:i least:b most:b offset:b size:b bytes:b"
MARKS = "block:i key:b content:b first:b last:b least:b"


def marks_of_bucket(rows: pa.Table) -> pa.Table:
    """Step 3: for each block the runs of windows of its stretches that a document with a smaller id has, with that id."""
    least, row = joined(rows["least"], np.int64)
    most, _ = joined(rows["most"], np.int64)
    offset = joined(rows["offset"], np.uint8)[0].astype(np.int64)
    size = joined(rows["size"], np.uint8)[0].astype(np.int64)
    total = np.bincount(row, size, rows.num_rows).astype(np.int64).tolist()
    data = np.frombuffer(b"".join([pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(rows["bytes"].to_pylist(), total)]), np.uint8)
    at = np.cumsum(size) - size
    sorter = SuffixSorter(data)
    key, content = gram_hashes_at(sorter.head.byteswap(), at + offset), sorter.hash.of(at, at + size) + size.astype(np.uint64)
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, c[1:] != c[:-1])
    check(sorter.head, at[order], size[order], new)
    start = np.flatnonzero(new)
    number = np.cumsum(new) - 1  # of the distinct stretch, in the sorted order
    head = order[start]
    smallest = np.minimum.reduceat(least[order], start)
    anchor = np.cumsum(new_key)[start] - 1
    alone = np.bincount(anchor)[anchor] == 1
    windows = size[head] - WINDOW + 1
    # all windows of the stretches whose anchor has others too
    wide = np.flatnonzero(~alone)
    count = windows[wide]
    owner = np.repeat(wide, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if len(owner):
        group = anchor[owner] * (WINDOW + 1) + offset[head[owner]] - place
        value = smallest_of_windows(sorter, at[head[owner]] + place, group, smallest[owner])
        cut = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
        begin = np.flatnonzero(cut)
        run_owner, run_value, run_first = owner[begin], value[begin], place[begin]
        run_last = place[np.append(begin[1:], len(owner)) - 1]
    else:
        run_owner = run_value = run_first = run_last = np.zeros(0, np.int64)
    single = np.flatnonzero(alone)
    run_owner, run_value = np.append(run_owner, single), np.append(run_value, smallest[single])
    run_first, run_last = np.append(run_first, np.zeros(len(single), np.int64)), np.append(run_last, windows[single] - 1)
    # every block's copy of a stretch gets the stretch's runs
    by_owner = np.argsort(run_owner, kind="stable")
    lower = np.searchsorted(run_owner[by_owner], number, "left")
    n = np.searchsorted(run_owner[by_owner], number, "right") - lower
    copy = np.repeat(np.arange(len(order)), n)
    run = by_owner[np.repeat(lower - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    source = order[copy]
    keep = run_value[run] < most[source]
    source, run = source[keep], run[keep]
    block = rows["block"].to_numpy()[row[source]]
    out = [(b, *blobs([key[source[p]], content[source[p]], run_first[run[p]].astype(np.uint8), run_last[run[p]].astype(np.uint8), run_value[run[p]]])) for b, p in split_by(block)]
    return table_of(out, MARKS)


def check(words: np.ndarray, at: np.ndarray, size: np.ndarray, new: np.ndarray) -> None:
    """Stretches that count as equal must be so byte by byte; a collision of both 64-bit hashes stops the job.

    words: eight bytes from each place. A stretch has WINDOW bytes at least, so that its last word is inside it.
    """
    again = np.flatnonzero(~new)
    if not len(again):
        return
    x, y, n = at[again], at[again - 1], size[again]
    same = (n == size[again - 1]) & (words[x + n - 8] == words[y + n - 8])
    for k in range(0, int(size.max()) - 7, 8):
        some = np.flatnonzero(n >= k + 8)
        same[some] &= words[x[some] + k] == words[np.minimum(y[some] + k, len(words) - 1)]
    if not same.all():
        raise ArithmeticError("two different stretches have equal hashes; choose another multiplier for the prefix hashes")


def cut_block(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Step 4: each document's kept bytes, with the removed bytes and runs."""
    data, ends = buffer_of(docs["text"])
    ids = docs["doc_id"].to_numpy(zero_copy_only=False) if docs.num_rows else np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    if marks.num_rows and docs.num_rows:
        key, content, least = (joined(marks[c], kind)[0] for c, kind in (("key", np.uint64), ("content", np.uint64), ("least", np.int64)))
        first, last = (joined(marks[c], np.uint8)[0].astype(np.int64) for c in ("first", "last"))
        order = np.lexsort((content, key))
        key, content, least, first, last = (x[order] for x in (key, content, least, first, last))
        found = Stretches(data, ends)
        found = found.only(members(np.unique(key), found.key))
        if len(found.key):
            own = content_hashes(data, found.first, found.last - found.first + WINDOW)
            pair = np.unique(np.stack([key, content], 1).view([("k", np.uint64), ("c", np.uint64)]).reshape(-1))
            wanted = np.stack([found.key, own], 1).view([("k", np.uint64), ("c", np.uint64)]).reshape(-1)
            # number the distinct pairs, then join the runs to the stretches by number
            table_number = np.searchsorted(pair, np.stack([key, content], 1).view(pair.dtype).reshape(-1))
            at = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
            at = np.where(pair[at] == wanted, at, -1)
            lower, upper = np.searchsorted(table_number, at, "left"), np.searchsorted(table_number, at, "right")
            n = np.where(at >= 0, upper - lower, 0)
            source = np.repeat(np.arange(len(at)), n)
            run = np.repeat(lower - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keep = least[run] < ids[found.doc[source]]
            source, run = source[keep], run[keep]
            np.add.at(edge, found.first[source] + first[run], 1)
            np.add.at(edge, found.first[source] + last[run] + WINDOW, -1)
    removed = np.cumsum(edge[:-1]) > 0
    rows, a = [], 0
    for doc_id, b in zip(ids.tolist(), ends.tolist()):
        gone = removed[a:b]
        n = int(gone.sum())
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
        rows.append((doc_id, b - a, n, spans, data[a:b][~gone].tobytes() if n else data[a:b].tobytes()))
        a = b
    return table_of(rows, RESULT)


RESULT = "doc_id:i n_bytes:i n_removed:i n_spans:i kept:b"


def substring_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: kept are the UTF-8 bytes that no string of WINDOW bytes covers
    that also starts in a row with a smaller id; n_spans counts the maximal removed runs.

    Null texts are empty. Rows with equal ids don't cut each other; rows with a null id neither cut nor are cut. Texts
    shorter than the window stay whole; no rows give no rows. Only the two columns are read.
    """
    docs = documents_of(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(64, -(-total // BLOCK_BYTES))
    buckets = max(8, total // 16 // BUCKET_ANCHORS)
    fine = max(32, 4 * buckets)
    known = docs.where("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    first = known.groupBy("block").applyInArrow(lambda t: anchors_of_block(t, buckets), ddl_of("block:i bucket:i hashes:b several:b"))
    repeated = first.groupBy("bucket").applyInArrow(repeated_anchors, ddl_of("block:i bucket:i hashes:b"))
    stretches = known.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda a, b: stretches_of_block(a, b, buckets, fine), ddl_of(STRETCHES))
    marks = stretches.groupBy("bucket").applyInArrow(marks_of_bucket, ddl_of(MARKS))
    cut = known.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut_block, ddl_of(RESULT))
    none = docs.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"))
    return cut.union(none)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document; the query adds the digest of the contract."""
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
