"""Packing documents into training sequences with an order-preserving dynamic program.

The token stream of a scan partition keeps the order of its rows. A sequence may end after a document, after a
sentence, or, inside a sentence longer than a window, at a forced cut. The program chooses the ends that minimise
padding plus a penalty per cut inside a document; the best start of a window that ends at a boundary is the head of
a queue of boundaries whose keys rise, so a transition costs amortised constant time.

Nothing is shuffled: a partition streams through its own program in blocks of bounded size, and what remains of a
block after its last good cut is carried into the next one.
"""

from __future__ import annotations

import codecs
import os
import re
import string
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents_of, table, to_batch

WINDOW = 4096
END_OF_DOCUMENT = 2
#: Penalties, in tokens of padding: for a cut after a sentence inside a document, and for one inside a sentence.
SENTENCE_PENALTY = 4.0
FORCED_PENALTY = 64.0
#: Distance of the forced cuts that a sentence longer than a window gets.
FORCED_STEP = 64
#: Tokens that are planned at once; the memory of a task follows this and its longest document.
BLOCK_TOKENS = 1 << 20
#: Words whose ids a worker remembers, and as many pieces of words.
CACHE_WORDS = 400_000
#: Documents that are encoded together.
DOCUMENTS_AT_ONCE = 256
#: ASCII marks, and lines that are empty or not of Latin letters only.
MARKS = string.punctuation
LETTERS = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
NO_WORD = re.compile(rf"^(?:[{LETTERS}]*+[^{LETTERS}\n].*|)$", re.MULTILINE)
#: Words on which the way through the tokenizer and that straight to its model must agree.
TRIAL = ("the", "The", "qzxv", "supercalifragilistic", "A", "HtTp", "onenthsh", "Éçouç", "straße", "Žluťoučký", "ªµº", "ĦŁŋſ")

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)
DDL = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


def remembered(known: dict[str, bytes], wanted: set[str], made) -> dict[str, bytes]:
    """known with all that is wanted; what is known and not wanted goes where these would be more than CACHE_WORDS."""
    fresh = wanted.difference(known)
    if len(known) + len(fresh) > CACHE_WORDS:
        known = {x: known[x] for x in wanted.difference(fresh)}
    for x in fresh:
        known[x] = made(x)
    return known


class WordEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of texts under a tokenizer to which white space is a hard border.

    Text between two blanks is encoded once and remembered, as the tokenizer never looks across white space. New words
    of Latin letters, with ASCII marks after them, are two pieces to the tokenizer. These letters go straight to its model
    if a trial at the start shows that the way there only lowers their case and writes bytes as characters; everything
    else goes through the tokenizer. Letters are remembered without the marks and the case, as many words share them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        tokens = self.tokenizer.get_vocab()
        size = max(tokens.values()) + 1
        self.bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.ends = np.zeros(size, bool)
        for token, i in tokens.items():
            self.ends[i] = re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*", token.removesuffix("</w>")) is not None
        # what a byte-level vocabulary writes for a byte: printable ones as they are, the others as the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        characters = {b: chr(256 + k) for k, b in enumerate(hidden)}
        # lines of letters stay lines
        self.characters = "".join([chr(b) if b == 10 else characters.get(b, chr(b)) for b in range(256)])
        self.direct = all(self.letters(w) == self.whole(w) for w in TRIAL)

    def lowered(self, words: list[str]) -> list[str]:
        """Words of letters as the model gets them."""
        return codecs.charmap_decode("\n".join(words).lower().encode(), "strict", self.characters)[0].split("\n")

    def letters(self, word: str) -> bytes:
        return b"".join([self.bytes[t.id] for t in self.tokenizer.model.tokenize(self.lowered([word])[0])])

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, fresh: list[str]) -> None:
        table, tokenize, odd = self.bytes, self.tokenizer.model.tokenize, fresh
        if self.direct:
            letters = [w.rstrip(MARKS) for w in fresh]
            tails = [w[len(x) :] for w, x in zip(fresh, letters)]
            others = set(NO_WORD.findall("\n".join(letters)))
            odd = [w for w, x in zip(fresh, letters) if x in others] if others else []
            letters = self.lowered(letters)
            self.stems = remembered(self.stems, set(letters), lambda x: b"".join([table[t.id] for t in tokenize(x)]))
            self.tails = remembered(self.tails, set(tails), self.whole)
            self.words.update(zip(fresh, map(bytes.__add__, map(self.stems.__getitem__, letters), map(self.tails.__getitem__, tails))))
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Workers live on between tasks; what they remember should not."""
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        distinct = set().union(*split)
        fresh = distinct.difference(self.words)
        if len(self.words) + len(fresh) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in distinct.difference(fresh)}
        if fresh:
            self.learn(list(fresh))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def padded(n: int, window: int) -> int:
    """Length that a sequence of n tokens is padded to: itself at a power of two, else the window."""
    return n if n & (n - 1) == 0 else window


def plan_cuts(position: np.ndarray, penalty: np.ndarray, window: int, close: bool) -> list[int]:
    """Indices of the boundaries at which sequences end, in order.

    position rises from 0, with steps of at most `window`; penalty[i] is what a cut at boundary i costs. close: the
    last boundary must be a cut; otherwise the tokens after the last cut, fewer than a window, are left for later.
    """
    n = len(position)
    at, cost = position.tolist(), penalty.tolist()
    number = np.full(at[-1] + 1, -1, np.int32)
    number[position] = np.arange(n)
    ends, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # of sequences that need no padding
    for p in [1 << k for k in range(window.bit_length()) if 1 << k < window]:
        found = number[np.maximum(position - p, 0)]
        ends.append(np.flatnonzero((position >= p) & (found >= 0)))
        starts.append(found[ends[-1]])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    exact = starts[np.argsort(ends, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(ends, minlength=n)).tolist()
    best, back = [0.0] * n, [-1] * n
    queue, keys, head, e = [0], [0.0], 0, 0  # boundaries, and what each adds to the cost of a window that starts there; those before head are too far back
    for j in range(1, n):
        here = at[j]
        least = here - window
        while at[queue[head]] < least:
            head += 1
        i, value = queue[head], keys[head] - least
        if e < upto[j]:
            for k in exact[e : upto[j]]:
                if best[k] < value:
                    value, i = best[k], k
            e = upto[j]
        value += cost[j]
        best[j], back[j] = value, i
        value += here
        while len(keys) > head and keys[-1] >= value:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(value)
    if close:
        j = n - 1
    else:
        first = int(np.searchsorted(position, at[-1] - window, side="right"))
        j = min(range(max(first, 0), n), key=lambda x: (best[x], -at[x]))
    cuts = []
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def split_tail(n: int, window: int, forced: float) -> list[int]:
    """Lengths of the sequences for the last n tokens of a partition: one, or powers of two where cuts cost less than padding."""
    parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    return parts if forced * (len(parts) - 1) < padded(n, window) - n else [n]


def boundaries(starts: np.ndarray, ends: np.ndarray, total: int, window: int, sentence: float, forced: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties: 0, the document starts, the sentence ends, forced cuts in longer gaps, and the total."""
    free = np.unique(np.concatenate([[0], starts[(starts > 0) & (starts < total)], [total]]))
    inner = np.setdiff1d(ends[(ends > 0) & (ends < total)], free)
    place = np.concatenate([free, inner])
    price = np.concatenate([np.zeros(len(free)), np.full(len(inner), sentence)])
    order = np.argsort(place, kind="stable")
    place, price = place[order], price[order]
    wide = np.flatnonzero(np.diff(place) > window)
    if len(wide):
        more = np.concatenate([np.arange(place[i] + FORCED_STEP, place[i + 1], FORCED_STEP) for i in wide])
        place, price = np.concatenate([place, more]), np.concatenate([price, np.full(len(more), forced)])
        order = np.argsort(place, kind="stable")
        place, price = place[order], price[order]
    return place.astype(np.int64), price


class Packer:
    """The state of one partition: the tokens that no sequence holds yet, and the documents they belong to."""

    def __init__(self, first_sequence: int, ends: np.ndarray, window: int, sentence: float, forced: float):
        self.next, self.sentence_end, self.window, self.sentence, self.forced = first_sequence, ends, window, sentence, forced
        self.held: list[bytes] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens, where it starts; below 0 if a part is packed already
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4, self.size))
        self.held.append(ids)
        self.size += len(ids) // 4

    def flush(self, close: bool) -> list[tuple]:
        if not self.size:
            return []
        data = b"".join(self.held)
        ids = np.frombuffer(data, "<u4")
        starts = np.array([s for _, _, s in self.docs], np.int64)
        ends = np.flatnonzero(self.sentence_end[ids]) + 1
        place, price = boundaries(starts, ends, self.size, self.window, self.sentence, self.forced)
        cuts = [0, *place[plan_cuts(place, price, self.window, close)].tolist()]
        if close and len(cuts) > 1:
            at = cuts.pop(-2) if len(cuts) > 2 else 0
            cuts = [*cuts[:-1], at] if at else [0]
            for part in split_tail(self.size - at, self.window, self.forced):
                cuts.append(cuts[-1] + part)
        rows = []
        d = 0
        for a, b in pairwise(cuts):
            x = a
            while x < b:
                while self.docs[d][2] + self.docs[d][1] <= x:
                    d += 1
                doc_id, tokens, s = self.docs[d]
                y = min(b, s + tokens)
                rows.append((doc_id, x - s, tokens, self.next, x - a, b - a, data[4 * x : 4 * y]))
                x = y
            self.next += 1
        done = cuts[-1]
        self.docs = [(i, n, s - done) for i, n, s in self.docs if s + n > done]
        self.held, self.size = [data[4 * done :]], self.size - done
        return rows


def pack(
    df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", order_by: list[str] | None = None, window: int = WINDOW, end_id: int = END_OF_DOCUMENT,
    sentence_penalty: float = SENTENCE_PENALTY, forced_penalty: float = FORCED_PENALTY, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, doc_tokens, sequence_id, offset, sequence_tokens, ids.

    tokenizer: path, on every executor, of a tokenizers file to which white space is a hard border. A document is its
    ids and end_id. ids are little-endian unsigned 32-bit integers. order_by: columns to range-partition and sort by
    first; without it rows stay where and in the order in which they are read, which moves no text.

    Null texts count as empty (one token, end_id); null ids and repeated ids are documents of their own; a document
    longer than the window gets several pieces; an empty table gives no rows; other columns are not read.
    """
    docs = documents_of(df, id_col, text_col)
    if order_by:
        docs = documents_of(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by), id_col, text_col)

    def run(parts):
        words, last = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        ends = words.ends.copy()
        if end_id < len(ends):
            ends[end_id] = True
        packer = Packer(TaskContext.get().partitionId() << 40, ends, window, sentence_penalty, forced_penalty)
        for part in parts:
            for a in range(0, part.num_rows, DOCUMENTS_AT_ONCE):
                piece = part.slice(a, DOCUMENTS_AT_ONCE)
                for doc_id, ids in zip(piece.column(0).to_pylist(), words.encode_all(piece.column(1).to_pylist())):
                    packer.add(doc_id, ids + last)
                    if packer.size >= block_tokens:
                        yield to_batch(SCHEMA, packer.flush(False))
        while packer.size:
            if rows := packer.flush(True):
                yield to_batch(SCHEMA, rows)
        words.forget()

    return docs.mapInArrow(run, DDL)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Length and checksum of each piece in place of its ids."""
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens; the query adds the digests of the contract to the pieces."""
    import public_tokenizers

    return piece_digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
