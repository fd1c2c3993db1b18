"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input is an embedding of the word plus the mean embedding of its character n-grams, so that a word never seen
in training is judged by its spelling. The network reads windows of words that overlap and cover the whole text. It
starts from chance and learns from all windows of the labelled texts, each with its text's label. A text's score weighs
its windows by attention: their strongest, their soft maximum and how many are suspicious. Words repeat, so a worker
remembers the input gates of each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents_of, table
from lodestone.llm.labelled import PER_CLASS, labelled_sample, remainder

WORD = re.compile(r"\w+")
LENGTH, STRIDE = 32, 24
SIZE, HIDDEN = 24, 12
WORD_ROWS, GRAM_ROWS = 1 << 17, 1 << 16
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
CACHE_WORDS = 120_000
#: Words of texts that are scored at once.
PIECE = 1 << 17
#: Characters of the longest word that is read in one piece.
LONG = 48
#: Texts of the sample in which a word, or an n-gram, must occur to be told apart from others.
WORD_TEXTS, GRAM_TEXTS = 8, 4
#: Every so many texts of the sample only calibrate the score.
CALIBRATE = 5
#: Windows of a training step, fewer of a small sample; rounds over all windows, more of them where that makes fewer steps;
#: step lengths of the embeddings and of the other parameters.
BATCH, EPOCHS, LEAST_STEPS, EMBEDDING_STEP, STEP = 512, 5, 400, 0.1, 0.01

#: Share of words whose own embedding, and of those whose n-grams, a step hides, so that the network learns to read unknown ones.
HIDE = 0.3
#: Share of the rounds without attention, and the least weight of a window that is worth a step.
WARM, LEAST = 0.25, 0.01

_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def words_of(text: str) -> list[str]:
    """The words of a text; one longer than LONG comes as pieces of LONG characters at most that overlap by half."""
    words = WORD.findall(text.lower())
    if not words or len(max(words, key=len)) <= LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - LONG // 2, LONG // 2)])]


def word_rows(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words), np.int64, len(words))


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character n-grams, 3 to 5 long, of words in angle brackets, and where each word's end; every word has one."""
    text = "<" + "><".join(words) + ">"
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code))
    key = code * _ODD[0] + np.uint32(1)
    rows, owners = [], []
    for n in range(2, 6):
        key = key[: len(code) - n + 1]
        key = (key ^ (key >> np.uint32(15))) * _ODD[1] + code[n - 1 :] * _ODD[n - 1]
        if n > 2:
            whole = np.flatnonzero(at[: len(key)] + n <= end[: len(key)])
            rows.append((key[whole] ^ (key[whole] >> np.uint32(13))) * _ODD[2] >> np.uint32(16))
            owners.append(owner[whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])
    return np.concatenate(rows)[order].astype(np.int64), cuts


def window_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window of texts with so many words, which stand in one row of words.

    A text's windows start every STRIDE words, as far as there are words not yet covered; a text without words has none.
    """
    n = np.where(counts > LENGTH, -(-(counts - LENGTH) // STRIDE) + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.cumsum(counts) - counts
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, begin[text] + start, np.minimum(LENGTH, counts[text] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters of both directions, of the attention, and of the output; forward and backward passes."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": f(SIZE, 3 * HIDDEN), f"B{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": f(HIDDEN, 3 * HIDDEN)}
        self.p |= {"A": f(2 * HIDDEN, 1)[:, 0], "O": f(2 * HIDDEN, 1)[:, 0], "C": np.zeros(1, np.float32)}
        self.words = (0.1 * r.standard_normal((WORD_ROWS, SIZE))).astype(np.float32)
        self.grams = (0.1 * r.standard_normal((GRAM_ROWS, SIZE))).astype(np.float32)
        self.words[0] = self.grams[0] = 0
        # words and n-grams that fewer texts have are all read as one
        self.known_words, self.known_grams = np.zeros(WORD_ROWS, bool), np.zeros(GRAM_ROWS, bool)
        self.weights, self.shift, self.empty = np.zeros(FEATURES), 0.0, 0.0

    def vectors(self, rows: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Word inputs; grams[cuts[i]:cuts[i + 1]] belong to word i."""
        rows, grams = self.familiar(rows, grams)
        return self.words[rows] + np.add.reduceat(self.grams[grams], cuts[:-1], axis=0) / np.diff(cuts)[:, None].astype(np.float32)

    def familiar(self, rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.known_words[rows], rows, 0), np.where(self.known_grams[grams], grams, 0)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p[f"W{d}"] + self.p[f"B{d}"] for d in "fb"], axis=1)

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; index (windows, LENGTH) into gates. keep: also what the backward pass needs."""
        n, t_max = index.shape
        states = np.zeros((t_max, n, 2 * HIDDEN), np.float32)
        kept = {}
        for d, steps, at in (("f", range(t_max), 0), ("b", range(t_max - 1, -1, -1), 3 * HIDDEN)):
            u, h, trace = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32), []
            own = gates[:, at : at + 3 * HIDDEN]
            for t in steps:
                g, m = own[index[:, t]], h @ u
                rz = g[:, : 2 * HIDDEN] + m[:, : 2 * HIDDEN]
                np.exp(np.negative(rz, out=rz), out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                r, z, s = rz[:, :HIDDEN], rz[:, HIDDEN:], m[:, 2 * HIDDEN :]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * s)
                new = c + z * (h - c)
                new *= mask[:, t, None]
                if keep:
                    trace.append((t, h, r, z, s, c))
                h = new
                states[t, :, HIDDEN * (d == "b") : HIDDEN * (d == "b") + HIDDEN] = h
            kept[d] = trace
        score = states @ self.p["A"] + np.where(mask.T, 0, -1e4).astype(np.float32)
        score -= score.max(0)
        weight = np.exp(score)
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logit = pooled @ self.p["O"] + self.p["C"][0]
        return (logit, (states, weight, pooled, kept)) if keep else logit

    def backward(self, gradient: np.ndarray, index: np.ndarray, mask: np.ndarray, x: np.ndarray, cache) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the word inputs, from those of the logits."""
        states, weight, pooled, kept = cache
        g = {"O": pooled.T @ gradient, "C": np.array([gradient.sum()])}
        d_pooled = gradient[:, None] * self.p["O"]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["A"] = np.einsum("tn,tnd->d", d_score, states)
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["A"]
        d_in = np.zeros((*index.shape, SIZE), np.float32)
        for d in "fb":
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            d_u, d_w, d_b, d_h = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * HIDDEN, np.float32), 0.0
            for t, h, r, z, s, c in reversed(kept[d]):
                total = (d_states[t, :, HIDDEN * (d == "b") : HIDDEN * (d == "b") + HIDDEN] + d_h) * mask[:, t, None]
                d_c = total * (1 - z) * (1 - c * c)
                d_z = total * (h - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                pre = np.concatenate([d_r, d_z, d_c * r], axis=1)
                d_u += h.T @ pre
                d_h = total * z + pre @ u.T
                pre[:, 2 * HIDDEN :] = d_c
                d_w += x[index[:, t]].T @ pre
                d_b += pre.sum(0)
                d_in[:, t] += pre @ w.T
            g |= {f"U{d}": d_u, f"W{d}": d_w, f"B{d}": d_b}
        return g, sums_by(index.ravel(), d_in.reshape(-1, SIZE), len(x))


def sums_by(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values that have each of n numbers."""
    return np.stack([np.bincount(number, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


class Lexicon:
    """Rows of the distinct words of some texts, and every text's words as numbers in one row."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        counts, ids = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        self.counts, self.ids = np.array(counts, np.int64), np.concatenate(ids or [np.zeros(0, np.int32)])
        words = list(number)
        self.rows = word_rows(words).astype(np.int32)
        grams, self.cuts = gram_rows(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.grams = grams.astype(np.uint16)

    def familiar(self) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of words and of n-grams WORD_TEXTS and GRAM_TEXTS of the texts have."""
        words, grams = np.zeros(WORD_ROWS, np.int64), np.zeros(GRAM_ROWS, np.int64)
        ends = np.cumsum(self.counts)
        for a, b in zip((ends - self.counts).tolist(), ends.tolist()):
            rows, own, _ = self.flat(np.unique(self.ids[a:b]))
            words[np.unique(rows)] += 1
            grams[np.unique(own)] += 1
        return words >= WORD_TEXTS, grams >= GRAM_TEXTS

    def flat(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, n-gram rows, and where each word's n-grams end, of some words."""
        start, n = self.cuts[some], self.cuts[some + 1] - self.cuts[some]
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.rows[some].astype(np.int64), self.grams[place].astype(np.int64), np.append(0, np.cumsum(n))


def windows(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows' words, and which places of a window have one."""
    mask = np.arange(LENGTH) < size[:, None]
    return np.where(mask, ids[np.minimum(first[:, None] + np.arange(LENGTH), len(ids) - 1)], 0).astype(np.int64), mask


def fit(texts: list[str], labels: list[int], *, share: float | None = None, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network for the labels, whose score is THRESHOLD where either label is as likely.

    share: of ones among all labelled rows, where the sample has another. Fewer than one text of either class gives a
    network that scores every text alike.
    """
    net, y = Network(seed), np.array(labels, np.int64)
    here = float(y.mean()) if len(y) else 0.0
    share = here if share is None else share
    net.empty, net.shift = min(share, 0.5), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < here < 1:
        return net
    apart = np.zeros(len(y), bool)
    for k in (0, 1):
        apart[np.flatnonzero(y == k)[CALIBRATE - 1 :: CALIBRATE]] = True
    lexicon = Lexicon([t for t, a in zip(texts, apart) if not a])
    net.known_words, net.known_grams = lexicon.familiar()
    text, first, size = window_table(lexicon.counts)
    target = y[~apart][text].astype(np.float32)
    if len(set(target.tolist())) < 2:
        return net
    train(net, lexicon, (text, first, size), target, epochs, seed)
    found = Scorer(net).features(texts)
    known = np.isfinite(found[:, 0])
    some = known & (apart if len(set(y[apart & known].tolist())) == 2 else True)
    prior = np.where(y == 1, share / here, (1 - share) / (1 - here))
    net.weights, net.shift = logistic(found[some], y[some], prior[some])
    net.shift += float(np.log(THRESHOLD / (1 - THRESHOLD)))
    clean = known & (y == 0)
    if clean.any():
        net.empty = min(float(sigmoid(np.median(found[clean] @ net.weights) + net.shift)), 0.5)
    return net


def train(net: Network, lexicon: Lexicon, table: tuple[np.ndarray, ...], target: np.ndarray, epochs: int, seed: int) -> None:
    """Steps over all windows in a new order each round; Adam for the parameters, one adaptive step length for each embedding.

    In the first WARM share of the rounds a text's windows count alike, then by the attention that the network so far
    pays to them, so that a toxic text teaches by its toxic windows and a clean one by those most like toxic ones. Both
    classes count as much. What comes out is the mean of the networks after each round of the second half.
    """
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in "ms")
    seen_words, seen_grams, step = np.full(WORD_ROWS, 1e-6, np.float32), np.full(GRAM_ROWS, 1e-6, np.float32), 0
    rng = np.random.default_rng(seed)
    text, first, size = table
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    n = np.diff(np.append(starts, len(text)))
    batch = min(BATCH, max(32, len(target) // 40))
    epochs = max(epochs, LEAST_STEPS * batch // len(target))
    total, late, kept = epochs * -(-len(target) // batch), epochs // 2, 0
    sums = {k: np.zeros_like(v) for k, v in (net.p | {"words": net.words, "grams": net.grams}).items()}
    for epoch in range(epochs):
        if epoch < WARM * epochs:
            weight = np.repeat(1 / np.sqrt(n), n)
        else:
            used = np.arange(len(lexicon.rows))
            gates = np.concatenate([net.gates(net.vectors(*lexicon.flat(used[a : a + 8192]))) for a in range(0, len(used), 8192)])
            z = np.concatenate([net.forward(gates, *windows(lexicon.ids, first[a : a + 2048], size[a : a + 2048])) for a in range(0, len(text), 2048)])
            attention = np.exp(z - np.repeat(np.maximum.reduceat(z, starts), n))
            weight = attention / np.repeat(np.add.reduceat(attention, starts), n)
        weight *= len(target) / 2 / np.where(target > 0, weight[target > 0].sum(), weight[target == 0].sum())
        weight = weight.astype(np.float32)
        order = rng.permutation(np.flatnonzero(weight > LEAST))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            index, mask = windows(lexicon.ids, first[some], size[some])
            used, inverse = np.unique(index, return_inverse=True)
            rows, grams, cuts = lexicon.flat(used)
            rows, grams = net.familiar(rows, grams)
            hidden = rng.random((2, len(used))) < HIDE
            rows, grams = np.where(hidden[0], 0, rows), np.where(np.repeat(hidden[1], np.diff(cuts)), 0, grams)
            x, at = net.vectors(rows, grams, cuts), inverse.reshape(index.shape)
            logit, cache = net.forward(net.gates(x), at, mask, keep=True)
            gradient = ((sigmoid(logit) - target[some]) * weight[some] / len(some)).astype(np.float32)
            g, d_x = net.backward(gradient, at, mask, x, cache)
            pace = 1 - step / (total + 1)
            step += 1
            for k, v in net.p.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                net.p[k] = (v - STEP * pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            adapt(net.words, seen_words, rows, d_x, pace)
            grams_of = np.diff(cuts)
            adapt(net.grams, seen_grams, grams, np.repeat(d_x / grams_of[:, None].astype(np.float32), grams_of, axis=0), pace)
        if epoch >= late:
            kept += 1
            for k, v in (net.p | {"words": net.words, "grams": net.grams}).items():
                sums[k] += v
    net.p = {k: sums[k] / np.float32(kept) for k in net.p}
    net.words, net.grams = sums["words"] / np.float32(kept), sums["grams"] / np.float32(kept)


def adapt(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray, pace: float) -> None:
    """A step of the rows against their summed gradients, shorter the larger those were so far."""
    used, inverse = np.unique(rows, return_inverse=True)
    g = sums_by(inverse, gradient, len(used))
    seen[used] += (g**2).mean(1)
    table[used] -= EMBEDDING_STEP * pace * g / np.sqrt(seen[used])[:, None]


#: What a text's score is made of: the strongest logit, the soft maximum, and how many windows are suspicious.
FEATURES = 3


def pooled(logits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The features of texts whose windows' logits begin at starts."""
    z = np.clip(logits, -30, 30)
    most = np.maximum.reduceat(z, starts)
    n = np.diff(np.append(starts, len(z)))
    attention = np.exp(z - np.repeat(most, n))
    soft = np.add.reduceat(attention * z, starts) / np.add.reduceat(attention, starts)
    return np.stack([most, soft, np.log(np.add.reduceat(sigmoid(z), starts))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 3000) -> tuple[np.ndarray, float]:
    """Weights, none below 0, and shift of a logistic curve through the texts' features."""
    scale, weight = np.where(x.std(0) > 0, x.std(0), 1.0), weight / weight.mean()
    a, b, u = np.full(x.shape[1], 1 / x.shape[1]), 0.0, (x - x.mean(0)) / scale
    for _ in range(rounds):
        e = (sigmoid(u @ a + b) - y) * weight
        a, b = np.maximum(a - 0.5 * (u.T @ e / len(e) + 1e-3 * a), 0), b - 0.5 * float(e.mean())
    return a / scale, b - float(x.mean(0) @ (a / scale))


class Scorer:
    """Scores texts with a network, and remembers the gates of the words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        # room for all words from the start: pages of zeros take no memory before they are written, a table that grows is there twice
        self.gates = np.zeros((CACHE_WORDS + PIECE, 6 * HIDDEN), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words; the gates of new ones are made at once."""
        if len(self.number) > CACHE_WORDS:
            self.reset()
        fresh = [w for w in dict.fromkeys(words) if w not in self.number]
        if fresh:
            n = len(self.number)
            if n + len(fresh) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(n + len(fresh) - len(self.gates), len(self.gates) // 2), 6 * HIDDEN), np.float32)])
            for a in range(0, len(fresh), 1 << 12):
                some = fresh[a : a + (1 << 12)]
                self.gates[n + a : n + a + len(some)] = self.net.gates(self.net.vectors(word_rows(some), *gram_rows(some)))
            self.number.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every window's logit, and its text, of texts with so many words."""
        text, first, size = window_table(counts)
        out = np.zeros(len(text))
        for a in range(0, len(text), 2048):
            out[a : a + 2048] = self.net.forward(self.gates, *windows(ids, first[a : a + 2048], size[a : a + 2048]))
        return out, text

    def features(self, texts: list[str]) -> np.ndarray:
        """Each text's features; minus infinity without words."""
        out = np.full((len(texts), FEATURES), -np.inf)
        held: list[list[str]] = []
        for k, text in enumerate(texts):
            held.append(words_of(text))
            if sum(map(len, held[-64:])) >= PIECE or len(held) == 64 or k + 1 == len(texts):
                counts = np.array(list(map(len, held)), np.int64)
                logit, owner = self.logits(self.ids([w for words in held for w in words]), counts)
                if len(logit):
                    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    out[k + 1 - len(held) + owner[starts]] = pooled(logit, starts)
                held = []
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        found = self.features(texts)
        known = np.isfinite(found[:, 0])
        return np.where(known, sigmoid(np.where(known[:, None], found, 0) @ self.net.weights + self.net.shift), self.net.empty)


def score_toxicity(df: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, by a fitted network of fixed size that goes to each worker as a broadcast.

    Null and empty texts, and texts without a word, get the score of an ordinary clean text; repeated rows are scored
    each for itself; no rows give no rows. Only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            for a in range(0, part.num_rows, 512):
                piece = part.slice(a, 512)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scorer.scores(piece.column(1).to_pylist()), pa.float64())], schema=schema)

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def drop_toxic(df: DataFrame, net: Network, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score below the threshold, with all their columns; no shuffle."""
    at, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(net)

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            for a in range(0, part.num_rows, 512):
                piece = part.slice(a, 512)
                yield piece.filter(pa.array(scorer.scores([t or "" for t in piece.column(at).to_pylist()]) < threshold))

    return df.mapInArrow(run, df.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Network:
    """A network fitted on at most per_class labelled rows of each class outside the held-out fold."""
    texts, known, share = labelled_sample(documents_of(docs), labels, "toxic", FOLDS, HELD_OUT, per_class)
    return fit(texts, known, share=share)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
