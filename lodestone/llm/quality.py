"""Quality: a byte-level convolutional network in numpy.

A byte's input is a learned embedding and two channels that tell whether the eight bytes from here on, or this byte
alone, repeat what stands a little before. Learned filters run over the whole document; their responses are max-pooled
within overlapping chunks, a small layer scores every chunk, and the mean, the largest and the smallest of the chunks'
scores combine into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents_of, table
from lodestone.llm.labelled import PER_CLASS, labelled_sample, remainder

EMBEDDING, WIDTH, STEP, FILTERS, HIDDEN = 6, 6, 2, 24, 12
CHANNELS = EMBEDDING + 2
#: Bytes of a chunk and between the starts of chunks.
CHUNK, APART = 512, 384
#: The longest way back at which a repetition counts.
LAG = 20
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: A document with more chunks than these counts, in all of them together, as much as one with so many.
EVEN_CHUNKS = 6
#: Bytes that are convolved at once.
BLOCK = 1 << 18


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chunk_starts(n: int) -> list[int]:
    return [0] if n <= CHUNK else list(range(0, n - CHUNK + APART, APART))


def repeats(data: np.ndarray) -> np.ndarray:
    """(n, 2): whether eight bytes from here on stand up to LAG bytes before, and whether the byte is that before it."""
    n = len(data)
    out = np.zeros((n, 2), np.float32)
    out[1:, 1] = data[1:] == data[:-1]
    if n > 8:
        word = np.zeros(n - 7, np.uint64)
        for k in range(8):
            word |= data[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        hit = np.zeros(n - 7, bool)
        for lag in range(2, min(LAG, n - 8) + 1):
            hit[lag:] |= word[lag:] == word[:-lag]
        out[: n - 7, 0] = hit
    return out


def patches(channels: np.ndarray) -> np.ndarray:
    """Inputs (positions, WIDTH * CHANNELS) of the filters, a position every STEP bytes; the end is padded with zeros."""
    positions = max(1, -(-len(channels) // STEP))
    padded = np.zeros(((positions - 1) * STEP + WIDTH, channels.shape[1]), np.float32)
    padded[: min(len(channels), len(padded))] = channels[: len(padded)]
    flat = padded.reshape(-1)
    size = flat.itemsize
    return np.lib.stride_tricks.as_strided(flat, (positions, WIDTH * channels.shape[1]), (STEP * channels.shape[1] * size, size), writeable=False)


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "E": (0.5 * r.standard_normal((256, EMBEDDING))).astype(np.float32),
            "W": (r.standard_normal((WIDTH * CHANNELS, FILTERS)) / np.sqrt(WIDTH * CHANNELS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "H": (r.standard_normal((FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32),
            "h": np.zeros(HIDDEN, np.float32),
            "O": (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32),
            "o": np.zeros(1, np.float32),
        }
        self.combine = np.array([0.0, 1.0, 0.0, 0.0], np.float64)  # shift; mean, largest, smallest of the chunks

    def channels(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["E"][data], repeats(data)], axis=1)

    def chunk_logits(self, data: np.ndarray) -> np.ndarray:
        """The score of every chunk of a document; empty bytes are one chunk of zeros."""
        starts = np.array(chunk_starts(len(data)))
        pooled = np.empty((len(starts), FILTERS), np.float32)
        per = max(1, BLOCK // APART)
        for a in range(0, len(starts), per):
            some = starts[a : a + per]
            own = data[some[0] : some[-1] + CHUNK + WIDTH]
            # the repetitions of a block's first bytes look back into the block before
            back = min(int(some[0]), LAG)
            channels = self.channels(data[some[0] - back : some[0] + len(own)])[back:]
            response = patches(channels) @ self.p["W"]
            first = (some - some[0]) // STEP
            last = np.minimum(first + CHUNK // STEP, len(response))
            edges = np.stack([first, last], 1).reshape(-1)
            response = np.concatenate([response, np.full((1, FILTERS), -np.inf, np.float32)])
            pooled[a : a + per] = np.maximum.reduceat(response, edges)[::2]
        hidden = np.tanh(np.maximum(pooled + self.p["b"], 0) @ self.p["H"] + self.p["h"])
        return hidden @ self.p["O"] + self.p["o"][0]

    def summary(self, data: np.ndarray) -> np.ndarray:
        x = self.chunk_logits(data)
        return np.array([1.0, x.mean(), x.max(), x.min()])

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = [self.summary(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts]
        return sigmoid(np.array(rows).reshape(-1, 4) @ self.combine)


def fit(texts: list[str], labels: list[int], *, share: float | None = None, steps: int = 700, batch: int = 64, seed: int = 0) -> Network:
    """A network for the labels. share: of ones among all labelled rows. Fewer than one text of either class gives the share to all texts.

    All chunks of the texts are learnt from, each at least once.
    """
    net, y, rng = Network(seed), np.array(labels, np.float64), np.random.default_rng(seed)
    here = float(y.mean()) if len(y) else 0.5
    share = here if share is None else share
    if not len(y) or not 0 < here < 1:
        net.combine = np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0, 0])
        return net
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    shown, target, part = [], [], []
    for d, label in zip(data, y):
        starts = chunk_starts(len(d))
        shown += [d[s : s + CHUNK] for s in starts]
        target += [label] * len(starts)
        part += [min(1.0, EVEN_CHUNKS / len(starts))] * len(starts)
    target, part = np.array(target, np.float32), np.array(part, np.float32)
    ones = float((target * part).sum() / part.sum())
    weight = (np.where(target > 0, 0.5 / ones, 0.5 / (1 - ones)) * part).astype(np.float32)
    weight *= len(weight) / weight.sum()
    steps = max(steps, -(-len(shown) // batch))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(target))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            step += 1
            for (k, v), g in zip(net.p.items(), gradients(net, [shown[i] for i in some], [repeats(shown[i]) for i in some], target[some], weight[some])):
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (0.01 if step < steps * 0.7 else 0.003) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            if step >= steps:
                break
    rows = np.array([net.summary(d) for d in data])
    scale = np.append(1.0, rows[:, 1:].std(0) + 1e-6)
    prior = np.where(y == 1, share / here, (1 - share) / (1 - here))
    w, x = np.array([0.0, 1.0, 0.0, 0.0]), rows / scale
    for _ in range(3000):
        e = (sigmoid(x @ w) - y) * prior
        w -= 0.3 * (x.T @ e / len(y) + 1e-3 * np.append(0.0, w[1:]))
    net.combine = w / scale
    return net


def gradients(net: Network, shown: list[np.ndarray], twice: list[np.ndarray], target: np.ndarray, weight: np.ndarray):
    """Gradients in the order of net.p. Only the places where a filter is strongest get any below the pooling."""
    p = net.p
    pooled, at, inputs = [], [], []
    for d, r in zip(shown, twice):
        x = patches(np.concatenate([p["E"][d], r], axis=1))
        response = x @ p["W"]
        k = response.argmax(0)
        pooled.append(response[k, np.arange(FILTERS)])
        at.append(k)
        inputs.append(x[k])
    pooled, inputs = np.array(pooled) + p["b"], np.array(inputs)  # (batch, filters), (batch, filters, WIDTH * CHANNELS)
    active = np.maximum(pooled, 0)
    hidden = np.tanh(active @ p["H"] + p["h"])
    d_logit = ((sigmoid(hidden @ p["O"] + p["o"][0]) - target) * weight / len(target)).astype(np.float32)
    d_hidden = d_logit[:, None] * p["O"] * (1 - hidden**2)
    d_pooled = d_hidden @ p["H"].T * (pooled > 0)
    d_in = d_pooled[:, :, None] * p["W"].T[None]
    d_e = np.zeros_like(p["E"])
    for k, (d, places) in enumerate(zip(shown, at)):
        for w in range(WIDTH):
            here = places * STEP + w
            ok = here < len(d)
            np.add.at(d_e, d[here[ok]], d_in[k, ok, w * CHANNELS : w * CHANNELS + EMBEDDING])
    return [d_e, np.einsum("bf,bfi->if", d_pooled, inputs) + 1e-5 * p["W"], d_pooled.sum(0), active.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_logit, np.array([d_logit.sum()], np.float32)]


def score_quality(df: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, by a fitted network of a few kilobytes.

    Null and empty texts are one chunk of zeros and get a score like any other; repeated rows are scored each for itself;
    no rows give no rows. Only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(parts):
        net = shared.value
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.scores(part.column(1).to_pylist()), pa.float64())], schema=schema)

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Network:
    """A network fitted on at most per_class labelled rows of each class outside the held-out fold."""
    texts, known, share = labelled_sample(documents_of(docs), labels, "quality", FOLDS, HELD_OUT, per_class)
    return fit(texts, known, share=share)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
