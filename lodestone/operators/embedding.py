"""Where a caller's model becomes vectors: batches of fixed size, one model for each worker, dense or one vector a token.

A model is what a loader gives: a function of a list of texts. Loaders travel to the workers, models don't. A worker
keeps a model as long as a task uses it, and the last MOST_IDLE unused ones for the tasks after.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Loader = Callable[[], Callable[[list[str]], Iterable]]
#: Models that a worker keeps without a user.
MOST_IDLE = 2


class Models:
    """Models by key, with the number of their users; loading and counting are guarded, as workers may use threads."""

    def __init__(self, most_idle: int = MOST_IDLE):
        self.most_idle, self.loads = most_idle, 0
        self._lock, self._users, self._models = threading.RLock(), {}, OrderedDict()

    def acquire(self, key: str, loader: Loader):
        with self._lock:
            if key not in self._models:
                self._models[key] = loader()
                self.loads += 1
            self._models.move_to_end(key)
            self._users[key] = self._users.get(key, 0) + 1
            return self._models[key]

    def release(self, key: str) -> None:
        """One user less; of the models without any, those that were used longest ago go."""
        with self._lock:
            self._users[key] -= 1
            idle = [k for k in self._models if not self._users[k]]
            for k in idle[: max(0, len(idle) - self.most_idle)]:
                del self._models[k], self._users[k]

    def held(self) -> dict[str, int]:
        with self._lock:
            return {k: self._users[k] for k in self._models}


#: The models of this process.
WORKER = Models()


def packed(parts: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of `size` rows, the last one of what is left."""
    joined = lambda held: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held, n = [], 0
    for part in parts:
        start = 0
        while start < part.num_rows:
            take = min(size - n, part.num_rows - start)
            held.append(part.slice(start, take))
            n, start = n + take, start + take
            if n == size:
                yield joined(held)
                held, n = [], 0
    if n:
        yield joined(held)


def prompted(text: Column, label: Column) -> Column:
    """A text after the sentence that names its crop label, where it has one."""
    return F.concat(F.coalesce(F.concat(F.lit("This image has a "), F.nullif(label, F.lit("")), F.lit(". ")), F.lit("")), F.coalesce(text, F.lit("")))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _embedded(df: DataFrame, text_col: str, key: str, loader: Loader, size: int, value: Callable, kind, field: StructField) -> DataFrame:
    names, at = list(df.columns), df.columns.index(text_col)

    def run(parts):
        from lodestone.operators.embedding import WORKER

        model = WORKER.acquire(key, loader)
        try:
            for batch in packed(parts, size):
                texts = [x or "" for x in batch.column(at).to_pylist()]
                got = [value(x) for x in model(texts)]
                if len(got) != len(texts):
                    raise ValueError(f"the model {key} gave {len(got)} results for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*names, field.name])
        finally:
            WORKER.release(key)

    return df.mapInArrow(run, StructType([*df.schema.fields, field]))


def embed_dense(df: DataFrame, text_col: str, key: str, loader: Loader, *, size: int = 32, name: str = "embedding") -> DataFrame:
    """df with a vector of length 1 for each text; a null text is embedded as an empty one.

    The model gets lists of `size` texts, whatever the sizes of Arrow's batches, and gives a vector for each.
    """
    value = lambda v: unit(np.asarray(v, np.float64)).tolist()
    return _embedded(df, text_col, key, loader, size, value, pa.list_(pa.float64()), StructField(name, ArrayType(DoubleType())))


def embed_tokens(df: DataFrame, text_col: str, key: str, loader: Loader, *, size: int = 32, name: str = "vectors") -> DataFrame:
    """df with the vectors, of length 1, of each text's tokens that count.

    For each text the model gives (vectors, mask); tokens whose mask is 0 are left out. A text may have none.
    """

    def value(pair):
        v, mask = np.asarray(pair[0], np.float64), np.asarray(pair[1], bool)
        return unit(v[mask]).tolist() if mask.any() else []

    return _embedded(df, text_col, key, loader, size, value, pa.list_(pa.list_(pa.float64())), StructField(name, ArrayType(ArrayType(DoubleType()))))
