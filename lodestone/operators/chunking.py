"""Recursive splitting of texts under a token budget, in one pass over each text.

A text is tokenised once; what a stretch of it costs is the number of tokens that start in it, which adds up over
neighbouring stretches. A stretch over the budget is cut after each occurrence of the first separator that it has, the
pieces are merged again from the left as far as the budget allows, and a piece that is still too long is cut by the
next separators, at last between tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SEPARATORS = ("\n\n", "\n", " ")
WORD = re.compile(r"\S+")
Starts = Callable[[str], np.ndarray]


def word_starts(text: str) -> np.ndarray:
    """Where the runs without white space start."""
    return np.fromiter((m.start() for m in WORD.finditer(text)), np.int64)


def tokenizer_starts(path: str) -> Starts:
    """Where the tokens of a tokenizer file start; the file is read once in each worker."""
    loaded = []

    def starts(text: str) -> np.ndarray:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return np.sort(np.array([a for a, _ in loaded[0].encode(text, add_special_tokens=False).offsets], np.int64))

    return starts


def cuts(text: str, a: int, b: int, separator: str) -> list[int]:
    """The ends of the occurrences of a separator in text[a:b]; of a run of them, the last."""
    out, at = [], text.find(separator, a, b)
    while at >= 0:
        end = at + len(separator)
        while text.startswith(separator, end) and end + len(separator) <= b:
            end += len(separator)
        if end < b:
            out.append(end)
        at = text.find(separator, end, b)
    return out


def spans(text: str, starts: np.ndarray, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Stretches of a text of at most `size` tokens each, unless one token is longer; neighbours share at most `overlap` tokens.

    size 0 or less: the whole text. Stretches begin and end without white space, and only white space is left out.
    """
    if overlap >= size > 0:
        raise ValueError("the overlap must be smaller than the budget")
    found = [(0, len(text))] if size <= 0 else []
    cost = lambda a, b: int(np.searchsorted(starts, b) - np.searchsorted(starts, a))
    todo = [(0, len(text), 0)] if size > 0 else []
    while todo:
        a, b, level = todo.pop()
        if cost(a, b) <= size:
            found.append((a, b))
            continue
        while level < len(separators) and not (ends := cuts(text, a, b, separators[level])):
            level += 1
        if level == len(separators):
            inside = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
            ends = [int(x) for x in inside[1:] if x > a]
        borders = [a, *ends, b]
        todo += reversed(merged(borders, cost, size, overlap, level + 1))
    bare = []
    for a, b in found:
        piece = text[a:b]
        left = a + len(piece) - len(piece.lstrip())
        right = left + len(piece.strip())
        if right > left:
            bare.append((left, right))
    return bare


def merged(borders: list[int], cost: Callable[[int, int], int], size: int, overlap: int, level: int) -> list[tuple[int, int, int]]:
    """Neighbouring pieces put together from the left as far as the budget goes, and each longer piece by itself, with the level that cuts it."""
    out, i, n = [], 0, len(borders) - 1
    while i < n:
        j = i + 1
        while j < n and cost(borders[i], borders[j + 1]) <= size:
            j += 1
        out.append((borders[i], borders[j], level))
        if j == n:
            break
        back = j
        while overlap and back - 1 > i and cost(borders[back - 1], borders[j]) <= overlap and cost(borders[back - 1], borders[j + 1]) <= size:
            back -= 1
        i = back
    return out


def chunked(df: DataFrame, text_col: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, starts: Starts = word_starts) -> DataFrame:
    """df with chunks: array of (number, start, tokens, text), start in characters from 0; a null text has none."""
    names, at = list(df.columns), df.columns.index(text_col)
    item = pa.struct([("number", pa.int32()), ("start", pa.int64()), ("tokens", pa.int32()), ("text", pa.string())])

    def rows(text: str | None) -> list[dict]:
        if text is None:
            return []
        where = starts(text)
        return [{"number": i, "start": a, "tokens": int(np.searchsorted(where, b) - np.searchsorted(where, a)), "text": text[a:b]} for i, (a, b) in enumerate(spans(text, where, size, overlap, separators))]

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 256):
                piece = part.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([rows(t) for t in piece.column(at).to_pylist()], pa.list_(item))], names=[*names, "chunks"])

    chunk = StructType([StructField("number", IntegerType()), StructField("start", LongType()), StructField("tokens", IntegerType()), StructField("text", StringType())])
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("chunks", ArrayType(chunk))]))
