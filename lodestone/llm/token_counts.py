"""Token counts of greedy longest-match word pieces, by a linear automaton that builds no pieces.

The vocabulary is a trie whose word-initial and continuing pieces have roots of their own. Where no edge goes on, a
node's failure link leads to the node that is left after its longest pieces are popped off the front, and its popped
count says how many these are. A word thus takes a number of steps that is linear in its length. A word with a part
that no piece covers counts as one unknown token.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import documents_of, table

#: Words whose counts a worker remembers, and the length from which a word isn't remembered.
CACHE_WORDS, LONG_WORD = 500_000, 64
#: The mark that a word-initial piece starts with.
MARK = "▁"


class Automaton:
    """Counts the pieces of words. initial: pieces that start a word; inner: those that go on with it."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.piece.append(False)
                    node = self.edges[node][c]
                if piece:
                    self.piece[node] = True
        #: Failure link, -1 where what is left can't be split; pieces popped on the way.
        self.link = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque((0, 1))
        while queue:
            node = queue.popleft()
            for c, child in self.edges[node].items():
                if self.piece[child]:
                    self.link[child], self.popped[child] = 1, 1
                else:
                    at, n = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.edges[at]:
                        at, n = self.link[at], n + self.popped[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.edges[at][c], n
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if greedy matching gets stuck, which makes the word unknown."""
        node = n = 0
        edges, link, popped = self.edges, self.link, self.popped
        for c in word:
            while (to := edges[node].get(c)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return n


_automata: dict[str, tuple[Automaton, dict[str, int]]] = {}


def automaton(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a sentencepiece file, one for each worker process, and the counts of the words it has met."""
    if path not in _automata:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        _automata[path] = Automaton([p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1], [p for p in pieces if not p.startswith(MARK)]), {}
    return _automata[path]


def counts(text: str, machine: Automaton, known: dict[str, int]) -> tuple[int, int, int]:
    """Words, tokens and unknown words of a text; words are what white space parts."""
    words = text.split()
    found = list(map(known.get, words))
    if None in found:
        for i, f in enumerate(found):
            if f is None:
                w = words[i]
                found[i] = n = machine.count(w)
                if len(w) < LONG_WORD:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = n
    unknown = found.count(0)
    return len(words), sum(found) + unknown, unknown


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row.

    vocabulary: path, on every executor, of a sentencepiece file. Null, empty and blank texts have no tokens; repeated
    rows are counted each for itself; ids may be null; no rows give no rows. Only the two columns are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(parts):
        machine, known = automaton(vocabulary)
        for part in parts:
            rows = [counts(t.as_py(), machine, known) for t in part.column(1)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

    return documents_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
