"""The registered queries of this subpackage and, where SQL can express one, DuckDB's form of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.chat import OP12_SQL, op12_chat
from lodestone.llm.decontamination import op9_decontamination
from lodestone.llm.merkle import OP11_SQL, op11_merkle
from lodestone.llm.neighbours import op7_neighbours
from lodestone.llm.packing import op1_packing
from lodestone.llm.pii import op8_pii
from lodestone.llm.quality import op5_quality
from lodestone.llm.simhash import op10_simhash
from lodestone.llm.spans import OP6_SQL, op6_spans
from lodestone.llm.suffixes import op2_suffixes
from lodestone.llm.token_counts import op3_token_counts
from lodestone.llm.toxicity import op4_toxicity
from lodestone.llm.trie import OP13_SQL, op13_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffixes": op2_suffixes,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_spans": op6_spans,
    "op7_neighbours": op7_neighbours,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_trie": op13_trie,
}

ORACLES: dict[str, str] = {"op6_spans": OP6_SQL, "op11_merkle": OP11_SQL, "op12_chat": OP12_SQL, "op13_trie": OP13_SQL}
