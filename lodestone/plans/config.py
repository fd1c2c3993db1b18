"""Settings of a retrieval service: defaults, requests' overrides, and errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from enum import IntEnum

MODES = ("embedding_retrieval", "text_search_retrieval", "hybrid")


@dataclass(frozen=True)
class Retrieval:
    """What a service retrieves and how; a field counts as given only if it is passed."""

    retrieval_mode: str = "embedding_retrieval"
    chunk_size: int = 250
    chunk_overlap: int = 0
    top_k: int = 4
    text_search_engine_top_k: int = 4
    text_search_engine_fields: tuple[str, ...] = ("content", "source")
    text_search_engine_max_chars_per_doc: int = 4000
    text_search_engine_max_total_chars: int = 16000
    query_depth_mult: int = 200
    remove_duplicates: bool = False
    reindex: bool = False
    index_protection: bool = True
    update_index: bool = False
    search: bool = False
    index_overview: bool = True
    filter_width: int = -1
    filter_height: int = -1
    num_partitions: int = -1
    dpi: int = 300
    given: frozenset[str] = field(default_factory=frozenset, compare=False)

    @staticmethod
    def of(**values) -> Retrieval:
        known = {f.name for f in fields(Retrieval)} - {"given"}
        if unknown := set(values) - known:
            raise ServiceError(Code.INPUT_BAD, f"unknown settings: {sorted(unknown)}")
        if values.get("retrieval_mode", MODES[0]) not in MODES:
            raise ServiceError(Code.INPUT_BAD, f"unknown retrieval mode: {values['retrieval_mode']}")
        return Retrieval(**values, given=frozenset(values))


def merged(base: Retrieval | None, override: Retrieval | None) -> Retrieval | None:
    """base with what the override gives; none if there is neither."""
    if base is None and override is None:
        return None
    if override is None:
        return base
    changes = {n: getattr(override, n) for n in override.given}
    return replace(base or Retrieval(), **changes, given=(base.given if base else frozenset()) | override.given)


def uses_embeddings(mode: str) -> bool:
    return mode in ("embedding_retrieval", "hybrid")


def uses_text(mode: str) -> bool:
    return mode in ("text_search_retrieval", "hybrid")


def read_settings(*paths: str) -> dict:
    """JSON files, later ones over earlier ones, key by key."""

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    out: dict = {}
    for p in paths:
        with open(p) as f:
            out = over(out, json.load(f))
    return out


class Code(IntEnum):
    """What a failure is reported as."""

    UNKNOWN_LIBRARY = 1000
    NO_DATA = 1001
    SERVICE = 1002
    JOB = 1003
    INPUT_BAD = 1004
    TRANSFORM = 1005
    BAD_REQUEST = 1006
    LANGUAGE_MODEL = 1007


HTTP = {Code.UNKNOWN_LIBRARY: 404, Code.NO_DATA: 400, Code.SERVICE: 404, Code.JOB: 404, Code.INPUT_BAD: 400, Code.TRANSFORM: 500, Code.BAD_REQUEST: 400, Code.LANGUAGE_MODEL: 500}


class ServiceError(Exception):
    def __init__(self, code: Code, message: str):
        super().__init__(message)
        self.code = code


def status_of(error: BaseException) -> tuple[int, int | None]:
    """HTTP status and code of an exception; an unexpected one is 500 without a code."""
    return (HTTP[error.code], int(error.code)) if isinstance(error, ServiceError) else (500, None)
