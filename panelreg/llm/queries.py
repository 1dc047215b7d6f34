"""All queries of this subpackage."""

from panelreg.llm import (
    alignment,
    byte_bpe,
    chat,
    decontamination,
    hard_negatives,
    language,
    mixing,
    near_dedup,
    piecewise,
    sharding,
    token_files,
    toxicity,
    warc,
)
from panelreg.llm.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "alignment",
    "byte_bpe",
    "chat",
    "decontamination",
    "hard_negatives",
    "language",
    "mixing",
    "near_dedup",
    "piecewise",
    "sharding",
    "token_files",
    "toxicity",
    "warc",
]
