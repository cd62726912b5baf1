"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ("jaccard_join", "substring_dedup", "decontamination", "language_id", "piece_sampling", "sharding", "chat_format", "tokenizer_quality", "toxicity", "html_extraction", "lexical_search", "secret_scan", "merkle_manifest")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"strandline.llm.{name}"), attribute)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
