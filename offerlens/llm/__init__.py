"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("byte_bpe", "exact_dedup", "fingerprints", "html_text", "licenses", "lm_score", "near_dedup", "quality", "source_mix", "structure_repair", "substring_dedup", "toxicity", "vector_codes")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
