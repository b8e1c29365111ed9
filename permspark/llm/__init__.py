"""Operators for training-data corpora. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

#: Modules that have QUERIES and perhaps ORACLE.
MODULES = ("bpe_dropout", "chat", "fingerprints", "neardup", "packing", "quality_model", "quality_rules", "secrets", "substrings", "warc")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
