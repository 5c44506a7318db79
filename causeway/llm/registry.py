"""Queries of the corpus operators, by name, and the SQL that says the same where there is any."""

from __future__ import annotations

import importlib

MODULES = ("packing", "scoring", "sharding", "language", "substrings", "neardup", "secrets", "neighbours", "pieces", "fingerprints", "alignment", "counts", "manifest")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"causeway.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"causeway.llm.{name}"), "ORACLE_SQL", {})
    return out
