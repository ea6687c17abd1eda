"""The queries of this subpackage and the DuckDB twins of those that have one."""

from __future__ import annotations

import importlib

_MODULES = ("token_output", "decontaminate", "jaccard_join", "substring_dedup", "quality_rules", "mixing", "language_id", "line_dedup", "pii", "weak_labels")


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found.update(getattr(importlib.import_module(f"{__package__}.{name}"), attribute, {}))
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
