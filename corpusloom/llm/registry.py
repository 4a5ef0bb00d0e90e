"""All queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("encode", "language", "leakage", "lookalikes", "quality", "scans", "sentences", "truncation")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"corpusloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
