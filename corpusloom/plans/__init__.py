"""Registered queries, by module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("documents", "structure", "relational", "drafts", "drift", "profile")


def all_queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in MODULES:
        found |= import_module(f"corpusloom.plans.{name}").QUERIES
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"corpusloom.plans.{name}").SQL
    return found
