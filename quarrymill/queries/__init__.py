"""Registered queries: each module has QUERIES (name -> function of session and folder) and SQL (name -> DuckDB statement)."""

from __future__ import annotations

import importlib

_NAMES = ("general", "relational", "statistics", "content", "graphs", "states", "flows", "upkeep", "facts", "insight", "checks")


def modules() -> list:
    return [importlib.import_module(f"quarrymill.queries.{n}") for n in _NAMES]
