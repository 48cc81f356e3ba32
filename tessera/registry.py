"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to function of session and table folder) and ORACLES (name to SQL).
MODULES: tuple[str, ...] = ("plans.retrieval_queries", "plans.ledger_queries", "plans.graph_queries", "plans.further_queries")


def _gathered(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"tessera.{name}"), what).items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = value
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLES")
