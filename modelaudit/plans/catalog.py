"""All queries of the library by name, and the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("q_splits", "q_metrics", "q_models", "q_features")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) as a query, with the SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"modelaudit.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
