"""Collects the queries and their SQL from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` gives the same rows in DuckDB."""

    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> tuple[dict[str, Callable], dict[str, str]]:
    import importlib
    import pkgutil

    from corpuslab import plans

    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module != "registry":
            importlib.import_module(f"corpuslab.plans.{module}")
    return QUERIES, ORACLE
