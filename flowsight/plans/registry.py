"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame and,
where the operator is SQL-expressible, the equivalent DuckDB SQL over the raw
tables (used as an independent oracle)."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
