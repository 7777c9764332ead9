"""Queries by name, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources.fixtures import PRELUDE

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("scoring", "metrics", "selection", "diagnostics", "text", "parsing", "sampling", "joins", "rewards", "exports", "extras", "files", "jobs")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` goes on from the prelude's tables, as ``, more as (...) select`` or a plain ``select``."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries named {name}")
        _queries[name] = f
        if sql:
            body = sql.strip()
            _sql[name] = f"with recursive {PRELUDE.strip()}\n{body if body.startswith(',') else ' ' + body}" if prelude else body
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums and means of inexact doubles to nine digits: their last bits depend on the order of the rows."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _load() -> None:
    for module in MODULES:
        import_module(f"pairlens.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
