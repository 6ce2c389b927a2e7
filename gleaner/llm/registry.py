"""Queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = [
    "secrets", "toxicity", "packing", "substrings", "extraction", "order_minhash", "simhash", "language", "hamming", "bpe",
    "ranking", "manifest", "quality",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over the tables of a folder; ``sql`` gives the same rows in plain SQL."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"gleaner.llm.{name}")
