"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from phrasemill.session import ship

MODULES = ("quality", "simhash", "html", "topk", "lines", "packing", "chat", "sharding", "pieces", "suffixes")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in MODULES:
        for key, query in import_module(f"phrasemill.llm.{name}").QUERIES.items():
            found[key] = _shipped(query)
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"phrasemill.llm.{name}"), "ORACLE_SQL", {})
    return found
