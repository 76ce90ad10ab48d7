"""All queries over the driver's tables, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("byte_queries", "summary_queries", "phrase_queries", "stream_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"phrasemill.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"phrasemill.plans.{name}"), "ORACLE_SQL", {})
    return found
