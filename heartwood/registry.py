"""All queries outside the ``llm`` subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ledger", "files", "tree", "manifests", "declarations", "stream")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in import_module(f"heartwood.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(f"heartwood.plans.{m}").SQL.items()}
