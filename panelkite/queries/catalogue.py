"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelkite.queries import analysis, expressions, panels, workflow

_MODULES = (expressions, panels, analysis, workflow)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.oracle_sql().items()}
