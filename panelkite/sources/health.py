"""Checks of raw or stored bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME

REQUIRED = ("open", "high", "low", "close", "volume")


def missing_values(rows: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """(instrument, one count of missing values a column) where any is missing."""
    counts = rows.groupBy(INSTRUMENT).agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c)), 1)).alias(c) for c in columns])
    return counts.where(sum((F.col(c) for c in columns), F.lit(0)) > 0)


def large_steps(rows: DataFrame, price: float = 0.5, volume: float = 3.0, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """(instrument, column, datetime, change): each instrument's changes beyond a threshold."""
    order = Window.partitionBy(INSTRUMENT).orderBy(TIME)
    changes = [F.struct(F.lit(c).alias("column"), (F.try_divide(F.col(c), F.lag(c).over(order)) - 1).alias("change")) for c in columns]
    long = rows.select(INSTRUMENT, TIME, F.array(*changes).alias("_c")).select(INSTRUMENT, TIME, F.explode("_c").alias("_c")).select(INSTRUMENT, TIME, "_c.*")
    return long.where(F.abs("change") > F.when(F.col("column") == "volume", volume).otherwise(price))


def missing_columns(rows: DataFrame, columns: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in columns if c not in rows.columns]


def missing_factor(rows: DataFrame) -> DataFrame:
    """Instruments without any adjustment factor."""
    if "factor" not in rows.columns:
        return rows.select(INSTRUMENT).distinct()
    return rows.groupBy(INSTRUMENT).agg(F.count("factor").alias("_n")).where("_n = 0").select(INSTRUMENT)


def upper_case(rows: DataFrame) -> DataFrame:
    """Instruments whose names aren't in lower case."""
    name = F.col(INSTRUMENT).cast("string")
    return rows.select(INSTRUMENT).distinct().where(F.lower(name) != name)
