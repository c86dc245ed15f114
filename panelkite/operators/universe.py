"""Universes: which instruments count when.

A universe is rows (instrument, start_datetime, end_datetime), both ends
included, as many for an instrument as it likes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME

if TYPE_CHECKING:
    from panelkite.operators.panel import Panel


def list_spans(spans: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Spans cut to [start, end]; empty ones go."""
    low = F.greatest("start_datetime", F.lit(start).cast("timestamp_ntz")) if start else F.col("start_datetime")
    high = F.least("end_datetime", F.lit(end).cast("timestamp_ntz")) if end else F.col("end_datetime")
    return spans.withColumns({"start_datetime": low, "end_datetime": high}).where("start_datetime <= end_datetime")


def spans_of_panel(rows: DataFrame) -> DataFrame:
    """Each instrument's first and last moment."""
    return rows.groupBy(INSTRUMENT).agg(F.min(TIME).alias("start_datetime"), F.max(TIME).alias("end_datetime"))


def within_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows inside any span of their instrument.  One row a row, however many spans hold it."""
    side = spans.select(F.col(INSTRUMENT).alias("_who"), "start_datetime", "end_datetime")
    inside = (F.col(INSTRUMENT) == F.col("_who")) & (F.col(TIME) >= F.col("start_datetime")) & (F.col(TIME) <= F.col("end_datetime"))
    return rows.join(side, inside, "left_semi")


def to_spans(flags: DataFrame, flag: str) -> DataFrame:
    """Maximal runs of slots whose flag is true: (instrument, start_datetime, end_datetime)."""
    order = Window.partitionBy(INSTRUMENT).orderBy(SLOT)
    runs = flags.where(F.col(flag)).withColumn("_run", F.col(SLOT) - F.row_number().over(order))
    return runs.groupBy(INSTRUMENT, "_run").agg(F.min(TIME).alias("start_datetime"), F.max(TIME).alias("end_datetime")).drop("_run")


@dataclass(frozen=True)
class Filter:
    """Restricts a universe between two moments and leaves it alone outside them."""

    start: str | None = None
    end: str | None = None

    def flag(self, panel: Panel, rows: DataFrame) -> DataFrame:
        """rows with a boolean column `_flag`."""
        raise NotImplementedError

    def in_force(self) -> Column:
        inside = F.lit(True)
        if self.start:
            inside = inside & (F.col(TIME) >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            inside = inside & (F.col(TIME) <= F.lit(self.end).cast("timestamp_ntz"))
        return inside


@dataclass(frozen=True)
class NameFilter(Filter):
    """Instruments whose name begins with a match of the pattern."""

    pattern: str = ""

    def flag(self, panel: Panel, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_flag", F.col(INSTRUMENT).cast("string").rlike(f"^(?:{self.pattern})"))


@dataclass(frozen=True)
class ExpressionFilter(Filter):
    """Instruments at moments where an expression holds; `keep` for those without data."""

    rule: str = ""
    keep: bool = False

    def flag(self, panel: Panel, rows: DataFrame) -> DataFrame:
        holds = panel.features({"_flag": self.rule}).withColumn("_flag", F.coalesce(F.col("_flag").cast("boolean"), F.lit(False)))
        joined = rows.join(holds, [INSTRUMENT, TIME], "left")
        return joined.withColumn("_flag", F.coalesce("_flag", F.lit(self.keep)))


def apply_filters(panel: Panel, spans: DataFrame | None, filters: Sequence[Filter]) -> DataFrame:
    """The spans that are left when all filters have been applied in order."""
    rows = panel.rows.select(INSTRUMENT, TIME, SLOT)
    if spans is not None:
        rows = within_spans(rows, spans)
    keep = rows.withColumn("_keep", F.lit(True))
    for one in filters:
        flagged = one.flag(panel, keep)
        keep = flagged.withColumn("_keep", F.col("_keep") & F.when(one.in_force(), F.coalesce("_flag", F.lit(False))).otherwise(True)).drop("_flag")
    return to_spans(keep, "_keep")


def covers_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of instruments whose data begin no later than `start` and end no earlier than `end`.  Looks into the future of `start`."""
    whole = rows.groupBy(INSTRUMENT).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"))
    whole = whole.where((F.col("_a") <= F.lit(start).cast("timestamp_ntz")) & (F.col("_b") >= F.lit(end).cast("timestamp_ntz")))
    return rows.join(whole.select(INSTRUMENT), INSTRUMENT, "left_semi")
