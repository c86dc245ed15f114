"""Bars and states of unbounded ticks (instrument, datetime, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelkite.plans.compiler import INSTRUMENT, TIME


def _bar(rows: DataFrame, window) -> DataFrame:
    """Works on a batch and, with a watermark, on a stream."""
    out = rows.groupBy(INSTRUMENT, window.alias("_w")).agg(
        F.min_by("value", TIME).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", TIME).alias("close"), F.sum("value").alias("volume"), F.count("value").alias("n")
    )
    return out.select(INSTRUMENT, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "open", "high", "low", "close", "volume", "n")


def _late(rows: DataFrame, late: str | None) -> DataFrame:
    return rows.withWatermark(TIME, late) if late and rows.isStreaming else rows


def tumbling(ticks: DataFrame, size: str, late: str | None = "10 minutes") -> DataFrame:
    return _bar(_late(ticks, late), F.window(TIME, size))


def sliding(ticks: DataFrame, size: str, step: str, late: str | None = "10 minutes") -> DataFrame:
    return _bar(_late(ticks, late), F.window(TIME, size, step))


def sessions(ticks: DataFrame, gap: str, late: str | None = "10 minutes") -> DataFrame:
    """Bars of ticks that follow each other within a gap."""
    return _bar(_late(ticks, late), F.session_window(TIME, gap))


def running_decay(ticks: DataFrame, alpha: float) -> DataFrame:
    """(instrument, datetime, value, ema): weighted means as they go on, their two sums kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, low = state.get if state.exists else (0.0, 0.0)
        for frame in batches:
            frame = frame.sort_values(TIME)
            out = []
            for x in frame["value"]:
                top, low = top * (1 - alpha), low * (1 - alpha)
                if x == x:
                    top, low = top + x, low + 1
                out.append(top / low if low else None)
            yield pd.DataFrame({INSTRUMENT: key[0], TIME: frame[TIME], "value": frame["value"], "ema": out})
        state.update((top, low))

    kind = dict(ticks.dtypes)
    return ticks.groupBy(INSTRUMENT).applyInPandasWithState(step, f"{INSTRUMENT} {kind[INSTRUMENT]}, {TIME} {kind[TIME]}, value double, ema double", "top double, low double", "append", GroupStateTimeout.NoTimeout)
