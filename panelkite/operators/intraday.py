"""Operators on bars within days, and resampling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME, Compiler
from panelkite.plans.parser import ExpressionError
from panelkite.plans.tree import Call, Literal, Node

AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "std": F.stddev_samp,
    "first": lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col(TIME))),
    "last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col(TIME))),
}
_UNITS = {"s": "seconds", "sec": "seconds", "min": "minutes", "T": "minutes", "h": "hours", "H": "hours", "d": "days", "D": "days", "day": "days", "w": "weeks", "W": "weeks"}


def interval(freq: str) -> str:
    """"5min" as an interval that Spark reads."""
    digits = "".join(c for c in freq if c.isdigit()) or "1"
    unit = freq.strip("0123456789 ")
    if unit not in _UNITS:
        raise ExpressionError(f"{freq!r} isn't a frequency")
    return f"{digits} {_UNITS[unit]}"


def resample(rows: DataFrame, value: str, freq: str, func: str, fill_empty: bool = True) -> DataFrame:
    """(instrument, datetime, value): bins labelled by their start; empty ones in between are given too.

    "ffill" carries the last value on into empty bins; sums of nothing are NULL.
    """
    step = interval(freq)
    window = F.window(TIME, step)
    binned = rows.groupBy(INSTRUMENT, window.alias("_w")).agg(AGGREGATES["last" if func == "ffill" else func](value).alias(value))
    binned = binned.select(INSTRUMENT, F.col("_w.start").alias(TIME), value)
    if fill_empty:
        ends = binned.groupBy(INSTRUMENT).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"))
        slots = ends.select(INSTRUMENT, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(TIME))
        binned = slots.join(binned, [INSTRUMENT, TIME], "left")
    if func == "ffill":
        binned = binned.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(INSTRUMENT).orderBy(TIME)))
    if func == "count":
        binned = binned.withColumn(value, F.coalesce(value, F.lit(0)))
    return binned


def row_sets(rows: DataFrame, trees: Mapping[str, Node]) -> DataFrame:
    """Expressions whose outermost operator changes the rows; several are outer-joined by their rows."""
    out = None
    for name, tree in trees.items():
        one = _row_set(rows, name, tree)
        out = one if out is None else out.join(one, [INSTRUMENT, TIME, SLOT], "full")
    return out  # type: ignore[return-value]


def _row_set(rows: DataFrame, name: str, tree: Node) -> DataFrame:
    plain = [INSTRUMENT, TIME, SLOT]
    if not isinstance(tree, Call) or tree.name not in ("Select", "Cut", "TResample"):
        return Compiler(rows).add({name: tree}).select(*plain, F.col(f"`{name}`"))
    if tree.name == "Select":
        done = Compiler(rows).add({"_if": tree.args[0], name: tree.args[1]})
        return done.where(F.coalesce(F.col("_if").cast("boolean"), F.lit(False))).select(*plain, F.col(f"`{name}`"))
    done = Compiler(rows).add({name: tree.args[0]})
    if tree.name == "TResample":
        freq, func = (a.value for a in tree.args[1:3] if isinstance(a, Literal))
        binned = resample(done.withColumnRenamed(name, "_value"), "_value", str(freq), str(func)).withColumnRenamed("_value", name)
        return binned.withColumn(SLOT, F.lit(None).cast("int")).select(*plain, F.col(f"`{name}`"))
    left, right = (int(a.value) if isinstance(a, Literal) and a.value is not None else 0 for a in (*tree.args[1:3], Literal(0))[:2])
    order = Window.partitionBy(INSTRUMENT)
    done = done.withColumn("_a", F.row_number().over(order.orderBy(SLOT))).withColumn("_n", F.count(F.lit(1)).over(order))
    last = F.col("_n") + right if right < 0 else F.col("_n")
    return done.where((F.col("_a") > left) & (F.col("_a") <= last)).select(*plain, F.col(f"`{name}`"))


#: Sessions of a trading day by region, as (first, last) minutes.
SESSIONS = {
    "cn": (("9:30", "11:29"), ("13:00", "14:59")),
    "tw": (("9:00", "13:24"),),
    "us": (("9:30", "15:59"),),
}


def _minutes(text: str) -> int:
    h, m = text.split(":")
    return int(h) * 60 + int(m)


def session_minutes(region: str = "cn", shift: int = 0) -> list[dt.time]:
    """The minutes of a trading day."""
    out = [m - shift for a, b in SESSIONS[region] for m in range(_minutes(a), _minutes(b) + 1)]
    return [dt.time(m // 60, m % 60) for m in out]


def minute_of_session(region: str = "cn") -> Column:
    """A row's number among its day's minutes, NULL outside the sessions."""
    at, before = F.hour(TIME) * 60 + F.minute(TIME), 0
    out = None
    for a, b in SESSIONS[region]:
        one = F.when((at >= _minutes(a)) & (at <= _minutes(b)), at - _minutes(a) + before) if out is None else out.when((at >= _minutes(a)) & (at <= _minutes(b)), at - _minutes(a) + before)
        out, before = one, before + _minutes(b) - _minutes(a) + 1
    return out  # type: ignore[return-value]


def session_floor(minutes: int, region: str = "cn") -> Column:
    """A moment floored to a grid of so many session minutes, which the lunch break doesn't interrupt."""
    slot = F.floor(minute_of_session(region) / minutes) * minutes
    before, out = 0, None
    for a, b in SESSIONS[region]:
        length = _minutes(b) - _minutes(a) + 1
        clock = slot - before + _minutes(a)
        inside = (slot >= before) & (slot < before + length)
        out = F.when(inside, clock) if out is None else out.when(inside, clock)
        before += length
    day = F.date_trunc("day", F.col(TIME)).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", out.cast("int"), day)


def minute_calendar(days: DataFrame, region: str = "cn") -> DataFrame:
    """The minutes of all days (datetime), numbered."""
    parts = [f"sequence(to_timestamp_ntz(_day) + interval {_minutes(a)} minutes, to_timestamp_ntz(_day) + interval {_minutes(b)} minutes, interval 1 minute)" for a, b in SESSIONS[region]]
    minutes = days.select(F.date_trunc("day", TIME).cast("timestamp_ntz").alias("_day")).distinct().select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias(TIME))
    return minutes.withColumn(SLOT, F.row_number().over(Window.orderBy(TIME)) - 1)


def resample_calendar(calendar: DataFrame, every: int, unit: str) -> DataFrame:
    """Every n-th day, or the first trading day of every n-th week or month."""
    order = Window.orderBy(TIME)
    before = F.lag(TIME).over(order)
    if unit == "day":
        picked = calendar
    elif unit in ("week", "month"):
        part = F.weekday(TIME) if unit == "week" else F.dayofmonth(TIME)
        earlier = F.weekday(before) if unit == "week" else F.dayofmonth(before)
        picked = calendar.withColumn("_new", before.isNull() | (part < earlier)).where("_new").drop("_new")
    else:
        raise ValueError(f"{unit} isn't day, week or month")
    return picked.withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") % every == 0).select(TIME)


def aggregate_range(rows: DataFrame, value: str, start: str, end: str, func: str) -> DataFrame:
    """One value an instrument from the closed range; no rows, no value."""
    inside = rows.where((F.col(TIME) >= F.lit(start).cast("timestamp_ntz")) & (F.col(TIME) <= F.lit(end).cast("timestamp_ntz")))
    return inside.groupBy(INSTRUMENT).agg(AGGREGATES[func](value).alias(value))


def between_times(rows: DataFrame, *sessions: tuple[str, str]) -> DataFrame:
    """Rows whose time of day is in one of the sessions."""
    at = F.hour(TIME) * 3600 + F.minute(TIME) * 60 + F.second(TIME)
    inside = F.lit(False)
    for a, b in sessions:
        inside = inside | ((at >= _minutes(a) * 60) & (at <= _minutes(b) * 60))
    return rows.where(inside)
