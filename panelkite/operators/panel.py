"""Panels: bars on calendar slots, and queries over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelkite.functions import elementwise, registry
from panelkite.operators import intraday, pit, universe
from panelkite.plans import extent, vectors
from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME, Compiler, by_instrument
from panelkite.plans.parser import parse
from panelkite.plans.tree import Call, Field, Literal, Node

Moment = str | dt.date | dt.datetime | None


def calendar_of(bars: DataFrame) -> DataFrame:
    """(datetime, cal_idx) of all moments that occur.  One row a slot: the window is over the calendar, not the bars."""
    return bars.select(TIME).distinct().withColumn(SLOT, F.row_number().over(Window.orderBy(TIME)) - 1)


@dataclass(frozen=True)
class Panel:
    """Rows (instrument, datetime, cal_idx, fields), one for each slot of an instrument's span."""

    rows: DataFrame
    calendar: DataFrame
    periods: DataFrame | None = None
    #: Whether all instruments are on the calendar's slots, not on their own.
    shared: bool = False
    members: DataFrame | None = None

    @classmethod
    def on_calendar(cls, bars: DataFrame, calendar: DataFrame | None = None, **more: DataFrame) -> Panel:
        """Bars on the shared calendar: every slot between an instrument's first and last bar, missing ones NULL."""
        calendar = calendar if calendar is not None else calendar_of(bars)
        # The calendar's size is that of its slots, not of the bars.
        placed = bars.join(calendar, TIME)
        spans = placed.groupBy(INSTRUMENT).agg(F.min(SLOT).alias("_first"), F.max(SLOT).alias("_last"))
        slots = spans.select(INSTRUMENT, F.explode(F.sequence("_first", "_last")).alias(SLOT)).join(calendar, SLOT)
        fields = [c for c in bars.columns if c not in (INSTRUMENT, TIME)]
        rows = slots.join(placed.drop(TIME), [INSTRUMENT, SLOT], "left").select(INSTRUMENT, TIME, SLOT, *fields)
        return cls(rows, calendar, shared=True, **more)

    @classmethod
    def dense(cls, bars: DataFrame, calendar: DataFrame | None = None, **more: DataFrame) -> Panel:
        """Bars on a calendar of each instrument's own: its bars, one after the other."""
        rows = bars.withColumn(SLOT, F.row_number().over(Window.partitionBy(INSTRUMENT).orderBy(TIME)) - 1)
        fields = [c for c in bars.columns if c not in (INSTRUMENT, TIME)]
        return cls(rows.select(INSTRUMENT, TIME, SLOT, *fields), calendar if calendar is not None else calendar_of(bars), **more)

    def with_(self, **changes: DataFrame) -> Panel:
        return replace(self, **changes)

    def trading_days(self, start: Moment = None, end: Moment = None) -> DataFrame:
        """The calendar between two moments, both included."""
        out = self.calendar
        if start is not None:
            out = out.where(F.col(TIME) >= F.lit(str(start)).cast("timestamp_ntz"))
        if end is not None:
            out = out.where(F.col(TIME) <= F.lit(str(end)).cast("timestamp_ntz"))
        return out.orderBy(SLOT)

    def features(
        self,
        fields: Sequence[str | Node] | Mapping[str, str | Node],
        instruments: Sequence | Mapping | str | DataFrame | None = None,
        start: Moment = None,
        end: Moment = None,
        filters: Sequence[universe.Filter] = (),
        per_instrument: Sequence[Callable[[pd.DataFrame], pd.DataFrame]] = (),
        single: bool = False,
    ) -> DataFrame:
        """(instrument, datetime, one column for each expression).

        Windows see the history before `start` and before an instrument's
        membership; only as much of it is read as the expressions need.
        """
        named = dict(fields) if isinstance(fields, Mapping) else {str(f): f for f in fields}
        trees = {name: parse(f) if isinstance(f, str) else f for name, f in named.items()}
        rows = self.rows
        lists = not isinstance(instruments, str | Mapping | DataFrame | None)
        looked_up = any(isinstance(n, Call) and n.name in ("ChangeInstrument", "Mask") for t in trees.values() for n in t.walk())
        if lists and not looked_up:
            rows = rows.where(F.col(INSTRUMENT).isin(list(instruments)))
        widest = [max(extent.extent(t)[i] for t in trees.values()) for i in (0, 1)] if trees else [0, 0]
        if start is not None or end is not None:
            rows = self._widened(rows, start, end, widest)
        rows, trees = pit.resolve(rows, trees, self.periods)
        if any(isinstance(t, Call) and t.name in registry.ROWSETS for t in trees.values()):
            out = intraday.row_sets(rows, trees)
        else:
            out = Compiler(rows).add(trees)
        out = _between(out, start, end)
        if lists and looked_up:
            out = out.where(F.col(INSTRUMENT).isin(list(instruments)))
        spans = self._spans(instruments)
        if filters:
            spans = universe.apply_filters(self, spans, filters)
        if spans is not None:
            out = universe.within_spans(out, spans)
        for function in per_instrument:
            out = out.groupBy(INSTRUMENT).applyInPandas(function, out.schema)
        out = out.drop(SLOT)
        if single:
            for name in trees:
                out = out.withColumn(name, F.col(f"`{name}`").cast("float"))
        return out

    def feature_set(self, fields: Mapping[str, str | Node], digits: int | None = None) -> DataFrame:
        """features() of many windows over all rows, in one pass of NumPy over each partition, rounded where digits are given.

        Fields are taken as doubles. What isn't there in NumPy (see vectors.fit) makes the whole set go through features().
        """
        trees = {name: parse(f) if isinstance(f, str) else f for name, f in fields.items()}
        if not vectors.fit(trees.values()):
            out = self.features(trees)
            kinds = dict(out.dtypes)
            return out if digits is None else out.withColumns({c: elementwise.rounded(F.col(c), digits) for c in trees if kinds[c] == "double"})
        used = sorted({n.name for t in trees.values() for n in t.walk() if isinstance(n, Field)})
        columns = [(F.col(c) if c in self.rows.columns else F.lit(None)).cast("double").alias(f"_field_{c}") for c in used]
        # The window brings each instrument's rows together and in order, as the windows of features() do.
        rows = self.rows.select(INSTRUMENT, TIME, SLOT, *columns, (F.row_number().over(by_instrument()) - 1).alias("_before"))
        trees = {name: _renamed(t) for name, t in trees.items()}
        schema = StructType([*rows.select(INSTRUMENT, TIME).schema.fields, *[StructField(name, DoubleType()) for name in trees]])
        return rows.mapInArrow(vectors.over_batches(trees, digits, (INSTRUMENT, TIME), SLOT, "_before"), schema)

    def _widened(self, rows: DataFrame, start: Moment, end: Moment, widest: Sequence[float]) -> DataFrame:
        """Only the slots that the range's expressions can see, so that the scan can leave the rest out."""
        if self.shared:
            # From the calendar, which is small, so that the scan gets plain moments to compare with.
            ends = _between(self.calendar, start, end).agg(F.min(SLOT), F.max(SLOT)).first()
            if ends is None or ends[0] is None:
                return rows.where(F.lit(False))
            low, high = ends[0] - widest[0], ends[1] + widest[1]
            seen = self.calendar.where((F.col(SLOT) >= F.lit(float(low))) & (F.col(SLOT) <= F.lit(float(high)))).agg(F.min(TIME), F.max(TIME)).first()
            return _between(rows, None if widest[0] == extent.INFINITE else seen[0], None if widest[1] == extent.INFINITE else seen[1])
        near = _between(rows.select(INSTRUMENT, TIME, SLOT), start, end)
        ends = near.groupBy(INSTRUMENT).agg(F.min(SLOT).alias("_from"), F.max(SLOT).alias("_to"))
        low = F.lit(True) if widest[0] == extent.INFINITE else F.col(SLOT) >= F.col("_from") - int(widest[0])
        high = F.lit(True) if widest[1] == extent.INFINITE else F.col(SLOT) <= F.col("_to") + int(widest[1])
        return rows.join(ends, INSTRUMENT).where(low & high).drop("_from", "_to")

    def _spans(self, instruments: object) -> DataFrame | None:
        """(instrument, start_datetime, end_datetime) or None for no restriction."""
        if isinstance(instruments, DataFrame):
            return instruments
        if isinstance(instruments, str):
            if instruments == "all" and self.members is None:
                return None
            if self.members is None:
                raise ValueError(f"there is no market {instruments}")
            return self.members.where(F.col("market") == instruments).drop("market")
        if isinstance(instruments, Mapping):
            spark = self.rows.sparkSession
            flat = [(k, pd.Timestamp(a).to_pydatetime(), pd.Timestamp(b).to_pydatetime()) for k, spans in instruments.items() for a, b in spans]
            kind = dict(self.rows.dtypes)[INSTRUMENT]
            return spark.createDataFrame(flat, f"{INSTRUMENT} {kind}, start_datetime timestamp_ntz, end_datetime timestamp_ntz")
        return None


def _renamed(node: Node) -> Node:
    """Fields under names that clash with no key."""
    if isinstance(node, Field):
        return Field(f"_field_{node.name}")
    return Call(node.name, tuple(map(_renamed, node.args))) if isinstance(node, Call) else node


def _between(rows: DataFrame, start: Moment, end: Moment) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(TIME) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col(TIME) <= F.lit(str(end)).cast("timestamp_ntz"))
    return rows


def literal_int(node: Node) -> int:
    if not isinstance(node, Literal):
        raise TypeError(f"{node} isn't a number")
    return int(node.value)
