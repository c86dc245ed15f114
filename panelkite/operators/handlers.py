"""Handlers: named groups of expressions over a panel, processed, and fetched by time, group and stage."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.operators.panel import Panel
from panelkite.operators.processors import Pipeline, Processor
from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME

ALL = "__all"
Step = Processor | tuple[type[Processor], Mapping]


def with_fit_range(steps: Sequence[Step], start: str, end: str) -> list[Processor]:
    """Processors from (class, arguments); those that are fitted get the range, unless they have one."""
    out = []
    for step in steps:
        if isinstance(step, Processor):
            out.append(step)
            continue
        kind, given = step
        names = {f.name for f in dataclasses.fields(kind)}
        fitted = {"start": start, "end": end} if {"start", "end"} <= names else {}
        out.append(kind(**{**fitted, **given}))
    return out


def _moment(value: object) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def select(rows: DataFrame, selector: object = None) -> DataFrame:
    """Rows of one moment, of a closed range (start, end) whose ends may be None, or of a list of moments."""
    if selector is None:
        return rows
    if isinstance(selector, tuple):
        start, end = selector
        rows = rows if start is None else rows.where(F.col(TIME) >= _moment(start))
        return rows if end is None else rows.where(F.col(TIME) <= _moment(end))
    moments = selector if isinstance(selector, list) else [selector]
    return rows.where(F.col(TIME).isin(*[_moment(m) for m in moments]))


@dataclass
class Handler:
    """Groups of expressions ({group: {column: expression}}) of a panel, and the processors they go through."""

    panel: Panel
    groups: Mapping[str, Mapping[str, str]]
    pipeline: Pipeline = field(default_factory=Pipeline)
    start: str | None = None
    end: str | None = None
    frames: dict[str, DataFrame] | None = None

    def setup(self) -> Handler:
        """Plans all columns as one query, and the processors; nothing is computed yet but what they are fitted by."""
        if self.frames is None:
            columns = [name for own in self.groups.values() for name in own]
            if len(set(columns)) < len(columns):
                raise ValueError("a column stands in several groups")
            every = {name: e for own in self.groups.values() for name, e in own.items()}
            self.frames = self.pipeline.run(self.panel.features(every, start=self.start, end=self.end))
        return self

    def columns(self, wanted: str | Sequence[str] = ALL) -> list[str]:
        names = list(self.groups) if wanted == ALL else [wanted] if isinstance(wanted, str) else list(wanted)
        return [c for g in names for c in self.groups[g]]

    def fetch(self, selector: object = None, groups: str | Sequence[str] = ALL, stage: str = "infer", function: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(instrument, datetime, the groups' columns) of a stage: raw, infer or learn."""
        rows = self.setup().frames[stage]  # type: ignore[index]
        there = [c for c in self.columns(groups) if c in rows.columns]
        out = select(rows.select(INSTRUMENT, TIME, *[F.col(f"`{c}`") for c in there]), selector)
        return function(out) if function else out

    def last_periods(self, moment: object, periods: int, **how: object) -> DataFrame:
        """fetch() of the last so many calendar slots up to a moment, fewer at the calendar's beginning."""
        days = self.panel.calendar.where(F.col(TIME) <= _moment(moment)).orderBy(F.desc(SLOT)).limit(periods)
        # At most `periods` rows.
        return self.fetch(**how).join(F.broadcast(days.select(TIME)), TIME, "left_semi").select(INSTRUMENT, TIME, *self._shown(**how))

    def _shown(self, groups: str | Sequence[str] = ALL, stage: str = "infer", **_: object) -> list[Column]:
        rows = self.setup().frames[stage]  # type: ignore[index]
        return [F.col(f"`{c}`") for c in self.columns(groups) if c in rows.columns]

    def periods(self, periods: int, least: int | None = None, **how: object) -> Iterator[tuple[object, DataFrame]]:
        """(moment, the last periods up to it) for each slot of the calendar that has so many before it."""
        days = [r[TIME] for r in self.panel.calendar.orderBy(SLOT).select(TIME).toLocalIterator()]
        for moment in days[periods if least is None else least :]:
            yield moment, self.last_periods(moment, periods, **how)

    def every_period(self, periods: int, **how: object) -> DataFrame:
        """All of periods() as one frame: (moment, instrument, datetime, columns), each row in the windows it is in."""
        rows = self.fetch(**how).join(self.panel.calendar, TIME)
        last = self.panel.calendar.agg(F.max(SLOT).alias("_last"))
        low, high = F.greatest(F.col(SLOT), F.lit(periods)), F.least(F.col(SLOT) + periods - 1, F.col("_last"))
        ends = rows.join(F.broadcast(last)).withColumn("_end", F.explode(F.when(low <= high, F.sequence(low, high))))
        at = self.panel.calendar.select(F.col(TIME).alias("moment"), F.col(SLOT).alias("_end"))
        return ends.join(at, "_end").select("moment", INSTRUMENT, TIME, *self._shown(**how))


def from_handlers(handlers: Mapping[str, Handler], join: str = "inner", **how: object) -> DataFrame:
    """Other handlers' columns side by side, each named group_column."""
    frames = []
    for name, handler in handlers.items():
        rows = handler.fetch(**how)
        frames.append(rows.select(INSTRUMENT, TIME, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in rows.columns if c not in (INSTRUMENT, TIME)]))
    return reduce(lambda a, b: a.join(b, [INSTRUMENT, TIME], join), frames)


def prepare(handler: Handler, segments: Mapping[str, tuple[str, str]], wanted: Sequence[str] | None = None, groups: str | Sequence[str] = ALL, stage: str = "infer") -> dict[str, DataFrame]:
    """Frames of named time ranges."""
    return {name: handler.fetch(segments[name], groups, stage) for name in (wanted or segments)}


def reweighted(rows: DataFrame, weight: Callable[[DataFrame], Column]) -> DataFrame:
    """rows with the weight that a rule gives each sample."""
    return rows.withColumn("weight", weight(rows))


def sequences(rows: DataFrame, length: int) -> DataFrame:
    """(instrument, datetime, first, last): for each row the places of its sequence among the instrument's rows, ends included."""
    place = F.row_number().over(Window.partitionBy(INSTRUMENT).orderBy(TIME)) - 1
    return rows.select(INSTRUMENT, TIME, F.greatest(place - (length - 1), F.lit(0)).alias("first"), place.alias("last"))


def day_slices(rows: DataFrame) -> DataFrame:
    """rows with day, tick (from 0) and left (ticks of the day still to come): one instrument's day is one slice."""
    day = F.to_date(TIME)
    own = Window.partitionBy(INSTRUMENT, day)
    tick = F.row_number().over(own.orderBy(TIME)) - 1
    return rows.withColumns({"day": day, "tick": tick, "left": F.count(F.lit(1)).over(own) - 1 - tick})
