"""Frequencies and segments of time."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = {"month": "month", "mon": "month", "week": "week", "w": "week", "day": "day", "d": "day", "minute": "min", "min": "min"}
#: Minutes of trading.
MINUTES = {"min": 1, "day": 240, "week": 5 * 240, "month": 20 * 240}


@dataclass(frozen=True)
class Freq:
    """So many of a base: month, week, day or min."""

    count: int
    base: str

    @classmethod
    def parse(cls, text: str) -> Freq:
        m = re.fullmatch(r"(\d*)\s*([a-z]+)", text.strip().lower())
        if not m or m[2] not in _BASES:
            raise ValueError(f"{text!r} is no frequency")
        return cls(int(m[1] or 1), _BASES[m[2]])

    def __str__(self) -> str:
        return f"{self.count if self.count != 1 else ''}{self.base}"

    @property
    def minutes(self) -> int:
        return self.count * MINUTES[self.base]

    def finer_than(self, other: Freq) -> bool:
        return self.minutes <= other.minutes


def nearest(wanted: str, there: Sequence[str]) -> str | None:
    """The coarsest frequency that isn't coarser than the one wanted."""
    target = Freq.parse(wanted)
    fit = [f for f in there if Freq.parse(f).finer_than(target)]
    return max(fit, key=lambda f: Freq.parse(f).minutes) if fit else None


@dataclass(frozen=True)
class Sessions:
    """A sorted calendar on the driver, for segments and tasks."""

    moments: Sequence[Any]

    def align(self, moment: Any, to: str = "left") -> Any:
        """The first session not before (left), or the last not after (right)."""
        i = bisect.bisect_left(self.moments, moment) if to == "left" else bisect.bisect_right(self.moments, moment) - 1
        return self.moments[i] if 0 <= i < len(self.moments) else None

    def segment(self, span: tuple[Any, Any]) -> tuple[Any, Any]:
        return self.align(span[0]), self.align(span[1], "right")

    def shift(self, span: tuple[Any, Any], step: int, how: str = "sliding") -> tuple[Any, Any] | None:
        """Both ends so many sessions on, or with "expanding" the end only; None beyond the calendar."""
        a, b = (bisect.bisect_left(self.moments, x) for x in span)
        a, b = (a + step if how == "sliding" else a), b + step
        return (self.moments[a], self.moments[b]) if 0 <= a and b < len(self.moments) else None

    def truncate(self, span: tuple[Any, Any], test_start: Any, days: int) -> tuple[Any, Any]:
        """The span cut so that it ends at least `days` sessions before the test."""
        last = self.moments[max(bisect.bisect_left(self.moments, test_start) - days - 1, 0)]
        return span[0], min(span[1], last)

    def rolling(self, segments: dict[str, tuple[Any, Any]], step: int, how: str = "sliding") -> Iterator[dict[str, tuple[Any, Any]]]:
        """Tasks whose test segments follow each other."""
        now: dict[str, tuple[Any, Any]] | None = dict(segments)
        while now is not None:
            yield now
            moved = {k: self.shift(v, step, "sliding" if k == "test" else how) for k, v in now.items()}
            now = None if any(v is None for v in moved.values()) else moved  # type: ignore[assignment]


def epsilon_change(moment: Column, direction: str = "backward") -> Column:
    """The least step of a calendar, one second, to the past or to the future."""
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    return moment - F.expr("INTERVAL 1 SECOND") if direction == "backward" else moment + F.expr("INTERVAL 1 SECOND")


def concat_date_time(day: Column, time: Column) -> Column:
    """A date and a time of day (its text) as one moment."""
    return F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time).cast("timestamp_ntz")
