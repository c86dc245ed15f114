"""Operators by name, and how users add their own.

An elementwise operator gets columns.  A window operator gets the columns and
numbers it is called with, and the frame of its last argument's N slots.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkite.functions import elementwise as e

ELEMENTWISE: dict[str, Callable[..., Column]] = {
    "Abs": lambda x: F.abs(e.number(x)),
    "Sign": e.sign,
    "Log": e.log,
    "Power": e.power,
    "Add": e.add,
    "Sub": e.subtract,
    "Mul": e.multiply,
    "Div": e.divide,
    "Greater": e.greater,
    "Less": e.less,
    **{name: (lambda a, b, name=name: e.compare(name, a, b)) for name in ("Gt", "Ge", "Lt", "Le", "Eq", "Ne")},
    "And": e.both,
    "Or": e.either,
    "Not": lambda x: ~x,
    "If": e.choose,
    "IsNull": e.is_null,
    "IsInf": e.is_inf,
}
#: Operators over a frame of the last N slots, N being the last argument.
ROLLING = {"Mean", "Sum", "Std", "Var", "Skew", "Kurt", "Max", "Min", "IdxMax", "IdxMin", "Med", "Mad", "Rank", "WMA", "WMAFixed", "Count", "Slope", "Rsquare", "Resi"}
PAIRED = {"Corr", "Cov"}
#: Operators whose result depends on all slots so far.
UNBOUNDED = {"FFillNan", "BFillNan", "DayCumsum", "DayLast"}
#: Operators that change which rows there are; only outermost.
ROWSETS = {"Select", "Cut", "TResample"}


@dataclass(frozen=True)
class Custom:
    """A user's operator."""

    build: Callable[..., Column]
    window: bool = False


CUSTOM: dict[str, Custom] = {}


def known_names() -> set[str]:
    return {*ELEMENTWISE, *ROLLING, *PAIRED, *UNBOUNDED, *ROWSETS, *CUSTOM, "Ref", "Delta", "Quantile", "EMA", "Rolling", "Date", "ChangeInstrument", "Mask", "P", "PRef"}


def register(name: str, build: Callable[..., Column], window: bool = False) -> None:
    """Adds an operator; one of ours of that name is replaced, with a warning."""
    if name in known_names():
        warnings.warn(f"operator {name} is replaced", stacklevel=2)
    CUSTOM[name] = Custom(build, window)


def unregister(name: str) -> None:
    CUSTOM.pop(name, None)
