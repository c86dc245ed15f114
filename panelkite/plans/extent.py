"""How many slots before and after a range an expression reads."""

from __future__ import annotations

import math

from panelkite.functions import registry
from panelkite.plans.tree import Call, Literal, Node

INFINITE = math.inf


def extent(node: Node) -> tuple[float, float]:
    """(slots before, slots after); infinite where all history counts."""
    inner = [extent(c) for c in node.children()]
    left = max((i[0] for i in inner), default=0)
    right = max((i[1] for i in inner), default=0)
    if not isinstance(node, Call):
        return left, right
    last = node.args[-1].value if node.args and isinstance(node.args[-1], Literal) else None
    name = node.name
    if name in registry.CUSTOM:
        if not registry.CUSTOM[name].window:
            return left, right
    elif name in ("Ref", "Delta"):
        if last == 0:
            return INFINITE, right
        return (left + last, right) if last > 0 else (left, right - last)
    elif name == "Quantile":
        last = node.args[1].value  # type: ignore[union-attr]
    elif name == "Rolling":
        last = node.args[1].value  # type: ignore[union-attr]
    elif name in registry.UNBOUNDED or name in ("EMA", "P", "PRef", "Cut"):
        return INFINITE, INFINITE if name in ("BFillNan", "DayLast", "Cut") else right
    elif name not in registry.ROLLING | registry.PAIRED:
        return left, right
    # An expanding frame, weights that never end, or a frame in time.
    return (left + last - 1, right) if isinstance(last, int) and last > 0 else (INFINITE, right)


def horizon(node: Node) -> float:
    """Slots of the future that a label needs."""
    return extent(node)[1]
