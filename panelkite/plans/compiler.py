"""From trees to a DataFrame in as few steps as their windows allow.

Every distinct window of an expression is computed once.  A window over plain
columns is of level 1, a window over such a window of level 2, and so on; all
windows of a level are added in one step.  All levels share the partitioning
and order of their instrument, so there is one shuffle and one sort, whatever
their number.  Arithmetic in between stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelkite.functions import elementwise as e
from panelkite.functions import registry, rolling
from panelkite.plans.parser import ExpressionError
from panelkite.plans.tree import Call, Field, Literal, Node

INSTRUMENT, TIME, SLOT = "instrument", "datetime", "cal_idx"
_AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "first": F.first, "last": F.last}


def _number(node: Node, what: str) -> float | int:
    if isinstance(node, Literal) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return node.value
    raise ExpressionError(f"{what} needs a number, not {node}")


def by_instrument() -> WindowSpec:
    return Window.partitionBy(INSTRUMENT).orderBy(SLOT)


def frame(n: int) -> WindowSpec:
    """The last n slots, or all so far."""
    return by_instrument().rowsBetween(-(n - 1) if n else Window.unboundedPreceding, 0)


def is_decay(node: Node) -> bool:
    """A window given as a fraction is an exponentially weighted mean, whatever the operator."""
    if not isinstance(node, Call) or len(node.args) < 2 or node.name not in registry.ROLLING | {"Quantile"}:
        return False
    n = node.args[1]
    return isinstance(n, Literal) and isinstance(n.value, float) and 0 < n.value < 1


def is_sequential(node: Node) -> bool:
    return isinstance(node, Call) and node.name not in registry.CUSTOM and (node.name == "EMA" or is_decay(node))


def is_window(node: Node) -> bool:
    if not isinstance(node, Call):
        return False
    if node.name in registry.CUSTOM:
        return registry.CUSTOM[node.name].window
    return node.name in registry.ROLLING | registry.PAIRED | registry.UNBOUNDED | {"Ref", "Delta", "Quantile", "EMA", "Rolling"}


def is_lookup(node: Node) -> bool:
    return isinstance(node, Call) and node.name in ("ChangeInstrument", "Mask")


@dataclass
class Compiler:
    """Adds columns of expressions to a panel (instrument, datetime, cal_idx, fields)."""

    panel: DataFrame

    def __post_init__(self) -> None:
        self.done: dict[Node, str] = {}
        #: Expressions that were made before: each costs some calls into the JVM.
        self.made: dict[Node, Column] = {}
        self.finite: dict[Node, Column] = {}
        self.levels: dict[Node, int] = {}

    def level(self, node: Node) -> int:
        if node not in self.levels:
            inner = max((self.level(c) for c in node.children()), default=0)
            self.levels[node] = inner + (is_window(node) or is_lookup(node))
        return self.levels[node]

    def column(self, node: Node) -> Column:
        """The node as an expression over the columns that there are so far."""
        if node in self.done:
            return F.col(self.done[node])
        if node not in self.made:
            self.made[node] = self._made(node)
        return self.made[node]

    def cleaned(self, node: Node) -> Column:
        """The node as rolling windows see it: a number without infinities."""
        if node not in self.finite:
            self.finite[node] = e.finite(e.number(self.column(node)))
        return self.finite[node]

    def _made(self, node: Node) -> Column:
        if isinstance(node, Field):
            if node.name not in self.panel.columns:
                return F.lit(None).cast("double")
            return F.col(node.name)
        if isinstance(node, Literal):
            return F.lit(node.value)
        if not isinstance(node, Call):
            raise ExpressionError(f"{node} is allowed only inside P and PRef")
        if node.name in registry.CUSTOM and not registry.CUSTOM[node.name].window:
            return registry.CUSTOM[node.name].build(*map(self.column, node.args))
        if node.name == "Date":
            return F.to_date(TIME)
        if node.name in registry.ELEMENTWISE:
            return registry.ELEMENTWISE[node.name](*map(self.column, node.args))
        if is_window(node):
            return self.window(node)
        raise ExpressionError(f"there is no operator {node.name} here")

    def window(self, node: Call) -> Column:
        name, x = node.name, self.column(node.args[0])
        if name in registry.CUSTOM:
            plain = [self.column(a) if not isinstance(a, Literal) else a.value for a in node.args]
            n = plain[-1] if isinstance(plain[-1], int) else 0
            return registry.CUSTOM[name].build(*plain, over=frame(n))
        if name in ("Ref", "Delta"):
            n = int(_number(node.args[1], name))
            if n == 0:
                then = F.first(x).over(frame(0))
            else:
                then = (F.lag(x, n) if n > 0 else F.lead(x, -n)).over(by_instrument())
            return then if name == "Ref" else e.subtract(x, then)
        if name in ("FFillNan", "BFillNan"):
            seen = frame(0) if name == "FFillNan" else by_instrument().rowsBetween(0, Window.unboundedFollowing)
            pick = F.last if name == "FFillNan" else F.first
            return pick(e.known(e.number(x)), ignorenulls=True).over(seen)
        if name in ("DayLast", "DayCumsum"):
            return self._of_day(node, x)
        if name == "Rolling":
            return self._rolling(node, x)
        if name == "Quantile":
            return rolling.quantile(self.cleaned(node.args[0]), float(_number(node.args[2], name)), frame(int(_number(node.args[1], name))))
        n = int(_number(node.args[-1], name))
        if n < 0:
            raise ExpressionError(f"{node}: a window can't be negative")
        if name in ("Skew", "Kurt") and 0 < n < (3 if name == "Skew" else 4):
            raise ExpressionError(f"{node}: the window is too short")
        over = frame(n)
        if name in registry.PAIRED:
            a, b = self.cleaned(node.args[0]), self.cleaned(node.args[1])
            return (rolling.correlation if name == "Corr" else rolling.covariance)(a, b, over)
        if name in ("Slope", "Resi", "Rsquare"):
            x, at = self.cleaned(node.args[0]), F.col(SLOT).cast("double")
            if name == "Rsquare":
                return rolling.rsquare(x, at, over, n == 0)
            return (rolling.slope if name == "Slope" else rolling.residual)(x, at, over)
        return rolling.simple(name, x if name == "Count" else self.cleaned(node.args[0]), over)

    def _of_day(self, node: Call, x: Column) -> Column:
        day = Window.partitionBy(INSTRUMENT, F.to_date(TIME))
        if node.name == "DayLast":
            whole = day.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return F.last(e.known(e.number(x)), ignorenulls=True).over(whole)
        start, end = (str(a.value) if isinstance(a, Literal) else "" for a in (*node.args[1:3], *(Literal("9:30"), Literal("14:59"))[len(node.args) - 1 :]))
        at = F.hour(TIME) * 60 + F.minute(TIME)
        first, last = (int(h) * 60 + int(m) for h, m in (start.split(":")[:2], end.split(":")[:2]))
        inside = F.when((at >= first) & (at <= last), e.known(e.number(x)))
        running = F.sum(inside).over(day.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0))
        return F.when(at > last, F.lit(0.0)).when(at < first, F.lit(0.0)).otherwise(F.when(x.isNotNull(), running))

    def _rolling(self, node: Call, x: Column) -> Column:
        size, func = node.args[1], node.args[2]
        if not isinstance(size, Literal) or not isinstance(func, Literal):
            raise ExpressionError(f"{node}: a window and the name of an aggregate are needed")
        if isinstance(size.value, str):
            step = pd.Timedelta(size.value) // pd.Timedelta(microseconds=1)
            # Open on the left: the frame is (t - size, t].
            micros = F.unix_micros(F.col(TIME).cast("timestamp"))
            over = Window.partitionBy(INSTRUMENT).orderBy(micros).rangeBetween(-(int(step) - 1), 0)
        else:
            over = frame(int(size.value))
        return _AGGREGATES[str(func.value)](e.finite(e.number(x))).over(over)

    def add(self, wanted: Mapping[str, Node], keep: Sequence[str] = ()) -> DataFrame:
        """The panel's keys, some of its columns, and a column for each expression."""
        every = list(dict.fromkeys(n for root in wanted.values() for n in root.walk()))
        top = max(map(self.level, wanted.values()), default=0)
        df = self.panel
        for level in range(1, top + 1):
            now = [n for n in every if self.level(n) == level and (is_window(n) or is_lookup(n)) and n not in self.done]
            for node in (n for n in now if is_lookup(n)):
                df = self._lookup(df, node)  # type: ignore[arg-type]
            slow = [n for n in now if is_sequential(n)]
            if slow:
                df = self._sequential(df, slow)  # type: ignore[arg-type]
            fresh = {f"_x{len(self.done) + i}": n for i, n in enumerate(n for n in now if not is_lookup(n) and n not in self.done)}
            if fresh:
                columns = {name: self.column(n) for name, n in fresh.items()}
                df = df.withColumns(columns)
                self.done |= {n: name for name, n in fresh.items()}
        return df.select(INSTRUMENT, TIME, SLOT, *keep, *[self.column(n).alias(name) for name, n in wanted.items()])

    def _lookup(self, df: DataFrame, node: Call) -> DataFrame:
        """Another instrument's values at the same slots: one instrument's slots, so the side is small."""
        inner, other = (node.args[1], node.args[0]) if node.name == "ChangeInstrument" else node.args
        if not isinstance(other, Literal):
            raise ExpressionError(f"{node}: the instrument must be given by name")
        name = f"_x{len(self.done)}"
        side = df.where(F.col(INSTRUMENT).cast("string") == str(other.value)).select(F.col(SLOT).alias("_slot"), self.column(inner).alias(name))
        self.done[node] = name
        return df.join(side, F.col(SLOT) == F.col("_slot"), "left").drop("_slot")

    def _sequential(self, df: DataFrame, nodes: list[Call]) -> DataFrame:
        """Recurrences, one instrument at a time."""
        names = [f"_x{len(self.done) + i}" for i in range(len(nodes))]
        inputs = [f"_in{i}" for i in range(len(nodes))]
        sizes = [_number(n.args[1], n.name) for n in nodes]

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(SLOT)
            for source, name, size in zip(inputs, names, sizes, strict=True):
                x = rows.column(source).to_pandas().astype(float)
                rows = rows.append_column(name, pa.array(_decayed(x, size), pa.float64(), from_pandas=True))
            return rows.drop_columns(inputs)

        # The other columns go along as they are, so nothing has to be joined to them again.
        ready = df.withColumns({i: self.cleaned(n.args[0]) for n, i in zip(nodes, inputs, strict=True)})
        schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])
        self.done |= dict(zip(nodes, names, strict=True))
        return ready.groupBy(INSTRUMENT).applyInArrow(run, schema)


def _decayed(x: pd.Series, size: float) -> pd.Series:
    """Exponentially weighted mean: span, decay, or for 0 the expanding weights whose decay follows the length."""
    if size == 0:
        values = x.to_numpy()
        out = np.full(len(values), np.nan)
        for i in range(len(values)):
            decay = 1 - 2 / (1 + (i + 1))
            w = decay ** np.arange(i, -1, -1.0)
            out[i] = np.nansum(w / w.sum() * values[: i + 1])
        return pd.Series(out, index=x.index)
    how = {"alpha": size} if 0 < size < 1 else {"span": size}
    return x.ewm(**how, min_periods=1).mean()
