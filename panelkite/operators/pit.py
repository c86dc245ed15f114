"""Point-in-time data: values of periods, as they were known on each day.

Records are (instrument, field, period, date, value): `date` is when a value
was published, `period` is year * 100 + quarter or a year.  An expression is
evaluated along the periods, only at days on which something of it was
published, and carried forward from there: between two publications nothing
that is known changes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME, Compiler
from panelkite.plans.parser import ExpressionError
from panelkite.plans.tree import Call, Field, Literal, Node, PeriodField


def period_index(period: Column, quarterly: bool) -> Column:
    """Consecutive numbers of consecutive periods."""
    return F.floor(period / 100) * 4 + period % 100 - 1 if quarterly else period


def period_of(index: Column, quarterly: bool) -> Column:
    return F.floor(index / 4) * 100 + index % 4 + 1 if quarterly else index


def period_fields(node: Node) -> list[str]:
    return sorted({n.name for n in node.walk() if isinstance(n, PeriodField)})


def _as_fields(node: Node) -> Node:
    if isinstance(node, PeriodField):
        return Field(node.name)
    if isinstance(node, Call):
        return Call(node.name, tuple(map(_as_fields, node.args)))
    return node


def as_known(periods: DataFrame, expression: Node, fixed: int | None = None) -> DataFrame:
    """(instrument, date, value): from each publication date on, the expression's value of the latest (or of a fixed) period."""
    names = period_fields(expression)
    if not names or any(n[-2:] not in ("_q", "_a") for n in names):
        raise ExpressionError(f"{expression}: fields of periods end in _q or _a")
    quarterly = names[0].endswith("_q")
    records = periods.where(F.col("field").isin(names)).withColumn("_at", period_index(F.col("period"), quarterly).cast("long"))
    moments = records.select(INSTRUMENT, "date").distinct()
    # Each record from its publication on, until the same period's next one: change points, not days.
    known = moments.alias("m").join(records.withColumnRenamed("date", "_published").alias("r"), INSTRUMENT).where("_published <= date")
    latest = known.groupBy(INSTRUMENT, "date", "_at").pivot("field", names).agg(F.max_by("value", "_published"))
    spans = latest.groupBy(INSTRUMENT, "date").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    every = spans.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    grid = every.join(latest, [INSTRUMENT, "date", "_at"], "left")
    # Along the periods of each instrument and date: the compiler's instrument is the pair, its slot the period.
    rows = grid.select(F.struct(INSTRUMENT, "date").alias(INSTRUMENT), F.col("date").alias(TIME), F.col("_at").alias(SLOT), "_high", *[F.col(n) for n in names])
    done = Compiler(rows).add({"value": _as_fields(expression)}, keep=["_high"])
    wanted = F.col(SLOT) == (F.col("_high") if fixed is None else period_index(F.lit(fixed), quarterly))
    values = done.where(wanted).select(F.col(f"{INSTRUMENT}.{INSTRUMENT}").alias(INSTRUMENT), F.col(TIME).alias("date"), "value")
    return spans.select(INSTRUMENT, "date").join(values, [INSTRUMENT, "date"], "left") if fixed is not None else values


def onto_days(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """rows with what is known on each of their days as column `name`."""
    points = known.select(F.col(INSTRUMENT), F.col("date").cast("timestamp_ntz").alias("_when"), F.struct(F.col("value")).alias("_value"))
    both = rows.select(INSTRUMENT, F.col(TIME).alias("_when"), F.lit(1).alias("_row"), F.lit(None).cast(dict(points.dtypes)["_value"]).alias("_value"))
    both = both.unionByName(points.withColumn("_row", F.lit(0)))
    # Publications of a day count on that day, so they come first.
    seen = Window.partitionBy(INSTRUMENT).orderBy("_when", "_row").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(seen)).where("_row = 1")
    values = carried.select(INSTRUMENT, F.col("_when").alias(TIME), F.col("_last.value").alias(name))
    return rows.join(values, [INSTRUMENT, TIME], "left")


def resolve(rows: DataFrame, trees: Mapping[str, Node], periods: DataFrame | None) -> tuple[DataFrame, dict[str, Node]]:
    """P(...) and PRef(...) become columns of the panel, and fields in the trees."""
    calls = list(dict.fromkeys(n for t in trees.values() for n in t.walk() if isinstance(n, Call) and n.name in ("P", "PRef")))
    if not calls:
        return rows, dict(trees)
    if periods is None:
        raise ValueError("this panel has no point-in-time records")
    names: dict[Node, Node] = {}
    for i, call in enumerate(calls):
        if any(isinstance(n, Call) and n.name == "Ref" and isinstance(n.args[1], Literal) and n.args[1].value < 0 for n in call.walk()):
            raise ExpressionError(f"{call}: periods of the future can't be referred to")
        fixed = int(call.args[1].value) if call.name == "PRef" else None  # type: ignore[union-attr]
        rows = onto_days(rows, as_known(periods, call.args[0], fixed), f"_p{i}")
        names[call] = Field(f"_p{i}")

    def replaced(node: Node) -> Node:
        if node in names:
            return names[node]
        return Call(node.name, tuple(map(replaced, node.args))) if isinstance(node, Call) else node

    return rows, {name: replaced(t) for name, t in trees.items()}
