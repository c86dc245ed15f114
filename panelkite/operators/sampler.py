"""Time-series samples, segments and column groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME


def segments(rows: DataFrame, named: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Frames of named time ranges, both ends included."""
    return {k: rows.where((F.col(TIME) >= F.lit(a).cast("timestamp_ntz")) & (F.col(TIME) <= F.lit(b).cast("timestamp_ntz"))) for k, (a, b) in named.items()}


def column_groups(rows: DataFrame, groups: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> DataFrame:
    """The keys and the columns of some groups; "__all" is all of them."""
    names = [c for g in (groups if "__all" in wanted else wanted) for c in groups[g]]
    return rows.select(INSTRUMENT, TIME, *[F.col(f"`{c}`") for c in names])


def samples(rows: DataFrame, columns: Sequence[str], length: int, fill: str = "none", start: str | None = None, end: str | None = None, wanted: str | None = None) -> DataFrame:
    """(instrument, datetime, sample): the last `length` market-wide moments' columns as an array of arrays.

    Moments without a row, or before the first, are NULLs; "ffill" carries
    values on within a sample, "ffill+bfill" backwards too.  Samples end inside
    [start, end] at rows that are there (and, if named, where the boolean column
    `wanted` holds); their history may begin before.
    """
    moments = rows.select(TIME).distinct().withColumn("_t", F.row_number().over(Window.orderBy(TIME)))
    placed = rows.join(moments, TIME)
    span = placed.groupBy(INSTRUMENT).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    grid = span.select(INSTRUMENT, F.explode(F.sequence("_a", "_b")).alias("_t"))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    keep = [F.col(wanted).alias("_w")] if wanted else [F.lit(True).alias("_w")]
    full = grid.join(placed.select(INSTRUMENT, TIME, "_t", values.alias("_v"), *keep), [INSTRUMENT, "_t"], "left")
    order = Window.partitionBy(INSTRUMENT).orderBy("_t")
    missing = F.array(*[F.lit(None).cast("double") for _ in columns])
    seen = F.collect_list(F.coalesce("_v", missing)).over(order.rowsBetween(-(length - 1), 0))
    padded = F.concat(F.array_repeat(missing, length - F.size(seen)), seen)
    out = full.withColumn("sample", padded).where(F.col(TIME).isNotNull() & F.col("_w"))
    if fill != "none":
        out = out.withColumn("sample", _carried(F.col("sample"), len(columns), backwards=fill == "ffill+bfill"))
    if start:
        out = out.where(F.col(TIME) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col(TIME) <= F.lit(end).cast("timestamp_ntz"))
    return out.select(INSTRUMENT, TIME, "sample")


def _carried(sample, width: int, backwards: bool):
    empty = F.array().cast("array<array<double>>")

    out = F.aggregate(sample, empty, lambda d, v: F.concat(d, F.array(F.array(*[F.coalesce(v[i], F.get(F.get(d, F.size(d) - 1), F.lit(i))) for i in range(width)]))))
    if backwards:
        out = F.aggregate(F.reverse(out), empty, lambda d, v: F.concat(F.array(F.array(*[F.coalesce(v[i], F.get(F.get(d, F.lit(0)), F.lit(i))) for i in range(width)])), d))
    return out


def last_moments(rows: DataFrame, k: int) -> DataFrame:
    """Rows of the last k moments that occur."""
    recent = rows.select(TIME).distinct().orderBy(F.desc(TIME)).limit(k)
    return rows.join(F.broadcast(recent), TIME, "left_semi")


def split(rows: DataFrame, number: int | None = None, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows up to the number-th moment, or up to a date, and the rest."""
    if date is None:
        cut = rows.select(TIME).distinct().orderBy(TIME).limit(number or 0).agg(F.max(TIME).alias("_cut"))
        both = rows.join(F.broadcast(cut))
        return both.where(F.col(TIME) <= F.col("_cut")).drop("_cut"), both.where((F.col(TIME) > F.col("_cut")) | F.col("_cut").isNull()).drop("_cut")
    at = F.lit(date).cast("timestamp_ntz")
    return rows.where(F.col(TIME) <= at), rows.where(F.col(TIME) > at)
