"""The ways in which frames of a panel are put side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME

KEYS = [INSTRUMENT, TIME]


def side_by_side(frames: Sequence[DataFrame], how: str = "full") -> DataFrame:
    """Groups of columns on the keys they share."""
    return reduce(lambda a, b: a.join(b, KEYS, how), frames)


def nested(frames: Sequence[DataFrame], how: str = "left") -> DataFrame:
    """Loaders one after the other: columns that a later one has too come from it."""

    def one(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in b.columns if c in a.columns and c not in KEYS]
        return a.drop(*both).join(b, KEYS, how)

    return reduce(one, frames)


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values where there are any, old ones elsewhere."""
    values = [c for c in old.columns if c not in KEYS]
    both = old.join(new.select(*KEYS, *[F.col(c).alias(f"_new_{c}") for c in values]), KEYS, "full")
    return both.select(*KEYS, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def replace_range(old: DataFrame, new: DataFrame, since: str) -> DataFrame:
    """Predictions from a moment on are exchanged for new ones."""
    at = F.lit(since).cast("timestamp_ntz")
    return old.where(F.col(TIME) < at).unionByName(new.where(F.col(TIME) >= at), allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, at: str, value: Sequence[str], allow_exact: bool = True) -> DataFrame:
    """left with right's latest values at or before each of its moments.

    Both sides go through one sort of each instrument: a window carries the
    values on, and no pairs are made.
    """
    keyed = left.withColumn("_row", F.struct(*left.columns))
    a = keyed.select(INSTRUMENT, F.col(TIME).alias("_t"), F.lit(1 if allow_exact else 0).alias("_side"), "_row", F.lit(None).alias("_v"))
    b = right.select(INSTRUMENT, F.col(at).alias("_t"), F.lit(0 if allow_exact else 1).alias("_side"), F.lit(None).alias("_row"), F.struct(*value).alias("_v"))
    a = a.withColumn("_v", F.lit(None).cast(b.schema["_v"].dataType))
    b = b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))
    both = a.unionByName(b)
    seen = Window.partitionBy(INSTRUMENT).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(seen)).where("_row IS NOT NULL")
    return carried.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in value])


def mature_labels(prices: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """(instrument, datetime, matures, label, status): the price change to the session `horizon` slots ahead.

    status tells why there is none: NO_REFERENCE, NOT_MATURE or NO_MATURITY_PRICE.
    """
    slots = calendar.select(TIME, "cal_idx")
    ahead = slots.select((F.col("cal_idx") - horizon).alias("cal_idx"), F.col(TIME).alias("matures"))
    rows = prices.join(slots, TIME).join(ahead, "cal_idx", "left")
    later = prices.select(INSTRUMENT, F.col(TIME).alias("matures"), F.col("price").alias("_later"))
    rows = rows.join(later, [INSTRUMENT, "matures"], "left")
    status = (
        F.when(F.col("price").isNull() | (F.col("price") <= 0), "NO_REFERENCE")
        .when(F.col("matures").isNull(), "NOT_MATURE")
        .when(F.col("_later").isNull() | (F.col("_later") <= 0), "NO_MATURITY_PRICE")
        .otherwise("AVAILABLE")
    )
    rows = rows.withColumn("status", status)
    label = F.when(F.col("status") == "AVAILABLE", F.col("_later") / F.col("price") - 1)
    return rows.select(INSTRUMENT, TIME, "matures", label.alias("label"), "status")


def matured(prices: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """prices (instrument, datetime, price, ...; one row a key) with matures and label as `mature_labels` has them, label NULL where it isn't AVAILABLE.

    The calendar is broadcast and the later price comes from a window, so rows stay where their instrument is.
    """
    slots = calendar.select(F.col(TIME).alias("_t"), F.col("cal_idx").alias("_slot"))
    ahead = calendar.select((F.col("cal_idx") - horizon).alias("_ahead"), F.col(TIME).alias("matures"))
    both = F.broadcast(slots.join(ahead, F.col("_slot") == F.col("_ahead"), "left").drop("_ahead"))
    rows = prices.join(both, F.col(TIME) == F.col("_t")).drop("_t")
    later = F.first("price").over(Window.partitionBy(INSTRUMENT).orderBy("_slot").rangeBetween(horizon, horizon))
    label = F.when((F.col("price") > 0) & (F.col("_later") > 0), F.col("_later") / F.col("price") - 1)
    return rows.withColumn("_later", later).withColumn("label", label).drop("_later", "_slot")


def training_rows(labels: DataFrame, origins: DataFrame) -> DataFrame:
    """(issued_at, instrument, datetime, label): what an origin may learn from, labels that had matured by then.

    Origins are few (one for each evaluation); their side is broadcast only if Spark finds it small.
    """
    known = labels.where("status = 'AVAILABLE'")
    return origins.join(known, (F.col("matures") <= F.col("issued_at")) & (F.col(TIME) < F.col("issued_at"))).select("issued_at", INSTRUMENT, TIME, "label")


def daily_onto_minutes(minutes: DataFrame, daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    side = daily.select(INSTRUMENT, F.to_date(TIME).alias("_day"), *columns)
    return minutes.withColumn("_day", F.to_date(TIME)).join(side, [INSTRUMENT, "_day"], "left").drop("_day")


def shift_dates(dates: DataFrame, calendar: DataFrame, by: int, clip: bool = False) -> DataFrame:
    """Each moment's session `by` slots later; beyond the calendar NULL, or its end if clipped."""
    slots = calendar.select(TIME, "cal_idx")
    ends = slots.agg(F.min("cal_idx").alias("_a"), F.max("cal_idx").alias("_b"))
    rows = dates.join(slots, TIME).join(F.broadcast(ends)).withColumn("_to", F.col("cal_idx") + by)
    if clip:
        rows = rows.withColumn("_to", F.greatest(F.least("_to", "_b"), F.col("_a")))
    moved = slots.select(F.col("cal_idx").alias("_to"), F.col(TIME).alias("shifted"))
    return rows.join(moved, "_to", "left").select(TIME, "shifted")


def month_ends(calendar: DataFrame) -> DataFrame:
    """The last session of each month."""
    return calendar.groupBy(F.date_trunc("month", TIME)).agg(F.max(TIME).alias(TIME)).select(TIME)


def aligned(left: DataFrame, right: DataFrame, value: str, how: str = "full") -> DataFrame:
    """(instrument, datetime, left, right): two series whose rows don't match, on the keys that either has (or the left one)."""
    a, b = left.select(*KEYS, F.col(value).alias("left")), right.select(*KEYS, F.col(value).alias("right"))
    return a.join(b, KEYS, how)
