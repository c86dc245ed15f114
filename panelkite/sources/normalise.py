"""From raw vendor bars to adjusted, comparable ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME

PRICES = ("open", "high", "low", "close")


def in_order() -> WindowSpec:
    return Window.partitionBy(INSTRUMENT).orderBy(TIME)


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def mask_untraded(rows: DataFrame, columns: Sequence[str] = (*PRICES, "volume")) -> DataFrame:
    """No values where nothing was traded."""
    traded = F.col("volume") > 0
    return rows.withColumns({c: F.when(traded, F.col(c)) for c in columns})


def change(close: str = "close") -> Column:
    """The carried close's relative change to the row before."""
    carried = F.last(close, ignorenulls=True).over(so_far())
    before = F.last(close, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(carried, before) - 1


def repair_hundredfold(rows: DataFrame, rounds: int = 10) -> DataFrame:
    """Prices that jump about a hundredfold are divided by 100, again while there are any, ten times at most."""
    for _ in range(rounds):
        flagged = rows.withColumn("_jump", change().between(89, 111))
        if flagged.where("_jump").limit(1).count() == 0:
            break
        rows = flagged.withColumns({c: F.when(F.col("_jump"), F.col(c) / 100).otherwise(F.col(c)) for c in PRICES}).drop("_jump")
    return rows


def adjust(rows: DataFrame, adjusted: str = "adjclose") -> DataFrame:
    """Prices times factor and volume by factor; the factor is adjusted by plain close, carried on."""
    factor = F.last(F.try_divide(F.col(adjusted), F.col("close")), ignorenulls=True).over(so_far())
    rows = rows.withColumn("factor", F.coalesce(factor, F.lit(1.0)))
    return rows.withColumns({**{c: F.col(c) * F.col("factor") for c in PRICES}, "volume": F.try_divide(F.col("volume"), F.col("factor"))})


def rebase(rows: DataFrame) -> DataFrame:
    """Prices by the first valid close, volume times it."""
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_base", F.first("close", ignorenulls=True).over(whole))
    return rows.withColumns({**{c: F.try_divide(F.col(c), F.col("_base")) for c in PRICES}, "volume": F.col("volume") * F.col("_base")}).drop("_base")


def splice(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows rescaled so that they agree with the old ones at each instrument's last common moment, and appended."""
    last = old.groupBy(INSTRUMENT).agg(F.max_by(F.struct("close", F.col(TIME).alias("_t")), TIME).alias("_l"))
    both = new.join(last, INSTRUMENT)
    at = both.where(F.col(TIME) == F.col("_l._t")).select(INSTRUMENT, F.try_divide(F.col("_l.close"), F.col("close")).alias("_k"))
    later = both.where(F.col(TIME) > F.col("_l._t")).drop("_l").join(at, INSTRUMENT)
    scaled = later.withColumns({**{c: F.col(c) * F.col("_k") for c in PRICES}, "volume": F.try_divide(F.col("volume"), F.col("_k"))}).drop("_k")
    return old.unionByName(scaled, allowMissingColumns=True)


def traded_days(rows: DataFrame) -> DataFrame:
    """rows with paused_num: how many days in a row, this one included, something was traded (0 where nothing was)."""
    traded = F.coalesce(F.col("volume") > 0, F.lit(False))
    run = F.sum(F.when(traded, 0).otherwise(1)).over(so_far())
    rows = rows.withColumn("_run", run).withColumn("_traded", traded)
    inside = Window.partitionBy(INSTRUMENT, "_run").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("paused_num", F.sum(F.col("_traded").cast("int")).over(inside)).drop("_run", "_traded")


def busy_calendar(rows: DataFrame, threshold: float = 0.5, least: int = 1) -> DataFrame:
    """Moments at which enough instruments trade, by the share of those listed then."""
    spans = rows.groupBy(INSTRUMENT).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b"))
    trading = rows.where("volume > 0").groupBy(TIME).agg(F.countDistinct(INSTRUMENT).alias("_n"))
    begun = spans.groupBy(F.col("_a").alias(TIME)).agg(F.count(F.lit(1)).alias("_d")).unionByName(spans.groupBy(F.col("_b").alias("_e")).agg((-F.count(F.lit(1))).alias("_d")).select((F.col("_e") + F.expr("interval 1 microsecond")).alias(TIME), "_d"))
    moments = begun.unionByName(trading.select(TIME, F.lit(0).cast("bigint").alias("_d"))).groupBy(TIME).agg(F.sum("_d").alias("_d"))
    listed = moments.withColumn("_listed", F.sum("_d").over(Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)))
    return trading.join(listed.select(TIME, "_listed"), TIME).where(F.col("_n") >= F.greatest(F.col("_listed") * threshold, F.lit(least))).select(TIME)


def membership(snapshots: DataFrame) -> DataFrame:
    """Spans (instrument, start_datetime, end_datetime) from rows (datetime, instrument) of an index's members on its dates."""
    dates = snapshots.select(TIME).distinct().withColumn("_d", F.row_number().over(Window.orderBy(TIME)))
    rows = snapshots.join(dates, TIME)
    runs = rows.withColumn("_run", F.col("_d") - F.row_number().over(Window.partitionBy(INSTRUMENT).orderBy("_d")))
    return runs.groupBy(INSTRUMENT, "_run").agg(F.min(TIME).alias("start_datetime"), F.max(TIME).alias("end_datetime")).drop("_run")


def swap_market(name: Column, to: str = "suffix") -> Column:
    """sh600000 to 600000.sh, or back."""
    if to == "suffix":
        return F.regexp_replace(name, r"^([A-Za-z]{2})(\d+)$", "$2.$1")
    return F.regexp_replace(name, r"^(\d+)\.([A-Za-z]{2})$", "$2$1")


def membership_changes(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument, datetime, change): "add" on the session after the last snapshot without a member, "remove" on the last one with it.

    snapshots: rows (datetime, instrument) of an index's members; calendar: (datetime, cal_idx).
    """
    dates = snapshots.select(TIME).distinct().withColumn("_d", F.row_number().over(Window.orderBy(TIME)))
    ends = dates.agg(F.max("_d").alias("_last"))
    rows = snapshots.select(TIME, INSTRUMENT).distinct().join(dates, TIME)
    near = Window.partitionBy(INSTRUMENT).orderBy("_d")
    rows = rows.withColumns({"_before": F.lag("_d").over(near), "_after": F.lead("_d").over(near)}).join(F.broadcast(ends))
    came = rows.where((F.col("_d") > 1) & ((F.col("_before") < F.col("_d") - 1) | F.col("_before").isNull())).select(INSTRUMENT, (F.col("_d") - 1).alias("_d"))
    then = calendar.select(F.col("cal_idx"), F.col(TIME).alias("_t"))
    following = calendar.select((F.col("cal_idx") - 1).alias("cal_idx"), F.col(TIME).alias("_next"))
    after = dates.join(then, F.col(TIME) == F.col("_t")).join(following, "cal_idx").select("_d", F.col("_next").alias(TIME))
    left = rows.where((F.col("_d") < F.col("_last")) & ((F.col("_after") > F.col("_d") + 1) | F.col("_after").isNull()))
    return came.join(after, "_d").select(INSTRUMENT, TIME, F.lit("add").alias("change")).unionByName(left.select(INSTRUMENT, TIME, F.lit("remove").alias("change")))


def adjust_minutes(minutes: DataFrame, daily: DataFrame, prices: Sequence[str] = PRICES) -> DataFrame:
    """Minute prices times their day's factor, volume by it; daily: (instrument, day, factor)."""
    rows = minutes.withColumn("day", F.to_date(TIME)).join(daily.select(INSTRUMENT, "day", "factor"), [INSTRUMENT, "day"], "left")
    rows = rows.withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    own = [c for c in prices if c in minutes.columns]
    return rows.withColumns({**{c: F.col(c) * F.col("factor") for c in own}, **({"volume": F.try_divide(F.col("volume"), F.col("factor"))} if "volume" in minutes.columns else {})}).drop("day")
