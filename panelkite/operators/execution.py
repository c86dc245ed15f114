"""Orders dealt out over a day's slots, clipped by volume, and made from weights; all native.

Orders are rows (instrument, amount, direction "buy" or "sell", ...).  Schedules
suppose that each slot's part is dealt in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME

#: Amounts up to this are nothing.
NOTHING = 1e-5


def _slots(orders: DataFrame, slots: int) -> DataFrame:
    return orders.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def equal_units(orders: DataFrame, slots: int, unit: float) -> DataFrame:
    """Equal parts of whole units, the larger ones first; what is no unit is sold in the last slot, and not bought."""
    many = F.floor(F.col("amount") / unit)
    part = (F.floor(many / slots) + (F.col("slot") < many % slots).cast("long")) * unit
    rest = F.when((F.col("direction") == "sell") & (F.col("slot") == slots - 1), F.col("amount") - many * unit).otherwise(0.0)
    return _slots(orders, slots).withColumn("amount", part + rest).where(F.col("amount") > NOTHING)


def least_impact(orders: DataFrame, slots: int, aversion: float = 1e-6, impact: float = 2.5e-6, signal: str = "volatility") -> DataFrame:
    """Parts that fall as sinh does: the more volatile, the more comes first (Almgren and Chriss); equal parts without a signal."""
    kappa = F.acosh(F.lit(aversion / impact) * F.col(signal) * F.col(signal) / 2 + 1)
    left = F.lit(slots) - F.col("slot")
    share = F.try_divide(F.sinh(kappa * left) - F.sinh(kappa * (left - 1)), F.nullif(F.sinh(kappa * slots), F.lit(0.0)))
    return _slots(orders, slots).withColumn("amount", F.col("amount") * F.coalesce(share, F.lit(1.0 / slots)))


def better_of_two(orders: DataFrame, trends: str = "trends") -> DataFrame:
    """The better one of every two slots, by an array of trends (1 rising, -1 falling, 0 or NULL none), one for each slot.

    The trend at the first slot of a pair holds for both.  Without one, what is
    left is dealt in equal parts; with one, two parts of what is left go into
    the first slot (buying before a rise, selling before a fall) or the second.
    """
    slots = F.size(trends)
    way = F.when(F.col("direction") == "buy", 1).otherwise(-1)

    def step(state: Column, i: Column) -> Column:
        left, trend = state["left"], F.coalesce(F.get(F.col(trends), i - i % 2), F.lit(0)).cast("int")
        togo = (slots - i).cast("double")
        fits = F.when(i % 2 == 0, trend == way).otherwise(trend == -way)
        part = F.when(trend == 0, left / togo).when(fits, 2 * left / (togo + 1)).otherwise(F.lit(0.0))
        last = (F.col("direction") == "sell") & (i == slots - 1) & ((trend == 0) | fits)
        part = F.when(last, left).otherwise(F.least(part, left))
        part = F.when(part > NOTHING, part).otherwise(F.lit(0.0))
        return F.struct((left - part).alias("left"), F.concat(state["parts"], F.array(part)).alias("parts"))

    begin = F.struct(F.col("amount").cast("double").alias("left"), F.array().cast("array<double>").alias("parts"))
    parts = F.aggregate(F.sequence(F.lit(0), slots - 1), begin, step, lambda s: s["parts"])
    dealt = orders.withColumn("_parts", parts)
    out = dealt.select(*[c for c in orders.columns if c not in ("amount", trends)], F.posexplode("_parts").alias("slot", "amount"))
    return out.where(F.col("amount") > NOTHING)


def random_orders(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Orders of a share of the rows' volume in a direction drawn by hash, so that reruns agree."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), INSTRUMENT, TIME), F.lit(2))
    return rows.withColumns({"amount": F.col("volume") * share, "direction": F.when(drawn == 0, "buy").otherwise("sell")})


def clipped(orders: DataFrame, current: str | None = None, cumulative: str | None = None) -> DataFrame:
    """orders (instrument, datetime, amount) with deal_amount: no more than `current` allows now, and `cumulative` of an instrument's day so far.

    What a day has dealt so far counts against its cumulative limit; the fold
    is over one instrument's orders of one day.
    """
    amount = F.col("amount").cast("double")
    now = F.least(amount, F.col(current)) if current else amount
    now = F.greatest(now, F.lit(0.0))
    if not cumulative:
        return orders.withColumn("deal_amount", now)
    so_far = Window.partitionBy(INSTRUMENT, F.to_date(TIME)).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct(now.alias("now"), F.col(cumulative).cast("double").alias("limit"))).over(so_far)
    dealt = lambda parts: F.aggregate(parts, F.lit(0.0), lambda d, p: d + F.greatest(F.least(p["now"], p["limit"] - d), F.lit(0.0)))
    before = F.slice(F.col("_seen"), F.lit(1), F.size("_seen") - 1)
    return orders.withColumn("_seen", seen).withColumn("deal_amount", dealt(F.col("_seen")) - dealt(before)).drop("_seen")


def weight_orders(current: DataFrame, weights: DataFrame, prices: DataFrame, cash: float, risk: float = 0.95) -> DataFrame:
    """(instrument, amount, direction) that bring holdings (instrument, amount) to target weights (instrument, weight) of the account."""
    held = current.join(prices, INSTRUMENT)
    account = held.agg((F.coalesce(F.sum(F.col("amount") * F.col("price")), F.lit(0.0)) + cash).alias("_account"))
    # One row.
    target = weights.join(prices, INSTRUMENT).join(F.broadcast(account)).select(INSTRUMENT, (F.col("weight") * F.col("_account") * risk / F.col("price")).alias("_b"))
    both = held.select(INSTRUMENT, F.col("amount").alias("_a")).join(target, INSTRUMENT, "full")
    gap = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return both.select(INSTRUMENT, F.abs(gap).alias("amount"), F.when(gap > 0, "buy").otherwise("sell").alias("direction")).where(F.col("amount") > NOTHING)


def quotes(rows: DataFrame, value: str, keys: list) -> DataFrame:
    """An instrument's quotes over a time: sum, mean, whether all are there and not zero, and the last valid one."""
    x = F.col(value)
    valid = x.isNotNull() & ~F.isnan(x)
    there = F.when(valid, x)
    return rows.groupBy(*keys).agg(F.sum(there).alias("sum"), F.avg(there).alias("mean"), F.bool_and(valid & (x != 0)).alias("all"), F.max_by(there, F.when(valid, F.col(TIME))).alias("last"))
