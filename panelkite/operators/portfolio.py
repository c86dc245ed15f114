"""Returns, risk and attribution.  Daily rows are (datetime, return) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME

#: Periods of a year.
PERIODS = {"min": 240 * 238, "day": 238, "week": 50, "month": 12}


def so_far() -> WindowSpec:
    return Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)


def risk_analysis(returns: DataFrame, freq: str = "day", mode: str = "sum", periods: float | None = None) -> DataFrame:
    """One row: mean, std, annualized_return, information_ratio, max_drawdown.

    One row a period comes in, so the running maximum is over the periods of a
    single series, not over a panel.
    """
    n = float(periods or PERIODS[freq])
    rows = returns.where(F.col("return").isNotNull())
    if mode == "sum":
        curve = rows.withColumn("_c", F.sum("return").over(so_far())).withColumn("_d", F.col("_c") - F.max("_c").over(so_far()))
        done = curve.agg(F.avg("return").alias("mean"), F.stddev_samp("return").alias("std"), F.min("_d").alias("max_drawdown"))
        done = done.withColumn("annualized_return", F.col("mean") * n)
    elif mode == "product":
        curve = rows.withColumn("_l", F.log1p("return")).withColumn("_c", F.exp(F.sum("_l").over(so_far()))).withColumn("_d", F.col("_c") / F.max("_c").over(so_far()) - 1)
        done = curve.agg(F.sum("_l").alias("_s"), F.count("_l").alias("_n"), F.stddev_samp("_l").alias("std"), F.min("_d").alias("max_drawdown"))
        done = done.withColumn("mean", F.exp(F.col("_s") / F.col("_n")) - 1).withColumn("annualized_return", F.exp(F.col("_s") * n / F.col("_n")) - 1)
    else:
        raise ValueError(f"{mode} isn't sum or product")
    ratio = F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0))) * n**0.5
    return done.select("mean", "std", "annualized_return", ratio.alias("information_ratio"), "max_drawdown")


def curves(report: DataFrame, cost: str = "cost", bench: str = "bench") -> DataFrame:
    """Running sums of returns with and without cost, of the benchmark and of the excess, and their drawdowns."""
    rows = report.withColumns({"_net": F.col("return") - F.col(cost), "_ex": F.col("return") - F.col(bench), "_exnet": F.col("return") - F.col(bench) - F.col(cost)})
    named = {"return": "return", "return_net": "_net", "bench": bench, "excess": "_ex", "excess_net": "_exnet"}
    rows = rows.withColumns({f"cum_{k}": F.sum(v).over(so_far()) for k, v in named.items()})
    return rows.select(TIME, *[f"cum_{k}" for k in named], *[(F.col(f"cum_{k}") - F.max(f"cum_{k}").over(so_far())).alias(f"drawdown_{k}") for k in named])


def monthly_risk(returns: DataFrame) -> DataFrame:
    """(month, mean, std, annualized_return, information_ratio, max_drawdown) of each month's returns."""
    month = F.date_format(TIME, "yyyy-MM")
    run = Window.partitionBy("month").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("month", month).withColumn("_c", F.sum("return").over(run)).withColumn("_d", F.col("_c") - F.max("_c").over(run))
    done = rows.groupBy("month").agg(F.avg("return").alias("mean"), F.stddev_samp("return").alias("std"), F.min("_d").alias("max_drawdown"))
    n = PERIODS["day"]
    return done.withColumns({"annualized_return": F.col("mean") * n, "information_ratio": F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0))) * n**0.5})


def indicator_analysis(orders: DataFrame, method: str = "mean") -> DataFrame:
    """Mean ffr, pa and pos of rows (ffr, pa, pos, deal_amount, value, count), by rows, amounts or values."""
    weight = {"mean": F.col("count"), "amount_weighted": F.abs("deal_amount"), "value_weighted": F.abs("value")}[method]
    share = lambda c, w: F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    return orders.agg(share("ffr", weight).alias("ffr"), share("pa", weight).alias("pa"), share("pos", F.col("count")).alias("pos"))


def price_advantage(deals: DataFrame) -> DataFrame:
    """(datetime, instrument, direction, ffr, pa) from fills (amount, deal_amount, price, base_price, direction 1 buy, -1 sell)."""
    key = [TIME, INSTRUMENT, "direction"]
    done = deals.groupBy(*key).agg(F.sum("amount").alias("_a"), F.sum("deal_amount").alias("_d"), F.sum(F.col("price") * F.col("deal_amount")).alias("_v"), F.sum(F.col("base_price") * F.col("deal_amount")).alias("_b"))
    mean, base = F.try_divide(F.col("_v"), F.col("_d")), F.try_divide(F.col("_b"), F.col("_d"))
    return done.select(*key, F.try_divide(F.col("_d"), F.col("_a")).alias("ffr"), (-F.col("direction") * (F.try_divide(mean, base) - 1)).alias("pa"))


def base_price(bars: DataFrame, method: str = "twap") -> DataFrame:
    """(instrument, day, base_price): mean price, or mean weighted by volume, of each day's bars (price, volume)."""
    one = F.avg("price") if method == "twap" else F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume"))
    return bars.groupBy(INSTRUMENT, F.to_date(TIME).alias("day")).agg(one.alias("base_price"))


def benchmark_returns(rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(datetime, bench): mean return of all instruments of rows (instrument, datetime, return)."""
    if members is not None:
        rows = rows.join(members.select(INSTRUMENT).distinct(), INSTRUMENT, "left_semi")
    return rows.groupBy(TIME).agg(F.coalesce(F.avg("return"), F.lit(0.0)).alias("bench"))


def compounded(returns: DataFrame, start: str, end: str) -> DataFrame:
    inside = returns.where((F.col(TIME) >= F.lit(start).cast("timestamp_ntz")) & (F.col(TIME) <= F.lit(end).cast("timestamp_ntz")))
    return inside.agg((F.exp(F.sum(F.log1p("return"))) - 1).alias("return"))


def beta_alpha(returns: DataFrame, periods: int = 250) -> DataFrame:
    """One row: beta and yearly alpha of `return` on `bench`, Sharpe ratio, volatility, and drawdown of the compounded curve."""
    rows = returns.withColumn("_c", F.exp(F.sum(F.log1p("return")).over(so_far()))).withColumn("_d", F.col("_c") / F.max("_c").over(so_far()) - 1)
    done = rows.agg(F.try_divide(F.covar_samp("return", "bench"), F.var_samp("bench")).alias("beta"), F.avg("return").alias("_r"), F.avg("bench").alias("_b"), F.stddev_samp("return").alias("_s"), F.min("_d").alias("max_drawdown"))
    yearly = periods**0.5
    return done.select("beta", ((F.col("_r") - F.col("beta") * F.col("_b")) * periods).alias("alpha"), (F.try_divide(F.col("_r"), F.nullif(F.col("_s"), F.lit(0.0))) * yearly).alias("sharpe"), (F.col("_s") * yearly).alias("volatility"), "max_drawdown")


def next_return(prices: DataFrame) -> DataFrame:
    """prices (instrument, datetime, price) with the carried price's return to the next row."""
    order = Window.partitionBy(INSTRUMENT).orderBy(TIME)
    carried = F.last("price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = prices.withColumn("_p", carried)
    return rows.withColumn("return", F.try_divide(F.lead("_p").over(order), F.col("_p")) - 1).drop("_p")


def brinson(weights: DataFrame) -> DataFrame:
    """(datetime, raa, rss, rin, rtotal) from rows (datetime, instrument, group, return, port_weight, bench_weight).

    Weights are of the whole; a group without a position earns what the benchmark's does.
    """
    w, b, r = F.coalesce("port_weight", F.lit(0.0)), F.coalesce("bench_weight", F.lit(0.0)), F.coalesce("return", F.lit(0.0))
    groups = weights.groupBy(TIME, "group").agg(F.sum(w).alias("_w"), F.sum(b).alias("_b"), F.sum(w * r).alias("_wr"), F.sum(b * r).alias("_br"))
    bench = F.try_divide(F.col("_br"), F.nullif(F.col("_b"), F.lit(0.0)))
    port = F.coalesce(F.try_divide(F.col("_wr"), F.nullif(F.col("_w"), F.lit(0.0))), bench)
    parts = groups.groupBy(TIME).agg(
        F.sum(F.coalesce(F.col("_b") * bench, F.lit(0.0))).alias("_q1"),
        F.sum(F.coalesce(F.col("_w") * bench, F.lit(0.0))).alias("_q2"),
        F.sum(F.coalesce(F.col("_b") * port, F.lit(0.0))).alias("_q3"),
        F.sum(F.coalesce(F.col("_w") * port, F.lit(0.0))).alias("_q4"),
    )
    return parts.selectExpr(TIME, "_q2 - _q1 AS raa", "_q3 - _q1 AS rss", "_q4 - _q3 - _q2 + _q1 AS rin", "_q4 - _q1 AS rtotal")


def weight_bins(rows: DataFrame, value: str, bins: int, weight: str = "bench_weight") -> DataFrame:
    """rows with `group`: which of the benchmark's equal quantiles of a value each row is in."""
    inside = rows.where(F.col(weight) > 0).groupBy(TIME).agg(F.percentile(value, [i / bins for i in range(1, bins)]).alias("_cuts"))
    return rows.join(inside, TIME).withColumn("group", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def position_returns(rows: DataFrame) -> DataFrame:
    """(datetime, status, cum_return): running sum of each status's weighted mean return; rows (datetime, status, weight, return)."""
    daily = rows.groupBy(TIME, "status").agg(F.try_divide(F.sum(F.col("weight") * F.col("return")), F.sum("weight")).alias("_r"))
    run = Window.partitionBy("status").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(TIME, "status", F.sum("_r").over(run).alias("cum_return"))


def rank_labels(rows: DataFrame) -> DataFrame:
    """(datetime, status, rank_ratio): mean place of labels in percent, the largest first, by status."""
    date = Window.partitionBy(TIME)
    ratio = F.rank().over(date.orderBy(F.desc("label"))) / F.count("label").over(date) * 100
    return rows.withColumn("_r", ratio).groupBy(TIME, "status").agg(F.avg("_r").alias("rank_ratio"))
