"""How good a signal is: rows (datetime, instrument, score, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkite.operators.processors import date_rank
from panelkite.plans.compiler import INSTRUMENT, TIME


def on_date() -> WindowSpec:
    return Window.partitionBy(TIME)


def ic(signal: DataFrame, keys: Sequence[str] = (), ranks: bool = True) -> DataFrame:
    """(datetime, ic, rank_ic): correlation of score and label over each date's complete pairs, and that of their ranks.

    More `keys`, such as a model's name, give a row for each of their values.
    """
    pairs = signal.where("score IS NOT NULL AND label IS NOT NULL AND NOT isnan(score) AND NOT isnan(label)")
    out = [_correlation("score", "label").alias("ic")]
    if ranks:
        group = Window.partitionBy(TIME, *keys)
        for c in ("score", "label"):
            ties = F.count(F.lit(1)).over(Window.partitionBy(TIME, *keys, c))
            pairs = pairs.withColumn(f"_{c}", F.rank().over(group.orderBy(c)) + (ties - 1) / 2)
        out.append(_correlation("_score", "_label").alias("rank_ic"))
    return pairs.groupBy(TIME, *keys).agg(*out)


def _correlation(a: str, b: str) -> Column:
    """Spark's own corr() fails where there is no variance.  Both columns are complete."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def ic_summary(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means, and means by deviation, of ic and rank_ic."""
    ratio = lambda c: F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0)))
    return daily.groupBy(*keys).agg(F.avg("ic").alias("ic"), ratio("ic").alias("icir"), F.avg("rank_ic").alias("rank_ic"), ratio("rank_ic").alias("rank_icir"))


def _ends(signal: DataFrame, share: float, drop: bool) -> DataFrame:
    """signal with the place of each score from either end, and the number of rows taken."""
    rows = signal.where("score IS NOT NULL AND label IS NOT NULL") if drop else signal
    order = on_date().orderBy(F.col("score").desc_nulls_last(), INSTRUMENT)
    back = on_date().orderBy(F.col("score").asc_nulls_last(), INSTRUMENT)
    take = F.floor(F.count(F.lit(1)).over(on_date()) * F.lit(share))
    return rows.withColumns({"_top": F.row_number().over(order), "_low": F.row_number().over(back), "_k": take})


def long_short_precision(signal: DataFrame, share: float = 0.2, drop: bool = False, alpha: bool = False) -> DataFrame:
    """(datetime, long_precision, short_precision): of the best and worst scores, how many labels are above or below zero."""
    if alpha:
        signal = signal.withColumn("label", F.col("label") - F.avg("label").over(on_date()))
    rows = _ends(signal, share, drop)
    long, short = F.col("_top") <= F.col("_k"), F.col("_low") <= F.col("_k")
    part = lambda end, hit: F.try_divide(F.count(F.when(end & hit, 1)), F.nullif(F.count(F.when(end, F.col("label"))), F.lit(0)))
    out = rows.groupBy(TIME).agg(part(long, F.col("label") > 0).alias("long_precision"), part(short, F.col("label") < 0).alias("short_precision"))
    return out


def long_short_return(signal: DataFrame, share: float = 0.2, drop: bool = False) -> DataFrame:
    """(datetime, long_short, average): half the difference of the ends' mean labels, and all labels' mean."""
    rows = _ends(signal, share, drop)
    long = F.avg(F.when(F.col("_top") <= F.col("_k"), F.col("label")))
    short = F.avg(F.when(F.col("_low") <= F.col("_k"), F.col("label")))
    return rows.groupBy(TIME).agg(((long - short) / 2).alias("long_short"), F.avg("label").alias("average"))


def _lagged(signal: DataFrame, lag: int, value: str) -> DataFrame:
    """Each row beside its instrument's value `lag` dates earlier."""
    dates = signal.select(TIME).distinct().withColumn("_d", F.row_number().over(Window.orderBy(TIME)))
    rows = signal.join(dates, TIME)
    before = rows.select(INSTRUMENT, (F.col("_d") + lag).alias("_d"), F.col(value).alias("_before"))
    return rows.join(before, [INSTRUMENT, "_d"])


def autocorrelation(signal: DataFrame, lag: int = 1, ranks: bool = False) -> DataFrame:
    """(datetime, autocorrelation) of scores, or of their percentile ranks, with those `lag` dates earlier."""
    rows = signal.withColumn("score", date_rank(F.col("score"))) if ranks else signal
    both = _lagged(rows, lag, "score").where("score IS NOT NULL AND _before IS NOT NULL")
    return both.groupBy(TIME).agg(_correlation("score", "_before").alias("autocorrelation"))


def group_returns(signal: DataFrame, groups: int = 5) -> DataFrame:
    """(datetime, group1, ..., long_short, long_average): mean labels of equal groups by descending score; rows over are in none."""
    rows = signal.where("score IS NOT NULL AND label IS NOT NULL")
    size = F.floor(F.count(F.lit(1)).over(on_date()) / groups)
    place = F.row_number().over(on_date().orderBy(F.desc("score"), INSTRUMENT)) - 1
    rows = rows.withColumn("_g", F.floor(F.try_divide(place, size)))
    means = [F.avg(F.when(F.col("_g") == g, F.col("label"))).alias(f"group{g + 1}") for g in range(groups)]
    out = rows.groupBy(TIME).agg(*means, F.avg("label").alias("_all"))
    return out.select(TIME, *[f"group{g + 1}" for g in range(groups)], (F.col("group1") - F.col(f"group{groups}")).alias("long_short"), (F.col("group1") - F.col("_all")).alias("long_average"))


def turnover(signal: DataFrame, groups: int = 5, lag: int = 1) -> DataFrame:
    """(datetime, top, bottom): the share of the best and worst group that wasn't there `lag` dates earlier."""
    size = F.floor(F.count(F.lit(1)).over(on_date()) / groups)
    rows = signal.withColumns(
        {
            "_top": F.row_number().over(on_date().orderBy(F.desc_nulls_last("score"), INSTRUMENT)) <= size,
            "_low": F.row_number().over(on_date().orderBy(F.asc_nulls_last("score"), INSTRUMENT)) <= size,
            "_size": size,
        }
    )
    both = _lagged(rows.withColumn("_ends", F.struct("_top", "_low")), lag, "_ends")
    stay = lambda end: 1 - F.try_divide(F.count(F.when(F.col(end) & F.col(f"_before.{end}"), 1)), F.nullif(F.max("_size"), F.lit(0)))
    return both.groupBy(TIME).agg(stay("_top").alias("top"), stay("_low").alias("bottom"))


def monthly_ic(daily: DataFrame) -> DataFrame:
    """(year, 1, ..., 12): the mean ic of each month."""
    return daily.withColumn("_m", F.month(TIME)).groupBy(F.year(TIME).alias("year")).pivot("_m", list(range(1, 13))).agg(F.avg("ic"))


def average_ensemble(predictions: DataFrame, model: str = "model") -> DataFrame:
    """(datetime, instrument, score): the mean of the models' scores, each z-scored by date."""
    own = Window.partitionBy(TIME, model)
    z = F.try_divide(F.col("score") - F.avg("score").over(own), F.nullif(F.stddev_samp("score").over(own), F.lit(0.0)))
    return predictions.withColumn("_z", z).groupBy(TIME, INSTRUMENT).agg(F.avg("_z").alias("score"))


def rolling_ensemble(predictions: DataFrame, start: str = "start") -> DataFrame:
    """(datetime, instrument, score) of the latest model that predicts a row."""
    return predictions.groupBy(TIME, INSTRUMENT).agg(F.max_by("score", start).alias("score"))


def long_short_backtest(signal: DataFrame, k: int) -> DataFrame:
    """(datetime, long, short, long_short): mean excess label of the k best, of the k worst turned round, and both."""
    order = on_date().orderBy(F.desc_nulls_last("score"), INSTRUMENT)
    back = on_date().orderBy(F.asc_nulls_last("score"), INSTRUMENT)
    rows = signal.withColumns({"_top": F.row_number().over(order), "_low": F.row_number().over(back)})
    every = F.avg("label")
    long = F.avg(F.when(F.col("_top") <= k, F.col("label"))) - every
    short = every - F.avg(F.when(F.col("_low") <= k, F.col("label")))
    return rows.groupBy(TIME).agg(long.alias("long"), short.alias("short"), (long + short).alias("long_short"))


def diagnostics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each date and column: rows, distinct, missing and infinite values, mean, deviation, skewness, kurtosis."""
    long = rows.select(TIME, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("_c"))
    long = long.select(TIME, "_c.*").withColumn("v", F.when(~F.isnan("x") & ~F.col("x").isin(float("inf"), float("-inf")), F.col("x")))
    n = F.count("v")
    return long.groupBy(TIME, "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("v").alias("n_distinct"),
        F.count(F.when(F.col("x").isNull() | F.isnan("x"), 1)).alias("n_missing"),
        F.count(F.when(F.col("x").isin(float("inf"), float("-inf")), 1)).alias("n_infinite"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.when((n >= 3) & (F.stddev_pop("v") > 0), F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness("v")).alias("skew"),
        F.when((n >= 4) & (F.stddev_pop("v") > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis("v") + 6)).alias("kurt"),
    )


def top_k(signal: DataFrame, k: int, best: bool = True) -> DataFrame:
    order = on_date().orderBy(F.desc_nulls_last("score") if best else F.asc_nulls_last("score"), INSTRUMENT)
    return signal.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def grouped_ensemble(predictions: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """(keys, datetime, instrument, score): models that share the keys become one by an aggregate, such as an average or the latest."""
    return predictions.groupBy(*keys, TIME, INSTRUMENT).agg(score.alias("score"))
