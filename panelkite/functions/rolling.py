"""Rolling, expanding and pairwise operators as native window expressions.

`over` is a frame of the last N slots, or of all slots so far.  Short prefixes
give values.  Infinities count as missing, only `count` sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from panelkite.functions.elementwise import known, number

#: Standard deviations up to this count as zero where a correlation is asked for.
FLAT = 2e-5


def _moments(x: Column, over: WindowSpec) -> tuple[Column, Column]:
    return F.count(x).over(over), F.stddev_pop(x).over(over)


def skew(x: Column, over: WindowSpec) -> Column:
    n, spread = _moments(x, over)
    unbiased = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness(x).over(over)
    return F.when(n >= 3, F.when(spread == 0, F.lit(0.0)).otherwise(known(unbiased)))


def kurt(x: Column, over: WindowSpec) -> Column:
    n, spread = _moments(x, over)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    unbiased = scale * ((n + 1) * F.kurtosis(x).over(over) + 6)
    return F.when(n >= 4, F.when(spread == 0, F.lit(-3.0)).otherwise(known(unbiased)))


def gathered(x: Column, over: WindowSpec) -> Column:
    """The frame's values in order, missing ones included."""
    return F.flatten(F.collect_list(F.array(x)).over(over))


def place_of(x: Column, over: WindowSpec, largest: bool) -> Column:
    """1-based place of the first extreme in the frame; a missing value wins over any number."""
    wins = F.lit(float("inf") if largest else float("-inf"))
    values = F.transform(gathered(x, over), lambda v: F.coalesce(v, wins))
    best = F.array_max(values) if largest else F.array_min(values)
    return F.when(F.count(x).over(over) > 0, F.array_position(values, best).cast("double"))


def mean_deviation(x: Column, over: WindowSpec) -> Column:
    values, mean = F.collect_list(x).over(over), F.avg(x).over(over)
    total = F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.size(values))


def rank(x: Column, over: WindowSpec) -> Column:
    """The last value's percentile rank in its frame, ties averaged."""
    values = F.collect_list(x).over(over)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (equal + 1) / 2) / F.size(values))


def weighted(x: Column, over: WindowSpec, corrected: bool = False) -> Column:
    """Linearly weighted mean.  As usual in the language it is divided by the number of values once more; `corrected` isn't."""
    values = gathered(x, over)
    n = F.size(values)
    parts = F.transform(values, lambda v, i: v * (i + 1) / (n * (n + 1) / 2))
    total = F.aggregate(F.filter(parts, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    many = F.count(x).over(over)
    return F.when(many > 0, total if corrected else total / many)


def slope(x: Column, at: Column, over: WindowSpec) -> Column:
    return known(F.regr_slope(x, at).over(over))


def residual(x: Column, at: Column, over: WindowSpec) -> Column:
    return known(x - (F.regr_slope(x, at).over(over) * at + F.regr_intercept(x, at).over(over)))


def rsquare(x: Column, at: Column, over: WindowSpec, expanding: bool) -> Column:
    value = known(F.regr_r2(x, at).over(over))
    return value if expanding else F.when(F.stddev_samp(x).over(over) > FLAT, value)


def correlation(a: Column, b: Column, over: WindowSpec) -> Column:
    moves = (F.stddev_samp(a).over(over) > FLAT) & (F.stddev_samp(b).over(over) > FLAT)
    # Pairs with a missing side don't count.  Spark's own corr() fails on a window without variance.
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(a).over(over) * F.stddev_pop(b).over(over)
    return F.when(moves, F.try_divide(F.covar_pop(a, b).over(over), F.nullif(spread, F.lit(0.0))))


def covariance(a: Column, b: Column, over: WindowSpec) -> Column:
    return known(F.covar_samp(a, b).over(over))


#: Operators of one series that are one window function.
SIMPLE = {
    "Mean": lambda x, w: F.avg(x).over(w),
    "Sum": lambda x, w: F.sum(x).over(w),
    "Std": lambda x, w: F.stddev_samp(x).over(w),
    "Var": lambda x, w: F.var_samp(x).over(w),
    "Skew": skew,
    "Kurt": kurt,
    "Max": lambda x, w: F.max(x).over(w),
    "Min": lambda x, w: F.min(x).over(w),
    "IdxMax": lambda x, w: place_of(x, w, True),
    "IdxMin": lambda x, w: place_of(x, w, False),
    "Med": lambda x, w: F.percentile(x, F.lit(0.5)).over(w),
    "Mad": mean_deviation,
    "Rank": rank,
    "WMA": weighted,
    "WMAFixed": lambda x, w: weighted(x, w, True),
}


def simple(name: str, x: Column, over: WindowSpec) -> Column:
    """x is a finite number, for Count as it is."""
    if name == "Count":
        return F.count(known(number(x))).over(over).cast("double")
    return SIMPLE[name](x, over)


def quantile(x: Column, q: float, over: WindowSpec) -> Column:
    return F.percentile(x, F.lit(q)).over(over)
