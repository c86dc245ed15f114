"""Queries of the expression language: one operator each, over bars, with SQL written from its definition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.functions import elementwise, registry
from panelkite.operators import factors
from panelkite.operators.panel import Panel
from panelkite.plans.compiler import INSTRUMENT, TIME
from panelkite.queries import sql
from panelkite.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, signed: bool = False) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(INSTRUMENT, TIME, *[(elementwise.rounded(F.col(c), digits, signed) if kinds[c] == "double" else F.col(c)).alias(c) for c in df.columns if c not in (INSTRUMENT, TIME)])


def _query(fields: dict[str, str], panel: Callable[[SparkSession, str], Panel], digits: int, signed: bool = False) -> Query:
    return lambda spark, folder: rounded(panel(spark, folder).features(fields), digits, signed)


#: name: (expression, SQL over one level of lags c1 = close before, v1 = volume before).
ROW = {
    "abs": ("Abs($close-$open)", "abs(close - open)"),
    "sign": ("Sign($close-$open)", "CAST(sign(close - open) AS DOUBLE)"),
    "log": ("Log($volume)", "ln(volume)"),
    "power": ("Power($close/$open,2)", "pow(close / open, 2)"),
    "add": ("$close+$open", "close + open"),
    "sub": ("$close-$open", "close - open"),
    "mul": ("$close*$volume", "close * volume"),
    "div": ("($volume-Ref($volume,1))/($close-$open)", "CASE WHEN close <> open THEN (volume - v1) / (close - open) WHEN volume > v1 THEN 'inf'::DOUBLE WHEN volume < v1 THEN '-inf'::DOUBLE END"),
    "greater": ("Greater($close,Ref($close,1))", "CASE WHEN c1 IS NOT NULL THEN greatest(close, c1) END"),
    "less": ("Less($close,Ref($close,1))", "CASE WHEN c1 IS NOT NULL THEN least(close, c1) END"),
    "gt": ("$close>Ref($close,1)", "coalesce(close > c1, false)"),
    "ge": ("$close>=Ref($close,1)", "coalesce(close >= c1, false)"),
    "lt": ("$close<Ref($close,1)", "coalesce(close < c1, false)"),
    "le": ("$close<=Ref($close,1)", "coalesce(close <= c1, false)"),
    "eq": ("$close==$open", "coalesce(close = open, false)"),
    "ne": ("$close!=Ref($close,1)", "coalesce(close <> c1, true)"),
    "and": ("($close>$open)&($volume>Ref($volume,1))", "close > open AND coalesce(volume > v1, false)"),
    "or": ("($close>$open)|($volume>Ref($volume,1))", "close > open OR coalesce(volume > v1, false)"),
    "not": ("Not($close>$open)", "NOT close > open"),
    "if_": ("If($close>Ref($close,1),$high,$low)", "CASE WHEN coalesce(close > c1, false) THEN high ELSE low END"),
    "is_null": ("IsNull(Ref($close,1))", "c1 IS NULL"),
    "is_inf": ("IsInf(($close-Ref($close,1))/($volume-Ref($volume,1)))", "coalesce(volume = v1 AND close <> c1, false)"),
    "date_of": ("Date($close)", "CAST(datetime AS DATE)"),
}
_BIASED_KURT = "kurtosis({x}) OVER {w}"
#: name: (expression, SQL with windows w5, w10, w20, e and i, and lists cs, hs, ls of the last 5).
ROLLING = {
    "ref_past": ("Ref($close,3)/$close", "lag(close, 3) OVER i / close"),
    "ref_future": ("Ref($close,-2)/$close", "lead(close, 2) OVER i / close"),
    "ref_first": ("Ref($close,0)/$close", "first_value(close) OVER e / close"),
    "roll_mean": ("Mean($close,5)/$close", "avg(close) OVER w5 / close"),
    "roll_sum": ("Sum($volume,5)", "sum(volume) OVER w5"),
    "roll_std": ("Std($close,5)/$close", "stddev_samp(close) OVER w5 / close"),
    "roll_var": ("Var($close,5)/($close*$close)", "var_samp(close) OVER w5 / (close * close)"),
    "roll_skew": ("Skew($close,10)", "CASE WHEN count(close) OVER w10 >= 3 THEN skewness(close) OVER w10 END"),
    "roll_kurt": ("Kurt($close,10)", "CASE WHEN count(close) OVER w10 >= 4 THEN kurtosis(close) OVER w10 END"),
    "roll_max": ("Max($high,5)/$close", "max(high) OVER w5 / close"),
    "roll_min": ("Min($low,5)/$close", "min(low) OVER w5 / close"),
    "roll_quantile": ("Quantile($close,5,0.8)/$close", "quantile_cont(close, 0.8) OVER w5 / close"),
    "roll_med": ("Med($close,5)/$close", "quantile_cont(close, 0.5) OVER w5 / close"),
    "roll_count": ("Count($close,5)", "CAST(count(close) OVER w5 AS DOUBLE)"),
    "roll_delta": ("Delta($close,3)/$close", "(close - lag(close, 3) OVER i) / close"),
    "roll_slope": ("Slope($close,5)/$close", "regr_slope(close, cal_idx) OVER w5 / close"),
    "roll_rsquare": ("Rsquare($close,5)", "CASE WHEN stddev_samp(close) OVER w5 > 2e-5 THEN regr_r2(close, cal_idx) OVER w5 END"),
    "roll_resi": ("Resi($close,5)/$close", "(close - regr_slope(close, cal_idx) OVER w5 * cal_idx - regr_intercept(close, cal_idx) OVER w5) / close"),
    "roll_corr": ("Corr($close,$volume,10)", "CASE WHEN stddev_samp(close) OVER w10 > 2e-5 AND stddev_samp(volume) OVER w10 > 2e-5 THEN corr(close, volume) OVER w10 END"),
    "roll_cov": ("Cov($close,$volume,10)/$close", "covar_samp(close, volume) OVER w10 / close"),
    "expanding_mean": ("Mean($close,0)/$close", "avg(close) OVER e / close"),
    "expanding_std": ("Std($close,0)/$close", "stddev_samp(close) OVER e / close"),
    "expanding_max": ("Max($high,0)/$close", "max(high) OVER e / close"),
    "expanding_slope": ("Slope($close,0)/$close", "regr_slope(close, cal_idx) OVER e / close"),
    "expanding_corr": ("Corr($close,$volume,0)", "CASE WHEN stddev_samp(close) OVER e > 2e-5 AND stddev_samp(volume) OVER e > 2e-5 THEN corr(close, volume) OVER e END"),
}
LISTS = {
    "roll_idxmax": ("IdxMax($high,5)", "CAST(list_position(hs, list_max(hs)) AS DOUBLE)"),
    "roll_idxmin": ("IdxMin($low,5)", "CAST(list_position(ls, list_min(ls)) AS DOUBLE)"),
    "roll_mad": ("Mad($close,5)/$close", "list_avg(list_transform(cs, lambda v: abs(v - list_avg(cs)))) / close"),
    "roll_rank": ("Rank($close,5)", "(len(list_filter(cs, lambda v: v < close)) + (len(list_filter(cs, lambda v: v = close)) + 1) / 2.0) / len(cs)"),
    "roll_wma": ("WMA($close,5)/$close", "list_sum(list_transform(cs, lambda v, i: v * i)) / (len(cs) * (len(cs) + 1) / 2.0) / len(cs) / close"),
    "roll_wma_fixed": ("WMAFixed($close,5)/$close", "list_sum(list_transform(cs, lambda v, i: v * i)) / (len(cs) * (len(cs) + 1) / 2.0) / close"),
}
#: Rolling families as SQL, with d for the window; c1 and v1 are the slot before.
FAMILY_SQL = {
    "ROC": "lag(close, {d}) OVER i / close",
    "MA": "avg(close) OVER w{d} / close",
    "STD": "stddev_samp(close) OVER w{d} / close",
    "BETA": "regr_slope(close, cal_idx) OVER w{d} / close",
    "RSQR": "CASE WHEN stddev_samp(close) OVER w{d} > 2e-5 THEN regr_r2(close, cal_idx) OVER w{d} END",
    "RESI": "(close - regr_slope(close, cal_idx) OVER w{d} * cal_idx - regr_intercept(close, cal_idx) OVER w{d}) / close",
    "MAX": "max(high) OVER w{d} / close",
    "LOW": "min(low) OVER w{d} / close",
    "QTLU": "quantile_cont(close, 0.8) OVER w{d} / close",
    "QTLD": "quantile_cont(close, 0.2) OVER w{d} / close",
    "RANK": "(len(list_filter(cs{d}, lambda v: v < close)) + (len(list_filter(cs{d}, lambda v: v = close)) + 1) / 2.0) / len(cs{d})",
    "RSV": "(close - min(low) OVER w{d}) / (max(high) OVER w{d} - min(low) OVER w{d} + 1e-12)",
    "IMAX": "list_position(hs{d}, list_max(hs{d})) / {d}.0",
    "IMIN": "list_position(ls{d}, list_min(ls{d})) / {d}.0",
    "IMXD": "(list_position(hs{d}, list_max(hs{d})) - list_position(ls{d}, list_min(ls{d}))) / {d}.0",
    "CORR": "CASE WHEN stddev_samp(close) OVER w{d} > 2e-5 AND stddev_samp(ln(volume + 1)) OVER w{d} > 2e-5 THEN corr(close, ln(volume + 1)) OVER w{d} END",
    "CORD": "CASE WHEN stddev_samp(close / c1) OVER w{d} > 2e-5 AND stddev_samp(ln(volume / v1 + 1)) OVER w{d} > 2e-5 THEN corr(close / c1, ln(volume / v1 + 1)) OVER w{d} END",
    "CNTP": "avg(up) OVER w{d}",
    "CNTN": "avg(down) OVER w{d}",
    "CNTD": "avg(up) OVER w{d} - avg(down) OVER w{d}",
    "SUMP": "sum(greatest(close - c1, CASE WHEN c1 IS NOT NULL THEN 0 END)) OVER w{d} / (sum(abs(close - c1)) OVER w{d} + 1e-12)",
    "SUMN": "sum(CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END) OVER w{d} / (sum(abs(close - c1)) OVER w{d} + 1e-12)",
    "SUMD": "(sum(CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END) OVER w{d} - sum(CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END) OVER w{d}) / (sum(abs(close - c1)) OVER w{d} + 1e-12)",
    "VMA": "avg(volume) OVER w{d} / (volume + 1e-12)",
    "VSTD": "stddev_samp(volume) OVER w{d} / (volume + 1e-12)",
    "WVMA": "stddev_samp(abs(close / c1 - 1) * volume) OVER w{d} / (avg(abs(close / c1 - 1) * volume) OVER w{d} + 1e-12)",
    "VSUMP": "sum(CASE WHEN v1 IS NOT NULL THEN greatest(volume - v1, 0) END) OVER w{d} / (sum(abs(volume - v1)) OVER w{d} + 1e-12)",
    "VSUMN": "sum(CASE WHEN v1 IS NOT NULL THEN greatest(v1 - volume, 0) END) OVER w{d} / (sum(abs(volume - v1)) OVER w{d} + 1e-12)",
    "VSUMD": "(sum(CASE WHEN v1 IS NOT NULL THEN greatest(volume - v1, 0) END) OVER w{d} - sum(CASE WHEN v1 IS NOT NULL THEN greatest(v1 - volume, 0) END) OVER w{d}) / (sum(abs(volume - v1)) OVER w{d} + 1e-12)",
}
CANDLE_SQL = {
    "KMID": "(close - open) / open",
    "KLEN": "(high - low) / open",
    "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": "(high - greatest(open, close)) / open",
    "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open",
    "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open",
    "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
}
_TEXT = {"date_of", "gt", "ge", "lt", "le", "eq", "ne", "and", "or", "not", "is_null", "is_inf"}
LAGGED = """l AS (
  SELECT *, lag(close) OVER i AS c1, lag(volume) OVER i AS v1,
         CASE WHEN close > lag(close) OVER i THEN 1.0 ELSE 0.0 END AS up, CASE WHEN close < lag(close) OVER i THEN 1.0 ELSE 0.0 END AS down
  FROM b WINDOW i AS (PARTITION BY instrument ORDER BY cal_idx))"""


def _row_sql(name: str, expression: str) -> str:
    value = expression if name in _TEXT else f"round({expression}, 6)"
    return f"WITH {sql.DENSE}, {LAGGED} SELECT instrument, datetime, {value} AS v FROM l"


def _list_sql(expression: str) -> str:
    return f"""WITH {sql.DENSE}, q AS (SELECT *, list(close) OVER w5 AS cs, list(high) OVER w5 AS hs, list(low) OVER w5 AS ls FROM b {sql.windows(5)})
SELECT instrument, datetime, {sql.finite(expression)} AS v FROM q"""


def _family_sql(family: str, sizes: tuple[int, ...]) -> str:
    lists = "".join(f", list(close) OVER w{d} AS cs{d}, list(high) OVER w{d} AS hs{d}, list(low) OVER w{d} AS ls{d}" for d in sizes) if "list" in FAMILY_SQL[family] else ""
    column = "MIN" if family == "LOW" else family
    values = ", ".join(f"{FAMILY_SQL[family].format(d=d)} AS {column}{d}" for d in sizes)
    outer = ", ".join(f"{sql.finite(f'{column}{d}')} AS {column}{d}" for d in sizes)
    return f"WITH {sql.DENSE}, {LAGGED}, q AS (SELECT *{lists} FROM l {sql.windows(*sizes)}), r AS (SELECT instrument, datetime, {values} FROM q {sql.windows(*sizes)}) SELECT instrument, datetime, {outer} FROM r"


def _ema_sql(decay: float) -> str:
    keep = 1 - decay
    return f"""WITH {sql.DENSE}
SELECT a.instrument, a.datetime, round(sum(z.close * pow({keep!r}, a.cal_idx - z.cal_idx)) / sum(pow({keep!r}, a.cal_idx - z.cal_idx)) / any_value(a.close), 6) AS v
FROM b a JOIN b z ON a.instrument = z.instrument AND z.cal_idx <= a.cal_idx GROUP BY a.instrument, a.datetime"""


def _clipped(spark: SparkSession, folder: str) -> DataFrame:
    """An operator that a user registers: values cut to a band."""
    registry.register("Clip", lambda x, low, high: F.greatest(F.least(x, high), low))
    try:
        return rounded(tables.dense_panel(spark, folder).features({"v": "Clip($close/Ref($close,1)-1,-0.5,0.5)"}), 6)
    finally:
        registry.unregister("Clip")


def _shared_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(tables.spine_panel(spark, folder).features({"v": "$close/ChangeInstrument(1,$close)"}), 6)


def _mask(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(tables.spine_panel(spark, folder).features({"v": "Mask($volume,2)"}), 6)


def _excess(spark: SparkSession, folder: str) -> DataFrame:
    own = "($close/Ref($close,1)-1)"
    other = f"ChangeInstrument(1,{own})"
    return rounded(tables.spine_panel(spark, folder).features({"v": f"{own}-Cov({own},{other},60)/Var({other},60)*{other}"}), 4)


def _time_range(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Panel.dense(tables.ticks(spark, folder)).features({"v": "Rolling($value,'7200s','sum')"}), 4)


def _ranged(spark: SparkSession, folder: str) -> DataFrame:
    """A range of days: windows see the days before it."""
    return rounded(tables.dense_panel(spark, folder).features({"v": "Mean($close,20)/$close"}, start="1995-01-01", end="1995-12-31"), 6)


SIZES = (5, 20)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"flagship_mean_ratio": _query({"v": "Mean($close,5)/$close"}, tables.spine_panel, 6)}
    for name, (expression, _) in {**ROW, **ROLLING, **LISTS}.items():
        # Where one operator works on one row, a zero's sign is as certain as the value; sums of frames leave it open.
        out[name] = _query({"v": expression}, tables.dense_panel, 6, name in ROW)
    for name, (expression, _) in ROLLING.items():
        if name in ("roll_std", "roll_max", "roll_slope", "roll_count", "roll_quantile"):
            out[f"{name}_spine"] = _query({"v": expression}, tables.spine_panel, 6)
    for family in factors.FAMILIES:
        out[f"factor_{family.lower()}"] = _query(factors.rolling(SIZES, (family,)), tables.dense_panel, 6)
    out |= {
        "factor_candles": _query(factors.CANDLES, tables.dense_panel, 6),
        "factor_prices": _query(factors.prices(("OPEN", "HIGH", "LOW", "VWAP"), (0,)), tables.dense_panel, 6),
        "factor_volumes": _query(factors.volumes(), tables.dense_panel, 6),
        "factor_lags": _query({k: v for k, v in factors.factors360().items() if k in ("CLOSE59", "CLOSE0", "OPEN30", "VWAP1", "VOLUME59", "VOLUME0")}, tables.dense_panel, 6),
        "factor_label": _query(factors.LABEL, tables.dense_panel, 6),
        "factor_benchmark": _query(factors.BENCHMARK, tables.dense_panel, 6),
        "ema_span": _query({"v": "EMA($close,5)/$close"}, tables.dense_panel, 6),
        "ema_alpha": _query({"v": "EMA($close,0.2)/$close"}, tables.dense_panel, 6),
        "ema_by_fraction": _query({"v": "Sum($close,0.2)/$close"}, tables.dense_panel, 6),
        "ffill": _query({"v": "FFillNan($close)"}, tables.spine_panel, 6),
        "bfill": _query({"v": "BFillNan($close)"}, tables.spine_panel, 6),
        "select_rows": _query({"v": "Select($close>$open,$close)"}, tables.dense_panel, 6),
        "cut": _query({"v": "Cut($close,3,-2)"}, tables.dense_panel, 6),
        "change_instrument": _shared_benchmark,
        "mask": _mask,
        "beta_excess_return": _excess,
        "roll_time_range": _time_range,
        "range_widening": _ranged,
        "custom_op_registered": _clipped,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {"flagship_mean_ratio": f"WITH {sql.SPINE} SELECT instrument, datetime, round(avg(close) OVER w5 / close, 6) AS v FROM b {sql.windows(5)}"}
    out |= {name: _row_sql(name, e) for name, (_, e) in ROW.items()}
    for name, (_, e) in ROLLING.items():
        out[name] = f"WITH {sql.DENSE}, r AS (SELECT instrument, datetime, {e} AS x FROM b {sql.windows(5, 10)}) SELECT instrument, datetime, {sql.finite('x')} AS v FROM r"
        if name in ("roll_std", "roll_max", "roll_slope", "roll_count", "roll_quantile"):
            out[f"{name}_spine"] = out[name].replace(sql.DENSE, sql.SPINE)
    out |= {name: _list_sql(e) for name, (_, e) in LISTS.items()}
    out |= {f"factor_{f.lower()}": _family_sql(f, SIZES) for f in factors.FAMILIES}
    plain = lambda values: f"WITH {sql.DENSE} SELECT instrument, datetime, {', '.join(f'round({e}, 6) AS {n}' for n, e in values.items())} FROM b {sql.windows()}"
    out["factor_candles"] = plain(CANDLE_SQL)
    out["factor_prices"] = plain({f"{f}0": f"{f.lower()} / close" for f in ("OPEN", "HIGH", "LOW", "VWAP")})
    out["factor_volumes"] = plain({f"VOLUME{d}": f"lag(volume, {d}) OVER i / (volume + 1e-12)" for d in range(5)})
    out["factor_lags"] = plain({"CLOSE59": "lag(close, 59) OVER i / close", "OPEN30": "lag(open, 30) OVER i / close", "VWAP1": "lag(vwap, 1) OVER i / close", "CLOSE0": "close / close", "VOLUME59": "lag(volume, 59) OVER i / (volume + 1e-12)", "VOLUME0": "volume / (volume + 1e-12)"})
    out["factor_label"] = plain({"LABEL0": "lead(close, 2) OVER i / lead(close, 1) OVER i - 1"})
    names = {**{k: CANDLE_SQL[k] for k in ("KMID", "KLEN", "KUP", "KLOW")}, **{f"{'MIN' if f == 'LOW' else f}20": FAMILY_SQL[f].format(d=20) for f in ("ROC", "MA", "STD", "BETA", "MAX", "LOW", "CORR", "CNTP", "SUMP", "VMA")}}
    inner = ", ".join(f"{e} AS {n}" for n, e in names.items())
    out["factor_benchmark"] = f"WITH {sql.DENSE}, {LAGGED}, r AS (SELECT instrument, datetime, {inner} FROM l {sql.windows(20)}) SELECT instrument, datetime, {', '.join(f'{sql.finite(n)} AS {n}' for n in names)} FROM r"
    out |= {"ema_span": _ema_sql(2 / 6), "ema_alpha": _ema_sql(0.2), "ema_by_fraction": _ema_sql(0.2)}
    fill = "WITH {0} SELECT instrument, datetime, {1}(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN {2}) AS v FROM b"
    out["ffill"] = fill.format(sql.SPINE, "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")
    out["bfill"] = fill.format(sql.SPINE, "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")
    out["select_rows"] = f"WITH {sql.DENSE} SELECT instrument, datetime, close AS v FROM b WHERE close > open"
    out["cut"] = f"WITH {sql.DENSE}, n AS (SELECT *, count(*) OVER (PARTITION BY instrument) AS n FROM b) SELECT instrument, datetime, close AS v FROM n WHERE cal_idx >= 3 AND cal_idx < n - 2"
    one = "(SELECT cal_idx, {0} FROM b WHERE instrument = {1})"
    out["change_instrument"] = f"WITH {sql.SPINE} SELECT b.instrument, b.datetime, round(b.close / o.x, 6) AS v FROM b LEFT JOIN {one.format('close AS x', 1)} o USING (cal_idx)"
    out["mask"] = f"WITH {sql.SPINE} SELECT b.instrument, b.datetime, o.x AS v FROM b LEFT JOIN {one.format('volume AS x', 2)} o USING (cal_idx)"
    out["beta_excess_return"] = f"""WITH {sql.SPINE}, r AS (SELECT *, close / lag(close) OVER i - 1 AS r FROM b {sql.windows()}),
o AS (SELECT cal_idx, r AS m FROM r WHERE instrument = 1), j AS (SELECT r.*, o.m FROM r LEFT JOIN o USING (cal_idx)),
k AS (SELECT instrument, datetime, r - covar_samp(r, m) OVER w60 / nullif(var_samp(m) OVER w60, 0) * m AS v FROM j {sql.windows(60)})
SELECT instrument, datetime, {sql.finite('v', 4)} AS v FROM k"""
    out["roll_time_range"] = "SELECT user_id AS instrument, ts AS datetime, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW), 4) AS v FROM events"
    out["range_widening"] = f"WITH {sql.DENSE}, r AS (SELECT instrument, datetime, round(avg(close) OVER w20 / close, 6) AS v FROM b {sql.windows(20)}) SELECT * FROM r WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'"
    out["custom_op_registered"] = f"WITH {sql.DENSE}, {LAGGED} SELECT instrument, datetime, round(CASE WHEN c1 IS NULL THEN 0.5 ELSE greatest(least(close / c1 - 1, 0.5), -0.5) END, 6) AS v FROM l"
    return out
