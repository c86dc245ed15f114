"""Operators on small series against pandas, and the rules for missing and infinite values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.functions import registry
from panelkite.operators.panel import Panel
from panelkite.plans.extent import INFINITE, extent, horizon
from panelkite.plans.parser import ExpressionError, parse
from panelkite.plans.tree import Field, node
from tests.helpers import make

X = [1.0, 3.0, None, 2.0, 5.0, 5.0, 4.0]


def panel(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("a", pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), i, *[c[i] for c in columns.values()]) for i in range(n)]
    schema = "instrument string, datetime timestamp_ntz, cal_idx int, " + ", ".join(f"{c} double" for c in columns)
    df = make(spark, rows, schema)
    return Panel(df, df.select("datetime", "cal_idx"))


def values(spark, expression, **columns):
    out = panel(spark, **columns).features({"v": expression}).orderBy("datetime").toPandas()["v"]
    return [None if v is None or v != v else float(v) for v in out]


def close(got, want, tolerance=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        w = None if w is None or w != w else w
        assert (g is None) == (w is None), (got, list(want))
        if w is not None:
            assert g == pytest.approx(w, abs=tolerance) or g == w, (got, list(want))


S = pd.Series(X, dtype=float)
ROLL = S.rolling(4, min_periods=1)
PANDAS = {
    "Mean($x,4)": ROLL.mean(),
    "Sum($x,4)": ROLL.sum(),
    "Std($x,4)": ROLL.std(),
    "Var($x,4)": ROLL.var(),
    "Skew($x,4)": ROLL.skew(),
    "Kurt($x,4)": ROLL.kurt(),
    "Max($x,4)": ROLL.max(),
    "Min($x,4)": ROLL.min(),
    "Med($x,4)": ROLL.median(),
    "Quantile($x,4,0.8)": ROLL.quantile(0.8),
    "Count($x,4)": ROLL.count(),
    "Rank($x,4)": ROLL.rank(pct=True),
    "Mad($x,4)": ROLL.apply(lambda x: np.nanmean(np.abs(x - np.nanmean(x))), raw=True),
    "IdxMax($x,4)": [1, 2, 3, 3, 2, 1, 2],
    "Ref($x,2)": S.shift(2),
    "Ref($x,-1)": S.shift(-1),
    "Ref($x,0)": [1.0] * 7,
    "Delta($x,1)": S.diff(),
    "EMA($x,0.5)": S.ewm(alpha=0.5, min_periods=1).mean(),
    "EMA($x,3)": S.ewm(span=3, min_periods=1).mean(),
    "Sum($x,0.5)": S.ewm(alpha=0.5, min_periods=1).mean(),
    "Mean($x,0)": S.expanding(1).mean(),
    "Std($x,0)": S.expanding(1).std(),
    "WMA($x,4)": [1, 1.1666666667, 0.5833333333, 0.5, 0.9666666667, 1.3, 1.075],
    "Slope($x,4)": [None, 2, 2, 0.2142857143, 0.5, 1.5, 0.6],
    "Resi($x,4)": [None, 0, None, -0.3571428571, 1, -0.5, -0.9],
    "FFillNan($x)": S.ffill(),
    "BFillNan($x)": S.bfill(),
}


@pytest.mark.parametrize("expression", PANDAS)
def test_series(spark, expression):
    close(values(spark, expression, x=X), list(PANDAS[expression]), 1e-6)


def test_expanding_decay_weights(spark):
    want = []
    for i in range(7):
        a = 1 - 2 / (1 + i + 1)
        w = a ** np.arange(i, -1, -1.0)
        want.append(np.nansum(w / w.sum() * np.array(X[: i + 1], float)))
    close(values(spark, "EMA($x,0)", x=X), want)


def test_infinities_are_missing_to_windows_but_counted(spark):
    x = [1.0, math.inf, 2.0, 3.0]
    close(values(spark, "Mean($x,2)", x=x), [1, 1, 2, 2.5])
    close(values(spark, "Count($x,2)", x=x), [1, 2, 2, 2])


def test_missing_prefix_and_constants(spark):
    close(values(spark, "Sum($x,2)", x=[None, None, 1.0]), [None, None, 1])
    close(values(spark, "Count($x,2)", x=[None, None, 1.0]), [0, 0, 1])
    flat = [2.0] * 6
    close(values(spark, "Rsquare($x,4)", x=flat), [None] * 6)
    close(values(spark, "Corr($x,$y,4)", x=flat, y=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), [None] * 6)
    close(values(spark, "Skew($x,4)", x=flat), [None, None, 0, 0, 0, 0])
    close(values(spark, "Kurt($x,4)", x=flat), [None, None, None, -3, -3, -3])


def test_pairs(spark):
    y = [2.0, 1.0, 4.0, None, 3.0, 6.0, 5.0]
    a, b = pd.Series(X, dtype=float), pd.Series(y, dtype=float)
    close(values(spark, "Cov($x,$y,4)", x=X, y=y), a.rolling(4, min_periods=1).cov(b))
    want = []
    for i in range(7):
        p, q = a[max(0, i - 3) : i + 1], b[max(0, i - 3) : i + 1]
        want.append(p.corr(q) if p.std() > 2e-5 and q.std() > 2e-5 else None)
    close(values(spark, "Corr($x,$y,4)", x=X, y=y), want)


def test_division_logarithm_and_power(spark):
    close(values(spark, "$x/$y", x=[1.0, -1.0, 0.0, None], y=[0.0, 0.0, 0.0, 1.0]), [math.inf, -math.inf, None, None])
    close(values(spark, "Log($x)", x=[1.0, 0.0, -1.0, None]), [0, -math.inf, None, None])
    close(values(spark, "$x**0.5", x=[4.0, -4.0]), [2, None])
    close(values(spark, "-$x", x=[1.0, None]), [-1, None])


def test_comparisons_with_missing_values(spark):
    x, y = [1.0, None, 2.0], [1.0, 1.0, None]
    for name, want in {"$x>=$y": [1, 0, 0], "$x==$y": [1, 0, 0], "$x!=$y": [0, 1, 1], "$x<$y": [0, 0, 0]}.items():
        close(values(spark, name, x=x, y=y), want)
    close(values(spark, "If($x>$y,1,2)", x=x, y=y), [2, 2, 2])
    close(values(spark, "If($x,1,2)", x=[0.0, None, 3.0]), [2, 1, 1])
    close(values(spark, "Greater($x,$y)", x=x, y=y), [1, None, None])
    close(values(spark, "Mean($x>$y,2)", x=[2.0, None, 0.0], y=[1.0] * 3), [1, 0.5, 0])
    close(values(spark, "IsNull($x)", x=[1.0, None]), [0, 1])
    close(values(spark, "IsInf($x)", x=[1.0, -math.inf]), [0, 1])


def test_a_slot_is_a_day_of_the_calendar(spark):
    days = pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06"])
    rows = [("a", days[0], 1.0), ("a", days[3], 4.0), ("b", days[1], 2.0), ("b", days[2], 3.0)]
    bars = make(spark, rows, "instrument string, datetime timestamp_ntz, x double")
    out = Panel.on_calendar(bars).features({"v": "Ref($x,1)", "m": "Mean($x,4)"}).toPandas().set_index(["instrument", "datetime"])
    assert len(out) == 6
    assert np.isnan(out.loc[("a", days[3]), "v"]) and out.loc[("a", days[3]), "m"] == 2.5
    assert out.loc[("b", days[2]), "v"] == 2.0


def test_time_frames_are_open_on_the_left(spark):
    at = pd.to_datetime(["2020-01-01 09:30:00", "2020-01-01 09:30:02", "2020-01-01 09:30:03", "2020-01-01 09:30:08"])
    ticks = make(spark, [("a", t, float(i + 1)) for i, t in enumerate(at)], "instrument string, datetime timestamp_ntz, x double")
    out = Panel.dense(ticks).features({"v": "Rolling($x,'3s','sum')", "r": "Rolling($x,2,'sum')"}).orderBy("datetime").toPandas()
    assert out.v.tolist() == [1, 3, 5, 4] and out.r.tolist() == [1, 3, 5, 7]
    binned = Panel.dense(ticks).features({"v": "TResample($x,'2s','sum')"}).orderBy("datetime").toPandas()
    assert [None if v != v else v for v in binned.v] == [1, 5, None, None, 4]


def test_days_of_minutes(spark):
    day = [pd.Timestamp("2020-01-01") + pd.Timedelta(minutes=570 + i) for i in range(120)] + [pd.Timestamp("2020-01-01") + pd.Timedelta(minutes=780 + i) for i in range(120)]
    x = [None if i % 7 == 3 else float(i % 5) for i in range(240)]
    bars = make(spark, [("a", t, v) for t, v in zip(day, x, strict=True)], "instrument string, datetime timestamp_ntz, x double")
    out = Panel.dense(bars).features({"c": "DayCumsum($x,'9:45','14:44')", "l": "DayLast($x)"}).orderBy("datetime").toPandas()
    s = pd.Series(x, dtype=float)
    s.iloc[:15] = 0
    s = s.cumsum()
    s.iloc[225:] = 0
    pd.testing.assert_series_equal(out.c, s, check_names=False)
    assert (out.l == 4.0).all()


def test_range_reads_history_but_returns_the_range(spark):
    p = panel(spark, x=[float(i) for i in range(30)])
    whole = p.features({"v": "Mean(Ref($x,2),5)+Ref($x,-1)"}).toPandas().set_index("datetime")
    part = p.features({"v": "Mean(Ref($x,2),5)+Ref($x,-1)"}, start="2020-01-10", end="2020-01-15").toPandas().set_index("datetime")
    assert len(part) == 6
    pd.testing.assert_frame_equal(part.sort_index(), whole.loc[part.index].sort_index())


def test_extents():
    for text, want in {"$x": (0, 0), "Mean($x,5)": (4, 0), "Ref(Mean($x,5),-2)": (4, 2), "Ref(Ref($x,-1),1)": (1, 1), "Mean($x,0)": (INFINITE, 0), "EMA($x,5)": (INFINITE, 0), "Mean(Ref($x,3)/$x,10)": (12, 0), "BFillNan($x)": (INFINITE, INFINITE), "Corr($x,Ref($y,1),10)": (10, 0)}.items():
        assert extent(parse(text)) == want, text
    assert [horizon(parse(t)) for t in ("Ref($close,-2)/Ref($close,-1)-1", "Ref($close,-5)/$close-1", "Ref($close,-1)/$close-1")] == [2, 5, 1]


def test_parser():
    assert parse("Mean($close, 5)/$close") == parse("Div(Mean($close,5),$close)")
    assert str(parse("$a+1>$b")) == "Gt(Add($a,1),$b)"
    assert Field("a") / 2 == parse("$a/2") and 1 - Field("a") == parse("1-$a")
    assert parse("~($a>1)") == parse("Not($a>1)") and node(3).value == 3
    for bad in ("__import__('os')", "$a.b", "[1,2]", "lambda: 1", "$a if $b else $c", "f(x=1)", "1 < 2 < 3", "a", "$a[", "_hidden($a)"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_unknown_operators_and_windows(spark):
    for bad in ("Nope($x)", "Mean($x,-1)", "Mean($x,$x)", "Skew($x,2)", "Kurt($x,3)", "$$x_q"):
        with pytest.raises(ExpressionError):
            values(spark, bad, x=X)


def test_one_shuffle_for_all_levels(spark):
    p = panel(spark, x=X, y=X)
    out = p.features({"a": "Std(Mean(Ref($x,1),3)/$x,5)", "b": "Corr($x,Delta($y,1),4)", "c": "Mean($x,0)"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_registered_operators(spark):
    registry.register("Twice", lambda x: x * 2)
    registry.register("Spread", lambda x, n, over: F.max(x).over(over) - F.min(x).over(over), window=True)
    try:
        close(values(spark, "Twice($x)", x=[1.0, None]), [2, None])
        close(values(spark, "Mean(Spread($x,2),2)", x=[1.0, 3.0, 7.0]), [0, 1, 3])
        assert extent(parse("Spread($x,3)")) == (2, 0)
        with pytest.warns(UserWarning):
            registry.register("Mean", lambda x, n: x)
    finally:
        for name in ("Twice", "Spread", "Mean"):
            registry.unregister(name)


def test_lookups_and_row_sets(spark):
    rows = [(w, pd.Timestamp(f"2020-01-0{d}"), float(d * (1 if w == "a" else 10))) for w in ("a", "b") for d in (1, 2, 3)]
    p = Panel.on_calendar(make(spark, rows, "instrument string, datetime timestamp_ntz, x double"))
    out = p.features({"v": "$x/ChangeInstrument('b',Mean($x,2))"}, instruments=["a"]).orderBy("datetime").toPandas()
    assert out.v.tolist() == pytest.approx([0.1, 2 / 15, 3 / 25])
    out = p.features({"s": "Select($x>15,$x)", "c": "Cut($x,1,-1)"}).toPandas()
    assert len(out) == 3 and sorted(out.s.dropna()) == [20, 30] and sorted(out.c.dropna()) == [2, 20]
    spans = p.features({"v": "Ref($x,1)"}, instruments={"a": [("2020-01-02", "2020-01-02")], "b": [("2020-01-01", "2020-01-01"), ("2020-01-03", "2020-01-03")]}).toPandas()
    assert len(spans) == 3 and spans[spans.instrument == "a"].v.tolist() == [1.0]
