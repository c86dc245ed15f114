"""Factor sets in NumPy give what Spark's windows give, whatever the rows and the batches."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelkite.functions import registry
from panelkite.operators import factors
from panelkite.operators.panel import Panel
from panelkite.plans import vectors
from panelkite.plans.parser import parse
from panelkite.queries import workflow
from tests.helpers import make

SF = "/root/testdata/sf0.001"
BARS = "instrument long, datetime timestamp_ntz, open double, high double, low double, close double, volume double, vwap double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_bars(spark):
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]

    def value(i):
        if i == 4 and rng.random() < 0.5 or rng.random() < 0.08:
            return odd[rng.integers(len(odd))]
        return float(rng.integers(1, 6)) if i in (3, 4) else float(np.round(rng.uniform(-5, 100), 2))

    rows = [(i, pd.Timestamp(2020, 1, 1) + pd.Timedelta(days=t), *[value(i) for _ in range(6)]) for i, n in ((1, 1), (2, 2), (3, 40), (4, 40), (5, 70), (None, 30)) for t in range(n)]
    rows += [(6, pd.Timestamp(2020, 1, 1) + pd.Timedelta(days=t), *[7.1] * 6) for t in range(15)]
    return Panel.dense(make(spark, rows, BARS))


def same(got, want):
    got, want = ({(r["instrument"], r["datetime"]): r for r in f.collect()} for f in (got, want))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for c, w in row.asDict().items():
            g = got[key][c]
            if isinstance(w, float) and g is not None:
                assert g == pytest.approx(w, rel=1e-6, abs=1e-7, nan_ok=True), (key, c)
            else:
                assert g == w, (key, c)


def test_factors158_evaluates_no_frame_anew(spark):
    text = plan(workflow.factors158(spark, SF))
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "RowFrame, -" not in text


def test_factors360_is_one_pass_without_windows_of_past_slots(spark):
    text = plan(workflow.factors360(spark, SF))
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "lag(" not in text


def test_past_slots_of_odd_rows(spark):
    panel, fields = odd_bars(spark), factors.factors360()
    fields = {c: fields[c] for c in fields if c.endswith(("0", "1", "39", "59"))}
    same(panel.feature_set(fields), panel.features(fields))


def test_wide_sets_take_fewer_rows_at_a_time():
    trees = {f"c{d}": parse(f"Ref($x,{d})/$x") for d in range(1, 361)}
    rows = pa.RecordBatch.from_pydict({"k": range(9_000), "slot": range(9_000), "before": range(9_000), "x": np.arange(9_000) + 1.0})
    done = list(vectors.over_batches(trees, None, ["k"], "slot", "before")([rows]))
    assert sum(b.num_rows for b in done) == 9_000 and max(b.num_rows * b.num_columns for b in done) < 2_000_000
    last = pa.Table.from_batches(done).to_pandas()["c360"]
    assert last[:360].isna().all() and np.allclose(last[360:], np.arange(1, 8_641) / np.arange(361, 9_001))


@pytest.mark.parametrize("families", [list(factors.FAMILIES)[i::3] for i in range(3)], ids=["first", "second", "third"])
def test_odd_rows_in_small_batches(spark, families):
    panel = odd_bars(spark)
    fields = factors.rolling((2, 7, 12), families) | (factors.CANDLES | factors.prices(("OPEN", "VWAP"), (0,)) if families[0] == "ROC" else {})
    want = panel.features(fields)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        got = panel.feature_set(fields)
        assert "MapInArrow" in plan(got)
        same(got, want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_own_nan_of_fields(spark):
    fields = {
        "t": "($open>$close)+($high>$low)", "u": "Mean(Ref($open>$close,1),3)", "v": "Sum(($open>$close)<($high>$low),2)", "w": "Sum(2,3)",
        "g": "Greater($open,$close)", "l": "Less($open,$close)", "a": "Abs($open)", "o": "Log($open)", "d": "Div(Abs($open),$close)",
        **{f"{c}{d}": f"Mean({c}(Ref($open,1),$close),{d})" for c in ("Gt", "Ge", "Lt", "Le") for d in (1, 4)},
    }
    panel = odd_bars(spark)
    same(panel.feature_set(fields), panel.features(fields))
    same(panel.feature_set({"x": "$close/$open", "y": "$missing+1"}, 3), panel.feature_set({"x": "$close/$open", "y": "$missing+1", "z": "EMA($close,3)"}, 3).drop("z"))


def test_what_is_not_there_goes_through_windows(spark):
    for text in ("Mean($close,0)", "Ref($close,-1)+1", "EMA($close,5)", "Sum($close,0.5)", "$close", "Skew($close,5)", "Ref($close,1)", "Quantile($close,5)"):
        assert not vectors.fit([parse(text)])
    assert vectors.fit(map(parse, factors.factors158().values()))
    try:
        with pytest.warns(UserWarning):
            registry.register("Mean", lambda x, n, over: x, window=True)
        assert not vectors.fit([parse("Mean($close,5)")])
    finally:
        registry.unregister("Mean")


def test_large_numbers_keep_small_spreads():
    n = 200
    x = 1e9 + np.arange(n) % 3 / 8
    steps, places = vectors.compiled({"s": parse("Std($x,60)"), "m": parse("Mean($x,60)")})
    batch = vectors.Batch(steps, {"x": x}, {"x": np.zeros(n, bool)}, np.arange(n, dtype=float), np.arange(n))
    want = pd.Series(x - 1e9).rolling(60, min_periods=2).std().to_numpy()
    np.testing.assert_allclose(batch.values[places["s"]][1:], want[1:], rtol=1e-6)
    assert math.isnan(batch.values[places["s"]][0])


def test_interpolation_is_rounded_once():
    rng = np.random.default_rng(0)
    a, b, c = rng.uniform(900, 1e5, 20000).round(2), rng.random(20000), rng.uniform(0, 1e5, 20000)
    assert [math.fma(*map(float, t)) for t in zip(a, b, c, strict=True)] == vectors.fused(a, b, c).tolist()
