"""What large tables ask for: no task holds a whole panel, and instruments are dealt out once."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from panelkite.operators import covariance, evaluation, joins, simulate
from panelkite.operators.panel import calendar_of
from panelkite.queries import analysis
from panelkite.sources import tables
from tests.helpers import make

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_and_windows_share_one_exchange(spark):
    features = tables.dense_panel(spark, SF).features({"x": "$close/Ref($close,1)", "y": "Mean($volume,5)"})
    assert plan(features).count("Exchange hashpartitioning") == 1


def test_soft_weights_ask_for_the_best_of_dates_only(spark):
    rows = [(pd.Timestamp(2020, 1, day), i, float((i * 7 + day) % 5)) for day in range(1, 9) for i in range(20)]
    best = simulate.best_of_dates(make(spark, rows, "datetime timestamp_ntz, instrument long, score double"), 3).toPandas()
    assert len(best) == 24
    frame = pd.DataFrame(rows, columns=["datetime", "instrument", "score"])
    whole, cut = {}, {}
    for when, day in frame.groupby("datetime"):
        few = best[best["datetime"] == when]
        whole = simulate.soft_weights(dict(zip(day["instrument"], day["score"], strict=True)), whole, 3, 0.95, 0.2)
        cut = simulate.soft_weights(dict(zip(few["instrument"], few["score"], strict=True)), cut, 3, 0.95, 0.2)
        assert cut == whole


def test_variances_are_the_diagonal(spark):
    rng = np.random.default_rng(0)
    rows = [(i, pd.Timestamp(2020, 1, 1) + pd.Timedelta(days=int(t)), None if t % 9 == i else float(rng.normal(i))) for i in range(6) for t in range(40) if (t + i) % 3]
    frame = make(spark, rows, "instrument long, datetime timestamp_ntz, return double")
    got = {r["a"]: r["cov"] for r in covariance.variances(frame).collect()}
    want = {r["a"]: r["cov"] for r in covariance.empirical(frame).where("a = b").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_walk_forward_by_date_is_walk_forward(spark):
    bars = tables.bars(spark, SF)
    cal = tables.calendar(spark, SF)
    assert sorted(cal.collect()) == sorted(calendar_of(bars).collect())
    features = tables.dense_panel(spark, SF).features({"m": "$close/Ref($close,1)-1", "v": "$volume/50"})
    labels = joins.mature_labels(bars.selectExpr("instrument", "datetime", "close AS price"), cal, 5)
    origins = joins.month_ends(cal).selectExpr("datetime AS issued_at")
    training = joins.training_rows(labels, origins).join(features, ["instrument", "datetime"])
    targets = origins.join(features, F.col("datetime") == F.col("issued_at")).select("issued_at", F.lit(0.0).alias("actual"), "m", "v").dropna()
    want = evaluation.walk_forward(training, targets, ["m", "v"]).toPandas().sort_values(["issued_at", "forecast"]).reset_index(drop=True)
    got = analysis.walk_forward(spark, SF).toPandas().sort_values(["issued_at", "forecast"]).reset_index(drop=True)
    assert len(got) == len(want) and (got["issued_at"] == want["issued_at"]).all() and (got["alpha"] == want["alpha"]).all()
    for c in ("forecast", "benchmark", "actual"):
        assert np.allclose(got[c], want[c], atol=2e-6)


def test_backtest_holds_a_day_at_a_time(spark):
    rng = np.random.default_rng(1)
    rows = [(run, pd.Timestamp(2020, 1, 1) + pd.Timedelta(days=t), i, float(50 + rng.integers(50)), None if rng.random() < 0.1 else float(rng.integers(0, 30))) for run in ("a", "b") for t in range(60) for i in range(80) if rng.random() < 0.6]
    frame = make(spark, rows, "run_id string, datetime timestamp_ntz, instrument long, close double, score double")
    strategy = simulate.TopDrop(k=3, n=1)
    got = simulate.backtest(frame, strategy).toPandas()
    plain = pd.DataFrame(rows, columns=["run_id", "datetime", "instrument", "close", "score"]).assign(volume=np.nan, factor=1.0, suspended=False, no_buy=False, no_sell=False)
    for run, own in plain.groupby("run_id"):
        want = simulate.fold(own, strategy, simulate.Costs(), 1e8).reset_index(drop=True)
        mine = got[got["run_id"] == run].sort_values("datetime").reset_index(drop=True)
        pd.testing.assert_frame_equal(mine, want, check_dtype=False)
    pieces = list(simulate._days(pa.RecordBatch.from_pandas(plain.sort_values(["run_id", "datetime", "instrument"])[i : i + 7], preserve_index=False) for i in range(0, len(plain), 7)))
    assert len(pieces) == plain.groupby(["run_id", "datetime"]).ngroups and sum(map(len, pieces)) == len(plain)
    assert "FlatMapGroups" not in plan(simulate.backtest(frame, strategy))
