"""Queries without SQL cover their whole tables, as plain Python does."""

import numpy as np
import pandas as pd
import pytest

from panelkite.operators import evaluation, joins, simulate
from panelkite.operators.panel import calendar_of
from panelkite.queries import analysis
from panelkite.sources import tables

SF = "/root/testdata/sf0.001"


def test_walk_forward_takes_all_instruments_and_origins(spark):
    bars = tables.bars(spark, SF)
    cal = calendar_of(bars)
    features = tables.dense_panel(spark, SF).features({"m": "$close/Ref($close,1)-1", "v": "$volume/50"}).toPandas()
    labels = joins.mature_labels(bars.selectExpr("instrument", "datetime", "close AS price"), cal, 5).toPandas()
    labels = labels[labels["status"] == "AVAILABLE"].merge(features, on=["instrument", "datetime"]).dropna(subset=["label", "m", "v"])
    days = cal.toPandas()["datetime"]
    got = analysis.walk_forward(spark, SF).toPandas()
    seen = 0
    for origin in days.groupby([days.dt.year, days.dt.month]).max():
        known = labels[(labels["matures"] <= origin) & (labels["datetime"] < origin)].sort_values(["datetime", "m", "v", "label"])
        wanted = features[features["datetime"] == origin].dropna(subset=["m", "v"])
        own = got[got["issued_at"] == origin]
        if len(known) < 5:
            assert own.empty
            continue
        assert len(own) == len(wanted)
        seen += len(own)
        x, y = known[["m", "v"]].to_numpy(), known["label"].to_numpy()
        for alpha, rows in own.groupby("alpha"):
            w, b = evaluation.ridge(x, y, alpha)
            assert np.allclose(np.sort(rows["forecast"]), np.sort(wanted[["m", "v"]].to_numpy() @ w + b), atol=2e-6)
    assert seen == len(got) and got["issued_at"].dt.year.nunique() > 1


def test_soft_topk_weights_takes_all_dates(spark):
    rows = analysis.signal(spark, SF).where("score IS NOT NULL").toPandas()
    want, held = {}, {}
    for when, day in rows.groupby("datetime"):
        held = simulate.soft_weights(dict(zip(day["instrument"], day["score"], strict=True)), held, 3, 0.95, 0.2)
        want |= {(when, i): w for i, w in held.items()}
    got = {(r.datetime, r.instrument): r.weight for r in analysis.soft_topk_weights(spark, SF).toPandas().itertuples()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(w, abs=2e-6) for k, w in want.items())


def test_topk_dropout_backtest_takes_all_dates(spark):
    days = {pd.Timestamp(r[0]) for r in calendar_of(tables.bars(spark, SF)).select("datetime").collect()}
    got = analysis.topk_dropout_backtest(spark, SF).toPandas()
    for _, run in got.groupby("run_id"):
        assert set(run["datetime"]) == days and len(run) == len(days)
