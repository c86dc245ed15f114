"""Processors, point-in-time data, stores, samples, simulation, models and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkite.operators import covariance, dates, evaluation, factors, intraday, joins, sampler, signals, simulate, universe
from panelkite.operators import processors as p
from panelkite.operators.panel import Panel
from panelkite.sources import health, normalise, store
from panelkite.streaming import bars as stream
from tests.helpers import make


@pytest.fixture(scope="module")
def cross(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{k}", pd.Timestamp("2020-01-01") + pd.Timedelta(days=d), None if (k + d) % 9 == 0 else float(round(rng.normal(), 2)), float(k % 3), 0.0) for d in range(6) for k in range(15)]
    return make(spark, rows, "instrument string, datetime timestamp_ntz, x double, y double, constant double")


def as_pandas(df):
    return df.toPandas().sort_values(["datetime", "instrument"]).reset_index(drop=True)


def test_date_processors(cross):
    raw = as_pandas(cross)
    by = raw.groupby("datetime").x
    got = as_pandas(p.DateZScore(["x"])(cross)).x
    np.testing.assert_allclose(got, (raw.x - by.transform("mean")) / by.transform("std"))
    got = as_pandas(p.DateRank(["x", "y"])(cross))
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c], (raw.groupby("datetime")[c].rank(pct=True) - 0.5) * 3.46)
    got = as_pandas(p.DateFill(["x"])(cross)).x
    np.testing.assert_allclose(got, raw.x.fillna(by.transform("mean")))
    off = raw.x - by.transform("median")
    want = (off / (off.abs().groupby(raw.datetime).transform("median") * 1.4826)).clip(-3, 3)
    np.testing.assert_allclose(as_pandas(p.DateZScore(["x"], "robust")(cross)).x, want)


def test_fitted_processors_use_the_fit_range_only(cross):
    raw = as_pandas(cross)
    fit = raw[raw.datetime < "2020-01-04"]
    for make, want in (
        (p.MinMax, lambda c: (raw[c] - fit[c].min()) / (fit[c].max() - fit[c].min())),
        (p.ZScore, lambda c: (raw[c] - fit[c].mean()) / fit[c].std(ddof=0)),
        (p.RobustZScore, lambda c: ((raw[c] - fit[c].median()) / (((fit[c] - fit[c].median()).abs().median() + 1e-12) * 1.4826)).clip(-3, 3)),
    ):
        step = make(["x", "y"], "2020-01-01", "2020-01-03").fit(cross)
        got = as_pandas(step(cross))
        for c in ("x", "y"):
            np.testing.assert_allclose(got[c], want(c), rtol=1e-9)
    same = p.MinMax(["constant"], "2020-01-01", "2020-01-03")
    assert (as_pandas(same.fit(cross)(cross)).constant == 0).all()


def test_pipeline(cross):
    line = p.Pipeline(shared=[p.Fill(["y"])], infer=[p.DateZScore(["x"])], learn=[p.DropMissingLabel(["x"])])
    out = line.run(cross)
    assert out["infer"].count() == 90 and out["learn"].count() == cross.where("x IS NOT NULL").count()
    alone = p.Pipeline(infer=[p.DropColumns(["x"])], learn=[p.DropMissing(["x"])], how="independent").run(cross)
    assert "x" not in alone["infer"].columns and "x" in alone["learn"].columns
    with pytest.raises(ValueError, match="learning"):
        p.Pipeline(infer=[p.DropMissingLabel(["x"])]).run(cross)
    assert p.KeepColumns(["x", "y"], ["y"])(cross).columns == ["instrument", "datetime", "y", "constant"]


def test_infinite_values_become_the_mean(spark):
    rows = [("a", pd.Timestamp("2020-01-01"), 1.0), ("b", pd.Timestamp("2020-01-01"), float("inf")), ("c", pd.Timestamp("2020-01-01"), 3.0)]
    got = as_pandas(p.FillInfinite(["x"])(make(spark, rows, "instrument string, datetime timestamp_ntz, x double")))
    assert got.x.tolist() == [1, 2, 3]


def test_restated_periods(spark):
    rec = [("a", "roe_q", 201901, "2019-04-20", 1.0), ("a", "roe_q", 201902, "2019-07-15", 2.0), ("a", "roe_q", 201901, "2019-07-18", 1.5), ("a", "roe_q", 201904, "2020-03-01", 4.0)]
    periods = make(spark, rec, "instrument string, field string, period int, date string, value double").withColumn("date", F.to_date("date"))
    days = ["2019-04-19", "2019-04-20", "2019-07-16", "2019-07-18", "2020-03-02"]
    rows = make(spark, [("a", pd.Timestamp(d), i) for i, d in enumerate(days)], "instrument string, datetime timestamp_ntz, cal_idx int")
    panel = Panel(rows, rows.select("datetime", "cal_idx"), periods=periods)
    out = panel.features({"last": "P($$roe_q)", "before": "P(Ref($$roe_q,1))", "sum": "P(Sum($$roe_q,4))", "fixed": "PRef($$roe_q,201901)", "mixed": "P($$roe_q)*2"}).orderBy("datetime").toPandas()
    none = lambda c: [None if v != v else v for v in out[c]]
    assert none("last") == [None, 1, 2, 2, 4]
    assert none("before") == [None, None, 1, 1.5, None]
    assert none("sum") == [None, 1, 3, 3.5, 7.5]
    assert none("fixed") == [None, 1, 1, 1.5, 1.5]
    assert none("mixed") == [None, 2, 4, 4, 8]
    with pytest.raises(ValueError, match="future"):
        panel.features({"v": "P(Ref($$roe_q,-1))"})


def test_universe_filters(spark):
    rows = [(w, pd.Timestamp(f"2020-01-0{d}"), float(d % 3)) for w in ("sh1", "sz2") for d in range(1, 8)]
    panel = Panel.on_calendar(make(spark, rows, "instrument string, datetime timestamp_ntz, x double"))
    spans = universe.apply_filters(panel, None, [universe.NameFilter(pattern="sh"), universe.ExpressionFilter(rule="$x>0", start="2020-01-02")])
    got = sorted((r["instrument"], r["start_datetime"].day, r["end_datetime"].day) for r in spans.collect())
    assert got == [("sh1", 1, 2), ("sh1", 4, 5), ("sh1", 7, 7)] or got == [("sh1", 1, 2), ("sh1", 4, 5), ("sh1", 7, 7), ("sz2", 1, 1)]
    out = panel.features({"v": "Ref($x,1)"}, filters=[universe.NameFilter(pattern="sz")])
    assert {r["instrument"] for r in out.collect()} == {"sz2"}


def test_store_round_trip(spark, tmp_path):
    rows = [(w, pd.Timestamp(f"2020-01-{d:02d}"), float(d)) for w in ("a", "b") for d in range(1, 9) if not (w == "b" and d in (3, 4))]
    raw = make(spark, rows, "instrument string, datetime timestamp_ntz, x double")
    at = store.Store(spark, f"file://{tmp_path}/store")
    assert not at.exists("calendar")
    at.ingest_all(raw.where("datetime < TIMESTAMP_NTZ '2020-01-06'").unionByName(raw.limit(1)))
    assert at.read("features").count() == 10 and at.panel().features({"v": "Ref($x,1)"}).count() == 10
    more = raw.unionByName(make(spark, [("c", pd.Timestamp("2020-01-07"), 7.0)], raw.schema))
    at.ingest_update(more)
    assert at.read("features").count() == 17 and at.read("instruments").count() == 3
    fixed = raw.where("instrument = 'b'").withColumn("x", F.lit(0.0))
    at.ingest_fix(fixed)
    got = {(r["instrument"], r["datetime"].day): r["x"] for r in at.read("features").collect()}
    assert got[("b", 5)] == 0.0 and got[("b", 3)] is None and got[("a", 5)] == 5.0 and len(got) == 17
    at.write_feature(make(spark, [("a", 0, 9.0)], "instrument string, cal_idx int, value double"), "x")
    assert {(r["instrument"], r["datetime"].day): r["x"] for r in at.read("features").collect()}[("a", 1)] == 9.0
    at.drop_instruments(make(spark, [("c",)], "instrument string"))
    assert at.read("instruments").count() == 2
    at.extend_calendar(make(spark, [(pd.Timestamp("2020-02-01"),)], "datetime timestamp_ntz"))
    assert at.read("calendar").count() == 9
    at.remove_moments(make(spark, [(pd.Timestamp("2020-02-01"),)], "datetime timestamp_ntz"))
    assert at.read("calendar").count() == 8
    rec = make(spark, [("a", "f_q", 202001, 1, 1.0)], "instrument string, field string, period int, date int, value double")
    at.ingest_periods(rec)
    at.ingest_periods(rec.unionByName(rec.withColumn("date", F.lit(2))))
    assert at.read("periods").count() == 2


def test_normalisation(spark):
    days = pd.date_range("2020-01-01", periods=5)
    rows = [("a", d, c, c, c, c, v, c * 2) for d, c, v in zip(days, [10.0, 1000.0, 11.0, 12.0, 12.5], [1.0, 1.0, 0.0, 2.0, 2.0], strict=True)]
    raw = make(spark, rows, "instrument string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, adjclose double")
    fixed = normalise.repair_hundredfold(raw).orderBy("datetime").toPandas()
    assert fixed.close.tolist() == [10, 10, 11, 12, 12.5]
    masked = normalise.mask_untraded(raw).orderBy("datetime").toPandas()
    assert np.isnan(masked.close[2])
    adjusted = normalise.adjust(raw).orderBy("datetime").toPandas()
    assert adjusted.close.tolist() == [20, 2000, 22, 24, 25] and adjusted.factor.tolist() == [2.0] * 5
    assert normalise.rebase(raw).orderBy("datetime").toPandas().close.tolist() == [1, 100, 1.1, 1.2, 1.25]
    assert normalise.traded_days(raw).orderBy("datetime").toPandas().paused_num.tolist() == [1, 2, 0, 1, 2]
    new = raw.where("datetime >= TIMESTAMP_NTZ '2020-01-04'").withColumns({c: F.col(c) * 3 for c in ("open", "high", "low", "close")})
    both = normalise.splice(raw.where("datetime <= TIMESTAMP_NTZ '2020-01-04'"), new).orderBy("datetime").toPandas()
    assert both.close.tolist() == [10, 1000, 11, 12, 12.5]
    assert {r["instrument"] for r in health.missing_factor(raw).collect()} == {"a"}
    assert health.missing_columns(raw.drop("volume")) == ["volume"]
    assert {(r["column"], r["datetime"].day) for r in health.large_steps(raw, 0.5, 3.0).collect()} == {(c, d) for c in ("open", "high", "low", "close") for d in (2, 3)}


def test_samples(spark):
    days = pd.date_range("2020-01-31", periods=5, freq="ME")
    rows = [(w, d, float(i)) for w in ("a", "b") for i, d in enumerate(days) if not (w == "b" and i in (0, 2))]
    df = make(spark, rows, "instrument string, datetime timestamp_ntz, x double")
    got = {(r["instrument"], r["datetime"].month): [v[0] for v in r["sample"]] for r in sampler.samples(df, ["x"], 3).collect()}
    assert got[("a", 1)] == [None, None, 0] and got[("a", 3)] == [0, 1, 2]
    assert got[("b", 4)] == [1, None, 3] and ("b", 3) not in got
    filled = {(r["instrument"], r["datetime"].month): [v[0] for v in r["sample"]] for r in sampler.samples(df, ["x"], 3, fill="ffill+bfill").collect()}
    assert filled[("b", 4)] == [1, 1, 3] and filled[("a", 1)] == [0, 0, 0]
    one, two = sampler.split(df, number=2)
    assert (one.count(), two.count()) == (3, 5)


def test_as_of_and_overlays(spark):
    left = make(spark, [("a", pd.Timestamp("2020-01-02"), 1), ("a", pd.Timestamp("2020-01-05"), 2)], "instrument string, datetime timestamp_ntz, k int")
    right = make(spark, [("a", pd.Timestamp("2020-01-02"), 10.0), ("a", pd.Timestamp("2020-01-04"), 20.0)], "instrument string, at timestamp_ntz, x double")
    assert [r["x"] for r in joins.as_of(left, right, "at", ["x"]).orderBy("k").collect()] == [10, 20]
    assert [r["x"] for r in joins.as_of(left, right, "at", ["x"], allow_exact=False).orderBy("k").collect()] == [None, 20]


def test_simulation_deals():
    costs = simulate.Costs(open=0.001, close=0.002, least=5.0, unit=100)
    book = simulate.Book(10_000.0)
    assert simulate.deal(book, "a", 500, True, 10.0, costs) == (500, 5000.0, 5.0)
    assert simulate.deal(book, "a", 900, True, 10.0, costs)[0] == 400
    assert simulate.deal(book, "a", 250, False, 10.0, costs)[0] == 200
    assert simulate.deal(book, "a", 10_000, False, 10.0, costs)[0] == 700
    assert book.amounts == {} and book.cash == pytest.approx(10_000 - 5 - 5 - 5 - 14)
    assert simulate.deal(simulate.Book(3.0), "a", 100, True, 1.0, costs) == (0.0, 0.0, 0.0)
    orders = pd.DataFrame({"datetime": pd.to_datetime(["2020-01-01", "2020-01-02"]), "instrument": ["a", "a"], "amount": [100.0, 300.0], "direction": ["buy", "sell"]})
    prices = pd.DataFrame({"datetime": orders.datetime, "instrument": ["a", "a"], "close": [10.0, 11.0]})
    done = simulate.orders_fold(prices, orders, costs, 10_000.0)
    assert done.deal_amount.tolist() == [100, 100] and done.ffr.tolist() == [1.0, pytest.approx(1 / 3)]


def test_top_drop_holds_k_and_exchanges_n(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2020-01-01", periods=12)
    rows = [("r", d, f"i{k}", 10.0 + k + rng.normal() * 0.1, float(rng.normal())) for d in days for k in range(12)]
    df = make(spark, rows, "run_id string, datetime timestamp_ntz, instrument string, close double, score double")
    out = simulate.backtest(df, simulate.TopDrop(k=4, n=1), cash=1e6).orderBy("datetime").toPandas()
    assert out.n_held.tolist() == [0] + [4] * 11
    assert out.account.iloc[0] == 1e6 and (out.account > 0.9e6).all()
    np.testing.assert_allclose(out.account, out.value + out.cash)
    assert (out.turnover[2:] < 0.6).all()


def test_soft_weights():
    assert simulate.soft_weights({"A": 3, "B": 2, "C": 1}, {}, 2, 0.9) == {"A": 0.45, "B": 0.45}
    moved = simulate.soft_weights({"A": 3, "B": 2, "C": 1}, {"C": 0.9}, 2, 0.9, most_move=0.2)
    assert moved["C"] == pytest.approx(0.7) and moved["A"] == moved["B"] == pytest.approx(0.1)


def test_weights():
    cov = np.array([[0.04, 0.006], [0.006, 0.01]])
    assert simulate.weights_inverse(cov) == pytest.approx([0.2, 0.8])
    w = simulate.weights_least_variance(cov)
    assert w == pytest.approx([(0.01 - 0.006) / 0.038, (0.04 - 0.006) / 0.038], abs=1e-5)
    w = simulate.weights_risk_parity(cov)
    risk = w * (cov @ w)
    assert risk[0] == pytest.approx(risk[1], rel=1e-5)
    assert simulate.weights_mean_variance(np.array([1.0, 0.0]), cov, 0.0) == pytest.approx([1, 0], abs=1e-6)


def test_covariances(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    s = np.cov(x.T, bias=True)
    for target in ("const_var", "const_corr"):
        got = covariance.shrunk(x, target, 0.5)
        assert np.allclose(np.diag(got).sum(), np.diag(s).sum()) and np.all(np.linalg.eigvalsh(got) > 0)
    assert np.allclose(covariance.shrunk(x, "const_var", 0.0), s)
    f, b, u = covariance.structured(x, 6)
    assert np.allclose(f @ b @ f.T + np.diag(u), np.cov(x.T), atol=1e-8)
    assert np.allclose(covariance.thresholded(x, 2, 0.0), s, atol=1e-8)
    rows = [(f"i{j}", pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(x[i, j])) for i in range(80) for j in range(6)]
    got = covariance.empirical(make(spark, rows, "instrument string, datetime timestamp_ntz, return double")).toPandas().pivot(index="a", columns="b", values="cov")
    assert np.allclose(got.to_numpy(), s)


def test_ic_matches_pandas(spark):
    rng = np.random.default_rng(4)
    rows = [(f"i{k}", pd.Timestamp("2020-01-01") + pd.Timedelta(days=d), float(round(rng.normal(), 1)), None if k == 3 else float(rng.normal())) for d in range(4) for k in range(12)]
    df = make(spark, rows, "instrument string, datetime timestamp_ntz, score double, label double")
    got = signals.ic(df).orderBy("datetime").toPandas()
    raw = df.toPandas()
    want = raw.groupby("datetime").apply(lambda g: pd.Series({"p": g.score.corr(g.label), "s": g.score[g.label.notna()].rank().corr(g.label.rank().dropna())}), include_groups=False)
    np.testing.assert_allclose(got.ic, want.p)
    np.testing.assert_allclose(got.rank_ic, want.s)


def test_statistics():
    x = np.random.default_rng(5).normal(size=200)
    means = evaluation.block_bootstrap(x, 10, 500)
    assert abs(means.mean() - x.mean()) < 0.02 and len(means) == 500
    assert evaluation.hac_t(x + 1, 4) > 5
    assert evaluation.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    w, b = evaluation.ridge(np.c_[x, x**2], 2 * x + 1, 1e-9)
    assert w == pytest.approx([2, 0], abs=1e-6) and b == pytest.approx(1)


def test_dates():
    assert str(dates.Freq.parse("5min")) == "5min" and dates.Freq.parse("day").minutes == 240
    assert dates.nearest("day", ["1min", "5min", "week"]) == "5min"
    cal = dates.Sessions(list(range(0, 100, 2)))
    assert cal.segment((1, 9)) == (2, 8) and cal.shift((2, 8), 3) == (8, 14) and cal.shift((90, 98), 3) is None
    assert cal.shift((2, 8), 3, "expanding") == (2, 14) and cal.truncate((0, 50), 40, 2) == (0, 34)
    assert len(list(cal.rolling({"train": (0, 20), "test": (22, 40)}, 10))) == 3
    assert len(intraday.session_minutes("cn")) == 240


def test_factor_sets():
    assert len(factors.factors158()) == 158 and len(factors.factors360()) == 360 and len(factors.BENCHMARK) == 14


def test_session_grid(spark):
    rows = [(pd.Timestamp("2020-01-01 11:29"),), (pd.Timestamp("2020-01-01 13:01"),), (pd.Timestamp("2020-01-01 12:00"),)]
    out = make(spark, rows, "datetime timestamp_ntz").select(intraday.session_floor(50).alias("f")).toPandas().f
    assert [None if t is pd.NaT or pd.isna(t) else t.strftime("%H:%M") for t in out] == ["11:10", "11:10", None]


def test_streams(spark, tmp_path):
    at = pd.date_range("2020-01-01", periods=40, freq="7min")
    ticks = make(spark, [("a", t, float(i % 6)) for i, t in enumerate(at)], "instrument string, datetime timestamp_ntz, value double")
    ticks.repartition(3).write.parquet(f"{tmp_path}/ticks")
    live = spark.readStream.schema("instrument string, datetime timestamp_ntz, value double").parquet(f"{tmp_path}/ticks").withColumn("datetime", F.col("datetime").cast("timestamp"))
    for name, made in (("t", lambda x: stream.tumbling(x, "30 minutes")), ("s", lambda x: stream.sliding(x, "30 minutes", "10 minutes")), ("e", lambda x: stream.sessions(x, "5 minutes"))):
        q = made(live).writeStream.outputMode("complete").format("memory").queryName(f"bars_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(tuple(r) for r in spark.table(f"bars_{name}").selectExpr("CAST(start AS TIMESTAMP_NTZ)", "open", "close", "n").collect())
        assert got == sorted(tuple(r) for r in made(ticks).select("start", "open", "close", "n").collect())
    q = stream.running_decay(live.coalesce(1), 0.5).writeStream.format("memory").queryName("ema").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ema").orderBy("datetime").toPandas().ema
    want = pd.Series([float(i % 6) for i in range(40)]).ewm(alpha=0.5).mean()
    np.testing.assert_allclose(got, want)


def test_covariance_is_the_same_in_blocks(spark):
    rows = [(pd.Timestamp("2020-01-01") + pd.Timedelta(days=t), i, float((7 * t * i + i * i + t) % 11)) for t in range(9) for i in range(1, 8) if (t + i) % 4]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["datetime", "instrument", "return"]))
    wide = pd.DataFrame(rows, columns=["d", "i", "r"])
    wide["x"] = wide["r"] - wide.groupby("i")["r"].transform("mean")
    both = wide.merge(wide, on="d")
    both["p"] = both["x_x"] * both["x_y"]
    want = (both.groupby(["i_x", "i_y"])["p"].sum() / 9).to_dict()
    for block in (512, 3):
        got = {(r["a"], r["b"]): r["cov"] for r in covariance.empirical(frame, block=block).collect()}
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
