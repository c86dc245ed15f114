"""Queries of processors, signals, portfolios, samples, simulation, streams and status features."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkite.functions import elementwise
from panelkite.operators import covariance, evaluation, joins, portfolio, sampler, signals, simulate, status
from panelkite.operators import processors as p
from panelkite.operators.factors import LABEL
from panelkite.operators.panel import Panel, calendar_of
from panelkite.plans.compiler import INSTRUMENT, TIME
from panelkite.queries import sql
from panelkite.sources import tables
from panelkite.streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]
FIT = ("1995-01-01", "1997-12-31")
XY = {"x": "$close/Ref($close,1)-1", "y": "Mean($volume,3)"}


def xy(s: SparkSession, d: str) -> DataFrame:
    return tables.dense_panel(s, d).features(XY)


def signal(s: SparkSession, d: str) -> DataFrame:
    return tables.dense_panel(s, d).features({"score": "$close/Ref($close,5)-1", "label": LABEL["LABEL0"]})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([elementwise.rounded(F.col(c), digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _processed(make: Callable[[], p.Processor], digits: int = 5, before: Callable[[DataFrame], DataFrame] = lambda x: x) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = before(xy(s, d))
        return rounded(make().fit(rows)(rows), digits)

    return run


def _with_infinite(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.when(F.col("x").isNull(), F.lit(float("inf"))).otherwise(F.col("x")))


def pipeline_modes(s: SparkSession, d: str) -> DataFrame:
    """Learning rows: date z-scores, incomplete rows dropped."""
    rows = xy(s, d)
    line = p.Pipeline(shared=[p.FillInfinite(["x", "y"])], infer=[p.DateZScore(["x", "y"])], learn=[p.DropMissingLabel(["x"])])
    return rounded(line.run(rows)["learn"], 5)


def ic(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.ic(signal(s, d)).where(F.col("ic").isNotNull()))


def ic_summary(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.ic_summary(signals.ic(signal(s, d))))


def ic_all_models(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d)
    both = rows.withColumn("model", F.lit("a")).unionByName(rows.withColumn("score", -F.col("score")).withColumn("model", F.lit("b")))
    return rounded(signals.ic_summary(signals.ic(both, ["model"]), ["model"]))


def long_short_prec(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.long_short_precision(signal(s, d), 0.2, drop=True))


def long_short_return(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.long_short_return(signal(s, d), 0.2, drop=True))


def pred_autocorr(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).where("score IS NOT NULL")
    return rounded(signals.autocorrelation(rows, 1)).where("autocorrelation IS NOT NULL")


def group_return(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.group_returns(signal(s, d), 3))


def turnover(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.turnover(signal(s, d).where("score IS NOT NULL"), 3, 1))


def monthly_ic(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.monthly_ic(signals.ic(signal(s, d), ranks=False)))


def long_short_backtest(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.long_short_backtest(signal(s, d).where("score IS NOT NULL AND label IS NOT NULL"), 2))


def feature_diagnostics(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.diagnostics(xy(s, d), ["x", "y"]), 4)


def topk_per_date(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.top_k(signal(s, d).where("score IS NOT NULL"), 3).select(TIME, INSTRUMENT, "score", "place"))


def bottomk_per_date(s: SparkSession, d: str) -> DataFrame:
    return rounded(signals.top_k(signal(s, d).where("score IS NOT NULL"), 3, best=False).select(TIME, INSTRUMENT, "score", "place"))


def _daily(s: SparkSession, d: str) -> DataFrame:
    """The mean of all instruments' next returns, a series of days."""
    return signal(s, d).where("label IS NOT NULL").groupBy(TIME).agg((F.avg("label") / 100).alias("return"))


def risk_sum(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.risk_analysis(_daily(s, d), mode="sum"))


def risk_product(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.risk_analysis(_daily(s, d), mode="product"), 5)


def monthly_risk(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.monthly_risk(_daily(s, d)), 5)


def drawdown_curve(s: SparkSession, d: str) -> DataFrame:
    daily = _daily(s, d).withColumns({"bench": F.col("return") / 2, "cost": F.lit(0.0001)})
    return rounded(portfolio.curves(daily).select(TIME, "cum_return", "cum_excess", "drawdown_return", "drawdown_excess_net"))


def beta_alpha(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).where("label IS NOT NULL").groupBy(TIME).agg((F.avg("label") / 100).alias("bench"), (F.avg(F.when(F.col(INSTRUMENT) <= 5, F.col("label"))) / 100).alias("return"))
    return rounded(portfolio.beta_alpha(rows.where("return IS NOT NULL")), 5)


def _weighted(s: SparkSession, d: str) -> DataFrame:
    rows = tables.dense_panel(s, d).features({"return": "Ref($close,-1)/$close-1", "volume": "$volume"})
    all_ = Window.partitionBy(TIME)
    picked = F.col(INSTRUMENT) % 2 == 0
    return rows.select(TIME, INSTRUMENT, (F.col(INSTRUMENT) % 5).alias("group"), "return", (F.col("volume") / F.sum("volume").over(all_)).alias("bench_weight"), F.when(picked, 1.0 / F.count(F.when(picked, 1)).over(all_)).alias("port_weight"))


def brinson(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.brinson(_weighted(s, d)))


def avg_ensemble(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).where("score IS NOT NULL").select(TIME, INSTRUMENT, "score", "label")
    other = rows.select(TIME, INSTRUMENT, F.coalesce("label", F.lit(0.0)).alias("score")).withColumn("model", F.lit("b"))
    return rounded(signals.average_ensemble(rows.drop("label").withColumn("model", F.lit("a")).unionByName(other)), 5)


def rolling_ensemble(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).select(TIME, INSTRUMENT, "score").where("score IS NOT NULL")
    later = rows.where(F.year(TIME) >= 1997).withColumn("score", F.col("score") + 1).withColumn("start", F.lit(1997))
    return rounded(signals.rolling_ensemble(rows.withColumn("start", F.lit(1995)).unionByName(later)))


def twap_vwap(s: SparkSession, d: str) -> DataFrame:
    ticks = tables.ticks(s, d).select(INSTRUMENT, TIME, F.col("value").alias("price"), (F.length("event_type") * 1.0).alias("volume"))
    both = portfolio.base_price(ticks, "twap").withColumnRenamed("base_price", "twap").join(portfolio.base_price(ticks, "vwap").withColumnRenamed("base_price", "vwap"), [INSTRUMENT, "day"])
    return rounded(both, 8)


def _deals(s: SparkSession, d: str) -> DataFrame:
    items = tables.table(s, d, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.select(F.col("l_shipdate").alias(TIME), F.col("l_suppkey").alias(INSTRUMENT), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"), F.col("l_quantity").alias("amount"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("deal_amount"), price.alias("price"), F.lit(1234.567).alias("base_price"))


def price_advantage(s: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.price_advantage(_deals(s, d)))


def indicator_analysis(s: SparkSession, d: str) -> DataFrame:
    rows = portfolio.price_advantage(_deals(s, d)).withColumns({"pos": (F.col("pa") > 0).cast("double"), "count": F.lit(1), "deal_amount": F.col("ffr"), "value": F.col("ffr")})
    return rounded(portfolio.indicator_analysis(rows, "mean"))


def position_returns(s: SparkSession, d: str) -> DataFrame:
    rows = _weighted(s, d).where("return IS NOT NULL").select(TIME, F.when(F.col("port_weight").isNull(), "out").otherwise("hold").alias("status"), F.col("bench_weight").alias("weight"), "return")
    return rounded(portfolio.position_returns(rows), 4)


def rank_labels(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).where("label IS NOT NULL").select(TIME, "label", F.when(F.col(INSTRUMENT) % 2 == 0, "hold").otherwise("out").alias("status"))
    return rounded(portfolio.rank_labels(rows), 4)


def covariance_empirical(s: SparkSession, d: str) -> DataFrame:
    rows = tables.dense_panel(s, d).features({"return": "$close/Ref($close,1)-1"}).where("return IS NOT NULL")
    return rounded(covariance.empirical(rows).select("a", "b", "cov"), 5)


def ts_sample_list(s: SparkSession, d: str) -> DataFrame:
    rows = sampler.samples(tables.bars(s, d).select(INSTRUMENT, TIME, "volume", "high"), ["volume", "high"], 4)
    # Both columns of each slot, in cents.
    cell = lambda v: F.concat_ws(";", *[F.round(F.coalesce(v[i], F.lit(-1.0)) * 100).cast("bigint").cast("string") for i in (0, 1)])
    return rows.select(INSTRUMENT, TIME, F.array_join(F.transform("sample", cell), ",").alias("sample"))


def segments(s: SparkSession, d: str) -> DataFrame:
    named = sampler.segments(tables.bars(s, d).select(INSTRUMENT, TIME, "close"), {"train": ("1995-01-01", "1996-12-31"), "test": ("1997-01-01", "1997-12-31")})
    return named["train"].withColumn("segment", F.lit("train")).unionByName(named["test"].withColumn("segment", F.lit("test")))


def last_moments(s: SparkSession, d: str) -> DataFrame:
    return sampler.last_moments(tables.bars(s, d).select(INSTRUMENT, TIME, "close"), 5)


def topk_dropout_backtest(s: SparkSession, d: str) -> DataFrame:
    rows = tables.stored(tables.dense_panel(s, d).features({"close": "$close", "score": "$close/Ref($close,5)-1"}), "scores")
    both = rows.withColumn("run_id", F.lit("follow")).unionByName(rows.withColumn("run_id", F.lit("against")).withColumn("score", -F.col("score")))
    return rounded(simulate.backtest(both, simulate.TopDrop(k=5, n=1)), 4)


def soft_topk_weights(s: SparkSession, d: str) -> DataFrame:
    k = 3

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, held = [], {}
        for when, rows in frame.sort_values(TIME).groupby(TIME):
            held = simulate.soft_weights(dict(zip(rows[INSTRUMENT], rows["score"], strict=True)), held, k, 0.95, 0.2)
            out += [(when, i, w) for i, w in held.items()]
        return pd.DataFrame(out, columns=[TIME, INSTRUMENT, "weight"])

    # Only the best of each date go to the one task that carries weights from date to date.
    rows = simulate.best_of_dates(signal(s, d).where("score IS NOT NULL").select(TIME, INSTRUMENT, "score"), k).withColumn("run_id", F.lit(1))
    return rounded(rows.groupBy("run_id").applyInPandas(run, f"{TIME} timestamp_ntz, {INSTRUMENT} bigint, weight double"))


def twap_slices(s: SparkSession, d: str) -> DataFrame:
    rows = tables.table(s, d, "orders").select(F.col("o_orderkey").alias(INSTRUMENT), F.col("o_totalprice").alias("amount"))
    return rounded(simulate.sliced(rows, 4))


def target_orders(s: SparkSession, d: str) -> DataFrame:
    items = tables.table(s, d, "lineitem")
    one = lambda flag: items.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias(INSTRUMENT)).agg(F.sum("l_quantity").alias("amount"))
    return simulate.target_orders(one("A"), one("R"))


def tradable_flags(s: SparkSession, d: str) -> DataFrame:
    rows = tables.spine_panel(s, d).features({"close": "$close", "change": "$close/Ref($close,1)-1"})
    return simulate.tradable_flags(rows, 0.5).select(INSTRUMENT, TIME, "suspended", "no_buy", "no_sell")


def tumbling_bars(s: SparkSession, d: str) -> DataFrame:
    return rounded(stream.tumbling(tables.ticks(s, d), "6 hours"), 4)


def sliding_bars(s: SparkSession, d: str) -> DataFrame:
    return rounded(stream.sliding(tables.ticks(s, d), "12 hours", "6 hours"), 4)


def session_bars(s: SparkSession, d: str) -> DataFrame:
    return rounded(stream.sessions(tables.ticks(s, d), "4 hours"), 4)


def inst_processor_udf(s: SparkSession, d: str) -> DataFrame:
    def centred(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(v=rows["v"] - rows["v"].mean())

    return rounded(tables.dense_panel(s, d).features({"v": "$close/1000"}, per_instrument=[centred]), 4)


def _status(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d).select(INSTRUMENT, TIME, F.col("close").alias("price"), F.when(F.col("volume") > 3, "VALID").otherwise("INVALID_PRICE").alias("price_status"))
    return status.unbroken(rows)


def status_return(s: SparkSession, d: str) -> DataFrame:
    out = status.past_return(_status(s, d), 3)
    return out.select(INSTRUMENT, TIME, F.round("past_return.value", 6).alias("value"), F.col("past_return.status").alias("status"))


def status_recursive(s: SparkSession, d: str) -> DataFrame:
    out = status.recursive(_status(s, d), 3, 3, 5, 3, 5)
    return status.status_counts(out, ["rsi", "ema_gap", "macd"])


def forecast_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = signal(s, d).where("score IS NOT NULL AND label IS NOT NULL").select(F.col("score").alias("forecast"), F.col("label").alias("actual"), F.lit(0.0).alias("benchmark"))
    return rounded(evaluation.forecast_metrics(rows), 5)


def walk_forward(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d)
    cal = tables.calendar(s, d)
    horizon = 5
    features = Panel.dense(rows, calendar=cal).features({"price": "$close", "m": "$close/Ref($close,1)-1", "v": "$volume/50"})
    stored = tables.stored(joins.matured(features, cal, horizon).select(TIME, "matures", "label", "m", "v"), "features")
    origins = joins.month_ends(cal).select(F.col(TIME).alias("issued_at"))
    targets = stored.join(F.broadcast(origins), F.col(TIME) == F.col("issued_at")).select("issued_at", F.lit(0.0).alias("actual"), "m", "v").dropna()
    return rounded(evaluation.walk_forward_by_date(stored, origins, targets, ["m", "v"]), 6)


def queries() -> dict[str, Query]:
    own = [pipeline_modes, ic, ic_summary, ic_all_models, long_short_prec, long_short_return, pred_autocorr, group_return, turnover, monthly_ic, long_short_backtest, feature_diagnostics, topk_per_date, bottomk_per_date, risk_sum, risk_product, monthly_risk, drawdown_curve, beta_alpha, brinson, avg_ensemble, rolling_ensemble, twap_vwap, price_advantage, indicator_analysis, position_returns, rank_labels, covariance_empirical, ts_sample_list, segments, last_moments, topk_dropout_backtest, soft_topk_weights, twap_slices, target_orders, tradable_flags, tumbling_bars, sliding_bars, session_bars, inst_processor_udf, status_return, status_recursive, forecast_metrics, walk_forward]
    out: dict[str, Query] = {f.__name__: f for f in own}
    both = ["x", "y"]
    out |= {
        "minmax": _processed(lambda: p.MinMax(both, *FIT)),
        "zscore": _processed(lambda: p.ZScore(both, *FIT)),
        "robust_zscore": _processed(lambda: p.RobustZScore(both, *FIT)),
        "cs_zscore": _processed(lambda: p.DateZScore(both)),
        "cs_zscore_robust": _processed(lambda: p.DateZScore(both, "robust")),
        "cs_rank": _processed(lambda: p.DateRank(both)),
        "cs_fillna": _processed(lambda: p.DateFill(both)),
        "process_inf": _processed(lambda: p.FillInfinite(both), before=_with_infinite),
        "fillna": _processed(lambda: p.Fill(both, 0.0)),
        "tanh": _processed(lambda: p.Tanh(both)),
        "dropna": _processed(lambda: p.DropMissing(both)),
        "drop_col": _processed(lambda: p.DropColumns(["y"])),
        "filter_col": _processed(lambda: p.KeepColumns(both, ["y"])),
        "cast_columns": _processed(lambda: p.Cast(["y"], "int")),
        "highfreq_norm": _processed(lambda: p.GroupNorm(both, *FIT, groups=[["x"], ["y"]])),
        "family_norm": _processed(lambda: p.FamilyNorm(["STD5", "KMID"]), before=lambda r: r.select(INSTRUMENT, TIME, F.col("y").alias("STD5"), F.col("x").alias("KMID")), digits=4),
    }
    return out


_XY = f"""{sql.DENSE}, r AS MATERIALIZED (
  SELECT instrument, datetime, close / lag(close) OVER i - 1 AS x, avg(volume) OVER w3 AS y FROM b {sql.windows(3)})"""


def xy_sql() -> str:
    """Common table expressions that end in r (instrument, datetime, x, y), the columns of XY."""
    return _XY


_FITTED = f"fit AS MATERIALIZED (SELECT * FROM r WHERE datetime BETWEEN TIMESTAMP '{FIT[0]}' AND TIMESTAMP '{FIT[1]}')"


def _each(x: str, y: str | None = None, digits: int = 5, extra: str = "", tail: str = "", start: str = _XY) -> str:
    other = (y if y is not None else x.replace("{c}", "y")).replace("{c}", "y")
    return f"WITH {start}{extra} SELECT instrument, datetime, round({x.replace('{c}', 'x')}, {digits}) AS x, round({other}, {digits}) AS y FROM r {tail}"


def _robust(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, 3), -3) END"


def oracle_sql() -> dict[str, str]:
    date = "OVER (PARTITION BY datetime)"
    robust = _XY + f""", m AS (SELECT *, x - median(x) {date} AS dx, y - median(y) {date} AS dy FROM r),
n AS (SELECT *, dx / nullif(median(abs(dx)) {date} * 1.4826, 0) AS zx, dy / nullif(median(abs(dy)) {date} * 1.4826, 0) AS zy FROM m)"""
    rank = "CASE WHEN {c} IS NOT NULL THEN ((rank() OVER (PARTITION BY datetime, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY datetime, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY datetime) - 0.5) * 3.46 END"
    z = "({c} - avg({c}) " + date + ") / nullif(stddev_samp({c}) " + date + ", 0)"
    pairs = f"WITH {sql.SIGNAL}, p AS (SELECT * FROM signal WHERE score IS NOT NULL AND label IS NOT NULL)"
    place = lambda c: f"rank() OVER (PARTITION BY datetime{{k}} ORDER BY {c}) + (count(*) OVER (PARTITION BY datetime{{k}}, {c}) - 1) / 2.0"
    corr = lambda a, b: f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"
    ranked = f", q AS (SELECT *, {place('score').format(k='')} AS rs, {place('label').format(k='')} AS rl FROM p), ic AS (SELECT datetime, {corr('score', 'label')} AS ic, {corr('rs', 'rl')} AS rank_ic FROM q GROUP BY 1)"
    summary = "round(avg(ic), 6) AS ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg(rank_ic), 6) AS rank_ic, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) AS rank_icir"
    ends = ", t AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS top, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS low, floor(count(*) OVER (PARTITION BY datetime) * 0.2) AS k FROM p)"
    scored = f"WITH {sql.SIGNAL}, p AS (SELECT * FROM signal WHERE score IS NOT NULL), d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS n FROM (SELECT DISTINCT datetime FROM p)), o AS (SELECT p.*, n FROM p JOIN d USING (datetime))"
    daily = f"WITH {sql.SIGNAL}, daily AS (SELECT datetime, avg(label) / 100 AS r FROM signal WHERE label IS NOT NULL GROUP BY 1)"
    so_far = "OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    curve = f", c AS (SELECT datetime, r, sum(r) {so_far} AS c FROM daily), dd AS (SELECT *, c - max(c) {so_far} AS d FROM c)"
    weighted = f"""WITH {sql.DENSE}, f AS (SELECT instrument, datetime, lead(close) OVER i / close - 1 AS r, volume FROM b {sql.windows()}),
w AS (SELECT datetime, instrument, instrument % 5 AS g, r, volume / sum(volume) OVER (PARTITION BY datetime) AS bw, CASE WHEN instrument % 2 = 0 THEN 1.0 / count(*) FILTER (instrument % 2 = 0) OVER (PARTITION BY datetime) END AS pw FROM f)"""
    bars = "arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS volume, count(value) AS n"
    tops = "SELECT datetime, instrument, round(score, 6) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY score{0}, instrument) AS place FROM signal WHERE score IS NOT NULL) WHERE place <= 3"
    deals = """d AS (SELECT l_shipdate AS datetime, l_suppkey AS instrument, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction, sum(l_quantity) AS a,
  sum(l_quantity * (1 - l_discount)) AS x, sum(l_extendedprice / l_quantity * (l_quantity * (1 - l_discount))) AS v, sum(1234.567 * (l_quantity * (1 - l_discount))) AS w FROM lineitem GROUP BY 1, 2, 3),
pa AS (SELECT datetime, instrument, direction, x / a AS ffr, -direction * ((v / x) / (w / x) - 1) AS pa FROM d)"""
    fitted = lambda value: f"WITH {_XY}, {_FITTED} SELECT instrument, datetime, {', '.join(f'round({value.replace("{c}", c)}, 5) AS {c}' for c in 'xy')} FROM r"
    of = lambda f: f"(SELECT {f}({{c}}) FROM fit)"
    mad = "((SELECT median(abs({c} - (SELECT median({c}) FROM fit))) FROM fit) + 1e-12) * 1.4826"
    group = lambda c: f"(SELECT stddev_pop(abs({c} - (SELECT avg({c}) FROM fit))) FROM fit)"
    shrink = "CASE WHEN {c} > 3 THEN 3 + ({c} - 3) / (max({c}) OVER (PARTITION BY datetime) - 3) * 0.5 ELSE {c} END"
    shrink2 = "CASE WHEN {c} < -3 THEN -3 - ({c} + 3) / (min({c}) OVER (PARTITION BY datetime) + 3) * 0.5 ELSE {c} END"
    status_cte = f"""{sql.BARS}, s AS (SELECT instrument, datetime, close, CASE WHEN volume > 3 THEN 0 ELSE 1 END AS bad FROM bars),
u AS (SELECT *, sum(bad) OVER (PARTITION BY instrument ORDER BY datetime) AS part FROM s),
v AS (SELECT *, sum(1 - bad) OVER (PARTITION BY instrument, part ORDER BY datetime) AS n, lag(close, 3) OVER (PARTITION BY instrument, part ORDER BY datetime) AS c3 FROM u)"""
    told = "CASE WHEN bad = 1 THEN 'INVALID_PRICE' WHEN n < {0} THEN 'INSUFFICIENT_HISTORY' ELSE 'VALID' END"
    return {
        "minmax": fitted(f"({{c}} - {of('min')}) / nullif({of('max')} - {of('min')}, 0)"),
        "zscore": fitted(f"({{c}} - {of('avg')}) / nullif({of('stddev_pop')}, 0)"),
        "robust_zscore": fitted(_robust(f"(({{c}} - {of('median')}) / ({mad}))")),
        "cs_zscore": _each(z),
        "cs_zscore_robust": f"WITH {robust} SELECT instrument, datetime, round({_robust('zx')}, 5) AS x, round({_robust('zy')}, 5) AS y FROM n",
        "cs_rank": _each(rank),
        "cs_fillna": _each("coalesce({c}, avg({c}) " + date + ")"),
        "process_inf": _each("coalesce(x, avg(x) " + date + ")", "y"),
        "fillna": _each("coalesce({c}, 0)"),
        "tanh": _each("tanh({c} - 1)"),
        "dropna": _each("{c}", tail="WHERE x IS NOT NULL AND y IS NOT NULL"),
        "drop_col": f"WITH {_XY} SELECT instrument, datetime, round(x, 5) AS x FROM r",
        "filter_col": f"WITH {_XY} SELECT instrument, datetime, round(y, 5) AS y FROM r",
        "cast_columns": f"WITH {_XY} SELECT instrument, datetime, round(x, 5) AS x, CAST(trunc(y) AS INT) AS y FROM r",
        "highfreq_norm": f"WITH {_XY}, {_FITTED} SELECT instrument, datetime, " + ", ".join(f"round(coalesce(({c} - (SELECT avg({c}) FROM fit)) / {group(c)}, 0), 5) AS {c}" for c in "xy") + " FROM r",
        "family_norm": f"""WITH {_XY}, l AS (SELECT instrument, datetime, ln(y) AS y, x FROM r), m AS (SELECT instrument, datetime, x - median(x) {date} AS x, y - median(y) {date} AS y FROM l),
n AS (SELECT instrument, datetime, x / nullif(median(abs(x)) {date} * 1.4826, 0) AS x, y / nullif(median(abs(y)) {date} * 1.4826, 0) AS y FROM m),
o AS (SELECT instrument, datetime, {shrink.replace('{c}', 'x')} AS x, {shrink.replace('{c}', 'y')} AS y FROM n), q AS (SELECT instrument, datetime, {shrink2.replace('{c}', 'x')} AS x, {shrink2.replace('{c}', 'y')} AS y FROM o)
SELECT instrument, datetime, round(coalesce(y, 0), 4) AS "STD5", round(coalesce(x, 0), 4) AS "KMID" FROM q""",
        "pipeline_modes": f"WITH {_XY}, z AS (SELECT instrument, datetime, {z.replace('{c}', 'x')} AS x, {z.replace('{c}', 'y')} AS y FROM r) SELECT instrument, datetime, round(x, 5) AS x, round(y, 5) AS y FROM z WHERE x IS NOT NULL",
        "ic": f"{pairs}{ranked} SELECT datetime, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ic WHERE ic IS NOT NULL",
        "ic_summary": f"{pairs}{ranked} SELECT {summary} FROM ic",
        "ic_all_models": f"{pairs}{ranked}, m AS (SELECT 'a' AS model, ic, rank_ic FROM ic UNION ALL SELECT 'b', -ic, -rank_ic FROM ic) SELECT model, {summary} FROM m GROUP BY 1",
        "long_short_prec": f"{pairs}{ends} SELECT datetime, round(count(*) FILTER (top <= k AND label > 0) / nullif(count(*) FILTER (top <= k), 0), 6) AS long_precision, round(count(*) FILTER (low <= k AND label < 0) / nullif(count(*) FILTER (low <= k), 0), 6) AS short_precision FROM t GROUP BY 1",
        "long_short_return": f"{pairs}{ends} SELECT datetime, round((avg(label) FILTER (top <= k) - avg(label) FILTER (low <= k)) / 2, 6) AS long_short, round(avg(label), 6) AS average FROM t GROUP BY 1",
        "pred_autocorr": f"{scored}, c AS (SELECT a.datetime, {corr('a.score', 'z.score')} AS c FROM o a JOIN o z ON a.instrument = z.instrument AND a.n = z.n + 1 GROUP BY 1) SELECT datetime, round(c, 6) AS autocorrelation FROM c WHERE c IS NOT NULL",
        "group_return": f"""{pairs}, g AS (SELECT *, floor((row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) - 1) / nullif(floor(count(*) OVER (PARTITION BY datetime) / 3), 0)) AS g FROM p),
m AS (SELECT datetime, avg(label) FILTER (g = 0) AS g1, avg(label) FILTER (g = 1) AS g2, avg(label) FILTER (g = 2) AS g3, avg(label) AS a FROM g GROUP BY 1)
SELECT datetime, round(g1, 6) AS group1, round(g2, 6) AS group2, round(g3, 6) AS group3, round(g1 - g3, 6) AS long_short, round(g1 - a, 6) AS long_average FROM m""",
        "turnover": f"""{scored}, s AS (SELECT *, floor(count(*) OVER (PARTITION BY datetime) / 3) AS k, row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) AS top, row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) AS low FROM o)
SELECT a.datetime, round(1 - count(*) FILTER (a.top <= a.k AND z.top <= z.k) / nullif(max(a.k), 0), 6) AS top, round(1 - count(*) FILTER (a.low <= a.k AND z.low <= z.k) / nullif(max(a.k), 0), 6) AS bottom
FROM s a JOIN s z ON a.instrument = z.instrument AND a.n = z.n + 1 GROUP BY 1""",
        "monthly_ic": f"{pairs}{ranked} SELECT CAST(year(datetime) AS INT) AS year, " + ", ".join(f'round(avg(ic) FILTER (month(datetime) = {m}), 6) AS "{m}"' for m in range(1, 13)) + " FROM ic GROUP BY 1",
        "long_short_backtest": f"""{pairs}{ends}, m AS (SELECT datetime, avg(label) FILTER (top <= 2) - avg(label) AS l, avg(label) - avg(label) FILTER (low <= 2) AS s FROM t GROUP BY 1)
SELECT datetime, round(l, 6) AS long, round(s, 6) AS short, round(l + s, 6) AS long_short FROM m""",
        "feature_diagnostics": " UNION ALL ".join(f"(WITH {_XY} SELECT datetime, '{c}' AS name, count(*) AS n, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_missing, CAST(0 AS BIGINT) AS n_infinite, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CASE WHEN count({c}) >= 3 AND stddev_pop({c}) > 0 THEN round(skewness({c}), 4) END AS skew, CASE WHEN count({c}) >= 4 AND stddev_pop({c}) > 0 THEN round(kurtosis({c}), 4) END AS kurt FROM r GROUP BY 1)" for c in "xy"),
        "topk_per_date": f"WITH {sql.SIGNAL} {tops.format(' DESC')}",
        "bottomk_per_date": f"WITH {sql.SIGNAL} {tops.format('')}",
        "risk_sum": f"{daily}{curve} SELECT round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(avg(r) * 238, 6) AS annualized_return, round(avg(r) / stddev_samp(r) * sqrt(238), 6) AS information_ratio, round(min(d), 6) AS max_drawdown FROM dd",
        "risk_product": f"""{daily}, c AS (SELECT datetime, r, exp(sum(ln(1 + r)) {so_far}) AS c FROM daily), dd AS (SELECT *, c / max(c) {so_far} - 1 AS d FROM c),
m AS (SELECT exp(avg(ln(1 + r))) - 1 AS mean, stddev_samp(ln(1 + r)) AS std, exp(avg(ln(1 + r)) * 238) - 1 AS year, min(d) AS d FROM dd)
SELECT round(mean, 5) AS mean, round(std, 5) AS std, round(year, 5) AS annualized_return, round(mean / std * sqrt(238), 5) AS information_ratio, round(d, 5) AS max_drawdown FROM m""",
        "monthly_risk": f"""{daily}, c AS (SELECT *, strftime(datetime, '%Y-%m') AS month, sum(r) OVER (PARTITION BY strftime(datetime, '%Y-%m') ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS c FROM daily),
e AS (SELECT *, c - max(c) OVER (PARTITION BY month ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS d FROM c)
SELECT month, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS std, round(min(d), 5) AS max_drawdown, round(avg(r) * 238, 5) AS annualized_return, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(238), 5) AS information_ratio FROM e GROUP BY 1""",
        "drawdown_curve": f"""{daily}, c AS (SELECT datetime, sum(r) {so_far} AS cr, sum(r - r / 2) {so_far} AS ce, sum(r - r / 2 - 0.0001) {so_far} AS cn FROM daily)
SELECT datetime, round(cr, 6) AS cum_return, round(ce, 6) AS cum_excess, round(cr - max(cr) {so_far}, 6) AS drawdown_return, round(cn - max(cn) {so_far}, 6) AS drawdown_excess_net FROM c""",
        "beta_alpha": f"""WITH {sql.SIGNAL}, v AS (SELECT datetime, avg(label) / 100 AS b, avg(label) FILTER (instrument <= 5) / 100 AS r FROM signal WHERE label IS NOT NULL GROUP BY 1), u AS (SELECT * FROM v WHERE r IS NOT NULL),
c AS (SELECT *, exp(sum(ln(1 + r)) {so_far}) AS c FROM u), d AS (SELECT *, c / max(c) {so_far} - 1 AS d FROM c), m AS (SELECT covar_samp(r, b) / var_samp(b) AS beta, avg(r) AS r, avg(b) AS b, stddev_samp(r) AS s, min(d) AS d FROM d)
SELECT round(beta, 5) AS beta, round((r - beta * b) * 250, 5) AS alpha, round(r / s * sqrt(250), 5) AS sharpe, round(s * sqrt(250), 5) AS volatility, round(d, 5) AS max_drawdown FROM m""",
        "brinson": f"""{weighted}, g AS (SELECT datetime, g, sum(coalesce(pw, 0)) AS w, sum(bw) AS b, sum(coalesce(pw, 0) * coalesce(r, 0)) AS wr, sum(bw * coalesce(r, 0)) AS br FROM w GROUP BY 1, 2),
h AS (SELECT *, br / nullif(b, 0) AS rb, coalesce(wr / nullif(w, 0), br / nullif(b, 0)) AS rp FROM g), q AS (SELECT datetime, sum(b * rb) AS q1, sum(w * rb) AS q2, sum(b * rp) AS q3, sum(w * rp) AS q4 FROM h GROUP BY 1)
SELECT datetime, round(q2 - q1, 6) AS raa, round(q3 - q1, 6) AS rss, round(q4 - q3 - q2 + q1, 6) AS rin, round(q4 - q1, 6) AS rtotal FROM q""",
        "avg_ensemble": f"""WITH {sql.SIGNAL}, m AS (SELECT datetime, instrument, score, 'a' AS model FROM signal WHERE score IS NOT NULL UNION ALL SELECT datetime, instrument, coalesce(label, 0), 'b' FROM signal WHERE score IS NOT NULL),
z AS (SELECT *, (score - avg(score) OVER v) / nullif(stddev_samp(score) OVER v, 0) AS z FROM m WINDOW v AS (PARTITION BY datetime, model)) SELECT datetime, instrument, round(avg(z), 5) AS score FROM z GROUP BY 1, 2""",
        "rolling_ensemble": f"WITH {sql.SIGNAL} SELECT datetime, instrument, round(CASE WHEN year(datetime) >= 1997 THEN score + 1 ELSE score END, 6) AS score FROM signal WHERE score IS NOT NULL",
        "twap_vwap": "SELECT user_id AS instrument, CAST(ts AS DATE) AS day, round(avg(value), 8) AS twap, round(sum(value * length(event_type)) / sum(length(event_type)), 8) AS vwap FROM events GROUP BY 1, 2",
        "price_advantage": f"WITH {deals} SELECT datetime, instrument, direction, round(ffr, 6) AS ffr, round(pa, 6) AS pa FROM pa",
        "indicator_analysis": f"WITH {deals} SELECT round(avg(ffr), 6) AS ffr, round(avg(pa), 6) AS pa, round(avg(CASE WHEN pa > 0 THEN 1.0 ELSE 0.0 END), 6) AS pos FROM pa",
        "position_returns": f"""{weighted}, s AS (SELECT datetime, CASE WHEN pw IS NULL THEN 'out' ELSE 'hold' END AS status, sum(bw * r) / sum(bw) AS r FROM w WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT datetime, status, round(sum(r) OVER (PARTITION BY status ORDER BY datetime), 4) AS cum_return FROM s""",
        "rank_labels": f"""WITH {sql.SIGNAL}, s AS (SELECT datetime, CASE WHEN instrument % 2 = 0 THEN 'hold' ELSE 'out' END AS status, rank() OVER (PARTITION BY datetime ORDER BY label DESC) / count(*) OVER (PARTITION BY datetime) * 100 AS r FROM signal WHERE label IS NOT NULL)
SELECT datetime, status, round(avg(r), 4) AS rank_ratio FROM s GROUP BY 1, 2""",
        "covariance_empirical": f"""WITH {sql.DENSE}, f AS (SELECT instrument, datetime, close / lag(close) OVER i - 1 AS r FROM b {sql.windows()}), u AS MATERIALIZED (SELECT * FROM f WHERE r IS NOT NULL),
c AS MATERIALIZED (SELECT instrument, datetime, r - avg(r) OVER (PARTITION BY instrument) AS x FROM u)
SELECT l.instrument AS a, z.instrument AS b, round(sum(l.x * z.x) / (SELECT count(DISTINCT datetime) FROM u), 5) AS cov FROM c l JOIN c z USING (datetime) GROUP BY 1, 2""",
        "ts_sample_list": f"""WITH {sql.SPINE}, s AS (SELECT instrument, datetime, close, list(CAST(round(coalesce(volume, -1) * 100) AS BIGINT) || ';' || CAST(round(coalesce(high, -1) * 100) AS BIGINT)) OVER w4 AS xs FROM b {sql.windows(4)})
SELECT instrument, datetime, repeat('-100;-100,', CAST(4 - len(xs) AS INT)) || array_to_string(xs, ',') AS sample FROM s WHERE close IS NOT NULL""",
        "segments": f"WITH {sql.BARS} SELECT instrument, datetime, close, CASE WHEN year(datetime) < 1997 THEN 'train' ELSE 'test' END AS segment FROM bars WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'",
        "last_moments": f"WITH {sql.BARS} SELECT instrument, datetime, close FROM bars WHERE datetime IN (SELECT DISTINCT datetime FROM bars ORDER BY datetime DESC LIMIT 5)",
        "twap_slices": "SELECT o_orderkey AS instrument, round(o_totalprice / 4, 6) AS amount, CAST(slot AS INT) AS slot FROM orders, (VALUES (0), (1), (2), (3)) s(slot)",
        "target_orders": """WITH a AS (SELECT l_suppkey AS i, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS i, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
g AS (SELECT coalesce(a.i, r.i) AS instrument, coalesce(r.q, 0) - coalesce(a.q, 0) AS g FROM a FULL JOIN r ON a.i = r.i)
SELECT instrument, abs(g) AS amount, CASE WHEN g > 0 THEN 'buy' ELSE 'sell' END AS direction FROM g WHERE g <> 0""",
        "tradable_flags": f"""WITH {sql.SPINE}, c AS (SELECT *, close / lag(close) OVER i - 1 AS m FROM b {sql.windows()})
SELECT instrument, datetime, close IS NULL AS suspended, close IS NULL OR coalesce(m >= 0.5, false) AS no_buy, close IS NULL OR coalesce(m <= -0.5, false) AS no_sell FROM c""",
        "tumbling_bars": f"WITH t AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM events) SELECT user_id AS instrument, s AS start, s + INTERVAL 6 HOUR AS \"end\", {bars} FROM t GROUP BY 1, 2, 3",
        "sliding_bars": f"WITH t AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - o * INTERVAL 6 HOUR AS s FROM events, (VALUES (0), (1)) v(o)) SELECT user_id AS instrument, s AS start, s + INTERVAL 12 HOUR AS \"end\", {bars} FROM t GROUP BY 1, 2, 3",
        "session_bars": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events), t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT instrument, start, "end", open, high, low, close, volume, n FROM (SELECT user_id AS instrument, s, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", {bars} FROM t GROUP BY 1, 2)""",
        "inst_processor_udf": f"WITH {sql.BARS} SELECT instrument, datetime, round(close / 1000 - avg(close / 1000) OVER (PARTITION BY instrument), 4) AS v FROM bars",
        "status_return": f"WITH {status_cte} SELECT instrument, datetime, CASE WHEN bad = 0 AND n >= 4 THEN round(close / c3 - 1, 6) END AS value, {told.format(4)} AS status FROM v",
        "status_recursive": f"WITH {status_cte}, w AS (SELECT unnest(['rsi', 'ema_gap', 'macd']) AS name, unnest([{told.format(4)}, {told.format(5)}, {told.format(7)}]) AS status FROM v) SELECT name, status, count(*) AS n FROM w GROUP BY 1, 2",
        "forecast_metrics": f"{pairs} SELECT round(avg(abs(label - score)), 5) AS mae, round(sqrt(avg((label - score) * (label - score))), 5) AS rmse, round(1 - sum((label - score) * (label - score)) / sum(label * label), 5) AS r2, round(avg(CASE WHEN sign(score) = sign(label) THEN 1.0 ELSE 0.0 END), 5) AS direction FROM p",
    }
