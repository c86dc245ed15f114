"""Queries of whole factor sets, handlers, execution, index membership and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkite.operators import covariance, dates, execution, factors, handlers, joins, models, signals
from panelkite.operators import processors as p
from panelkite.operators.panel import calendar_of
from panelkite.plans.compiler import INSTRUMENT, TIME
from panelkite.queries import analysis, expressions, sql
from panelkite.queries.analysis import FIT, XY, rounded, signal
from panelkite.sources import normalise, tables

Query = Callable[[SparkSession, str], DataFrame]
SEGMENTS = {"train": FIT, "test": ("1998-01-01", "2100-01-01")}


def factors158(s: SparkSession, d: str) -> DataFrame:
    """All 158 columns in one run."""
    return tables.dense_panel(s, d).feature_set(factors.factors158(), 5)


def factors360(s: SparkSession, d: str) -> DataFrame:
    """All 360 columns in one run."""
    return tables.dense_panel(s, d).feature_set(factors.factors360(), 6)


def _handler(s: SparkSession, d: str, **how: object) -> handlers.Handler:
    return handlers.Handler(tables.dense_panel(s, d), {"price": {"x": XY["x"]}, "volume": {"y": XY["y"]}}, **how)


def handler_fetch(s: SparkSession, d: str) -> DataFrame:
    """One group of columns of a year, after the processors for inference."""
    handler = _handler(s, d, pipeline=p.Pipeline(infer=[p.DateZScore(["x", "y"])]))
    return rounded(handler.fetch(("1995-01-01", "1995-12-31"), "volume"), 5)


def handler_windows(s: SparkSession, d: str) -> DataFrame:
    """The last three slots of the calendar at each of its slots."""
    rows = _handler(s, d).every_period(3, groups="volume", stage="raw")
    return rounded(rows.groupBy("moment").agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first"), F.sum("y").alias("y")), 4)


def dataset_prepare(s: SparkSession, d: str) -> DataFrame:
    """Segments of a dataset whose processors get their range from the dataset."""
    steps = handlers.with_fit_range([(p.ZScore, {"columns": ["x", "y"]}), p.Fill(["x"], 0.0)], *FIT)
    named = handlers.prepare(_handler(s, d, pipeline=p.Pipeline(infer=steps)), SEGMENTS)
    return rounded(named["train"].withColumn("segment", F.lit("train")).unionByName(named["test"].withColumn("segment", F.lit("test"))), 5)


def handlers_joined(s: SparkSession, d: str) -> DataFrame:
    one = handlers.Handler(tables.dense_panel(s, d), {"g": {"x": XY["x"]}})
    two = handlers.Handler(tables.dense_panel(s, d), {"g": {"y": XY["y"]}})
    return rounded(handlers.from_handlers({"a": one, "b": two}, stage="raw"), 5)


def reweighted(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d).select(INSTRUMENT, TIME)
    return rounded(handlers.reweighted(rows, lambda _: 1.0 / F.count(F.lit(1)).over(Window.partitionBy(TIME))), 8)


def sequence_slices(s: SparkSession, d: str) -> DataFrame:
    return handlers.sequences(tables.bars(s, d), 10)


def day_slices(s: SparkSession, d: str) -> DataFrame:
    return handlers.day_slices(tables.ticks(s, d).select(INSTRUMENT, TIME, "value"))


def benchmark_weights(s: SparkSession, d: str) -> DataFrame:
    items = tables.table(s, d, "lineitem")
    rows = items.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("index"), F.col("l_quantity").alias("weight"))
    return rounded(tables.benchmark_weights(rows, "R"), 8)


def index_changes(s: SparkSession, d: str) -> DataFrame:
    """Members are the instruments that trade on the last session of a month."""
    bars = tables.bars(s, d)
    cal = calendar_of(bars)
    return normalise.membership_changes(bars.join(joins.month_ends(cal).select(TIME), TIME).select(TIME, INSTRUMENT), cal)


def quote_aggregates(s: SparkSession, d: str) -> DataFrame:
    return rounded(execution.quotes(tables.ticks(s, d), "value", [INSTRUMENT, F.to_date(TIME).alias("day")]), 6)


def moment_helpers(s: SparkSession, d: str) -> DataFrame:
    t = F.col(TIME)
    return tables.ticks(s, d).select(INSTRUMENT, TIME, dates.epsilon_change(t).alias("before"), dates.epsilon_change(t, "forward").alias("after"), dates.concat_date_time(F.to_date(t), F.lit("09:30:00")).alias("opening"))


def minute_adjusted(s: SparkSession, d: str) -> DataFrame:
    ticks = tables.ticks(s, d).select(INSTRUMENT, TIME, F.col("value").alias("close"), (F.length("event_type") * 1.0).alias("volume"))
    daily = ticks.groupBy(INSTRUMENT, F.to_date(TIME).alias("day")).agg((1 + F.count(F.lit(1)) / 10).alias("factor"))
    return rounded(normalise.adjust_minutes(ticks, daily), 6)


def rolling_group(s: SparkSession, d: str) -> DataFrame:
    """Models of two markets, each retrained once: the latest of each market's."""
    rows = signal(s, d).where("score IS NOT NULL").select(TIME, INSTRUMENT, "score")
    early = rows.withColumns({"market": F.lit("a"), "start": F.lit(1995)})
    late = rows.where(F.year(TIME) >= 1997).withColumns({"market": F.lit("a"), "start": F.lit(1997), "score": F.col("score") + 1})
    other = rows.withColumns({"market": F.lit("b"), "start": F.lit(1995), "score": -F.col("score")})
    return rounded(signals.grouped_ensemble(early.unionByName(late).unionByName(other), ["market"], F.max_by("score", "start")))


def aligned_sum(s: SparkSession, d: str) -> DataFrame:
    bars = tables.bars(s, d)
    both = joins.aligned(bars.where(F.month(TIME) % 2 == 1), bars.where(F.col(INSTRUMENT) % 2 == 0), "close")
    return rounded(both.select(INSTRUMENT, TIME, (F.col("left") + F.col("right")).alias("v"), F.coalesce("left", F.lit(0.0)).alias("filled")), 4)


def _orders(s: SparkSession, d: str) -> DataFrame:
    orders = tables.table(s, d, "orders")
    return orders.select(F.col("o_orderkey").alias(INSTRUMENT), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("direction"), "o_custkey")


def equal_units(s: SparkSession, d: str) -> DataFrame:
    return rounded(execution.equal_units(_orders(s, d).drop("o_custkey"), 4, 100.0), 4)


def least_impact(s: SparkSession, d: str) -> DataFrame:
    orders = _orders(s, d).withColumn("volatility", F.nullif(F.col("o_custkey") % 7, F.lit(0)) / 2).drop("o_custkey")
    return rounded(execution.least_impact(orders, 5).drop("volatility"), 4)


def better_of_two(s: SparkSession, d: str) -> DataFrame:
    trends = F.array(*[(F.floor(F.col("o_custkey") / k) % 3 - 1).cast("int") for k in (1, 3, 9, 27)])
    return rounded(execution.better_of_two(_orders(s, d).withColumn("trends", trends).drop("o_custkey")), 4)


def clipped_orders(s: SparkSession, d: str) -> DataFrame:
    """An order at each day's bar, within a part of the bar's volume and a month's limit that grows with its days."""
    rows = tables.bars(s, d).select(INSTRUMENT, TIME, F.col("close").alias("amount"), (F.col("volume") * 100).alias("now"))
    # Days of a month stand in for the ticks of a day.
    ticks = rows.withColumns({"_at": F.col(TIME), TIME: F.date_trunc("month", TIME).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, day(datetime))"), "limit": F.day(TIME) * 500.0})
    done = execution.clipped(ticks, "now", "limit")
    return rounded(done.select(INSTRUMENT, F.col("_at").alias(TIME), "deal_amount"), 4)


def weight_orders(s: SparkSession, d: str) -> DataFrame:
    items = tables.table(s, d, "lineitem").withColumnRenamed("l_suppkey", INSTRUMENT)
    held = items.where("l_returnflag = 'A'").groupBy(INSTRUMENT).agg(F.sum("l_quantity").alias("amount"))
    wanted = items.where("l_returnflag = 'R'").groupBy(INSTRUMENT).agg(F.sum("l_quantity").alias("_q"))
    weights = wanted.join(F.broadcast(wanted.agg(F.sum("_q").alias("_all")))).select(INSTRUMENT, (F.col("_q") / F.col("_all")).alias("weight"))
    prices = items.groupBy(INSTRUMENT).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    return rounded(execution.weight_orders(held, weights, prices, 1e6), 4)


def _returns(s: SparkSession, d: str) -> DataFrame:
    return tables.dense_panel(s, d).features({"return": "$close/Ref($close,1)-1"}).where("return IS NOT NULL")


def covariance_shrunk(s: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.shrunk_frame(_returns(s, d)), 5)


def covariance_oas(s: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.shrunk_frame(_returns(s, d), "oas"), 5)


def inverse_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(covariance.inverse_variance_weights(covariance.variances(_returns(s, d))), 8)


def _learned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = signal(s, d).withColumnRenamed("score", "momentum").where("momentum IS NOT NULL")
    return rows.where(F.year(TIME) < 1997), rows


def linear_model(s: SparkSession, d: str) -> DataFrame:
    train, rows = _learned(s, d)
    return rounded(models.linear(train, rows, ["momentum"]).select(INSTRUMENT, TIME, "score"), 6)


def boosted_model(s: SparkSession, d: str) -> DataFrame:
    train, rows = _learned(s, d)
    return rounded(models.boosted(train, rows, ["momentum"], rounds=5).select(INSTRUMENT, TIME, "score"), 6)


def queries() -> dict[str, Query]:
    own = [factors158, factors360, handler_fetch, handler_windows, dataset_prepare, handlers_joined, reweighted, sequence_slices, day_slices, benchmark_weights, index_changes, quote_aggregates, moment_helpers, minute_adjusted, rolling_group, aligned_sum, equal_units, least_impact, better_of_two, clipped_orders, weight_orders, covariance_shrunk, covariance_oas, inverse_weights, linear_model, boosted_model]
    return {f.__name__: f for f in own}


def _set158() -> str:
    lists = "".join(f", list(close) OVER w{d} AS cs{d}, list(high) OVER w{d} AS hs{d}, list(low) OVER w{d} AS ls{d}" for d in factors.WINDOWS)
    names = dict(expressions.CANDLE_SQL) | {f"{f}0": f"{f.lower()} / close" for f in ("OPEN", "HIGH", "LOW", "VWAP")}
    names |= {f"{'MIN' if f == 'LOW' else f}{d}": expressions.FAMILY_SQL[f].format(d=d) for f in factors.FAMILIES for d in factors.WINDOWS}
    over = sql.windows(*factors.WINDOWS)
    inner = ", ".join(f"{e} AS {n}" for n, e in names.items())
    outer = ", ".join(f"{sql.finite(n, 5)} AS {n}" for n in names)
    return f"WITH {sql.DENSE}, {expressions.LAGGED}, q AS MATERIALIZED (SELECT *{lists} FROM l {over}), r AS (SELECT instrument, datetime, {inner} FROM q {over}) SELECT instrument, datetime, {outer} FROM r"


def _set360() -> str:
    past = lambda f, d: f"lag({f}, {d}) OVER i" if d else f
    names = {f"{f}{d}": f"{past(f.lower(), d)} / close" for f in ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP") for d in range(60)}
    names |= {f"VOLUME{d}": f"{past('volume', d)} / (volume + 1e-12)" for d in range(60)}
    return f"WITH {sql.DENSE} SELECT instrument, datetime, {', '.join(f'round({e}, 6) AS {n}' for n, e in names.items())} FROM b {sql.windows()}"


def _pairs() -> str:
    steps, state = [], "SELECT o_orderkey AS instrument, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS direction, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS way, o_totalprice AS left0 FROM orders"
    for i in range(4):
        trend = f"CAST(floor(c / {(1, 3, 9, 27)[i - i % 2]}) AS BIGINT) % 3 - 1"
        fits = f"t = {'' if i % 2 == 0 else '-'}way"
        part = f"CASE WHEN t = 0 THEN left{i} / {4 - i} WHEN {fits} THEN least(2 * left{i} / {5 - i}, left{i}) ELSE 0 END"
        if i == 3:
            part = f"CASE WHEN direction = 'sell' AND (t = 0 OR {fits}) THEN left{i} ELSE {part} END"
        steps.append(f"t{i} AS (SELECT *, {trend} AS t FROM ({state}))")
        steps.append(f"s{i} AS (SELECT * EXCLUDE (t), {part} AS p{i} FROM t{i})")
        state = f"SELECT *, left{i} - p{i} AS left{i + 1} FROM s{i}"
    rows = " UNION ALL ".join(f"SELECT instrument, direction, CAST({i} AS INT) AS slot, round(p{i}, 4) AS amount FROM s3 WHERE p{i} > 1e-5" for i in range(4))
    return f"WITH {', '.join(steps)} {rows}"


def oracle_sql() -> dict[str, str]:
    xy = analysis.xy_sql()
    z = "({c} - avg({c}) OVER (PARTITION BY datetime)) / nullif(stddev_samp({c}) OVER (PARTITION BY datetime), 0)"
    fit = f"(SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM r WHERE datetime BETWEEN TIMESTAMP '{FIT[0]}' AND TIMESTAMP '{FIT[1]}')"
    returns = f"""WITH {sql.DENSE}, f AS (SELECT instrument, datetime, close / lag(close) OVER i - 1 AS r FROM b {sql.windows()}), u AS MATERIALIZED (SELECT * FROM f WHERE r IS NOT NULL),
c AS MATERIALIZED (SELECT instrument, datetime, r - avg(r) OVER (PARTITION BY instrument) AS x FROM u), t AS (SELECT count(DISTINCT datetime) AS t FROM u),
s AS MATERIALIZED (SELECT l.instrument AS a, z.instrument AS b, sum(l.x * z.x) / max(t) AS cov FROM c l JOIN c z USING (datetime) CROSS JOIN t GROUP BY 1, 2),
m AS (SELECT sum(cov) FILTER (a = b) AS trace, count(*) FILTER (a = b) AS n, sum(cov * cov) AS square, max(t) AS t FROM s CROSS JOIN t)"""
    drawn = "SELECT a, b, round((1 - w) * cov + CASE WHEN a = b THEN w * trace / n ELSE 0 END, 5) AS cov FROM s CROSS JOIN k"
    return {
        "factors158": _set158(),
        "factors360": _set360(),
        "handler_fetch": f"WITH {xy}, q AS (SELECT instrument, datetime, {z.replace('{c}', 'y')} AS y FROM r) SELECT instrument, datetime, round(y, 5) AS y FROM q WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'",
        "handler_windows": f"""WITH {xy}, calendar AS MATERIALIZED (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM r)),
p AS (SELECT r.*, k FROM r JOIN calendar USING (datetime)), o AS (SELECT unnest([0, 1, 2]) AS o)
SELECT c.datetime AS moment, count(*) AS n, min(p.datetime) AS first, round(sum(y), 4) AS y FROM p CROSS JOIN o JOIN calendar c ON c.k = p.k + o WHERE c.k >= 3 GROUP BY 1""",
        "dataset_prepare": f"""WITH {xy}, k AS {fit}, q AS (SELECT instrument, datetime, coalesce((x - mx) / nullif(sx, 0), 0) AS x, (y - my) / nullif(sy, 0) AS y FROM r CROSS JOIN k)
SELECT instrument, datetime, round(x, 5) AS x, round(y, 5) AS y, CASE WHEN year(datetime) < 1998 THEN 'train' ELSE 'test' END AS segment FROM q WHERE datetime BETWEEN TIMESTAMP '{FIT[0]}' AND TIMESTAMP '{FIT[1]}' OR datetime >= TIMESTAMP '1998-01-01'""",
        "handlers_joined": f"WITH {xy} SELECT instrument, datetime, round(x, 5) AS a_x, round(y, 5) AS b_y FROM r",
        "reweighted": f"WITH {sql.BARS} SELECT instrument, datetime, round(1.0 / count(*) OVER (PARTITION BY datetime), 8) AS weight FROM bars",
        "sequence_slices": f"WITH {sql.DENSE} SELECT instrument, datetime, CAST(greatest(cal_idx - 9, 0) AS INT) AS first, CAST(cal_idx AS INT) AS last FROM b",
        "day_slices": "SELECT user_id AS instrument, ts AS datetime, value, CAST(ts AS DATE) AS day, CAST(row_number() OVER d - 1 AS INT) AS tick, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) - row_number() OVER d AS \"left\" FROM events WINDOW d AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts)",
        "benchmark_weights": "SELECT CAST(l_shipdate AS DATE) AS datetime, l_suppkey AS instrument, round(avg(l_quantity) / 100, 8) AS weight FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
        "index_changes": f"""WITH {sql.CALENDAR}, d AS MATERIALIZED (SELECT datetime, row_number() OVER (ORDER BY datetime) AS d FROM (SELECT max(datetime) AS datetime FROM calendar GROUP BY date_trunc('month', datetime))),
m AS MATERIALIZED (SELECT DISTINCT x.instrument, d.d FROM bars x JOIN d USING (datetime)),
came AS (SELECT a.instrument, a.d - 1 AS d FROM m a ANTI JOIN m z ON a.instrument = z.instrument AND z.d = a.d - 1 WHERE a.d > 1),
gone AS (SELECT a.instrument, a.d FROM m a ANTI JOIN m z ON a.instrument = z.instrument AND z.d = a.d + 1 WHERE a.d < (SELECT max(d) FROM d))
SELECT instrument, n.datetime, 'add' AS change FROM came JOIN d USING (d) JOIN calendar c ON c.datetime = d.datetime JOIN calendar n ON n.cal_idx = c.cal_idx + 1
UNION ALL SELECT instrument, d.datetime, 'remove' FROM gone JOIN d USING (d)""",
        "quote_aggregates": 'SELECT user_id AS instrument, CAST(ts AS DATE) AS day, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, bool_and(coalesce(value <> 0, false)) AS "all", round(arg_max(value, ts), 6) AS last FROM events GROUP BY 1, 2',
        "moment_helpers": "SELECT user_id AS instrument, ts AS datetime, ts - INTERVAL 1 SECOND AS before, ts + INTERVAL 1 SECOND AS after, date_trunc('day', ts) + INTERVAL 570 MINUTE AS opening FROM events",
        "minute_adjusted": """WITH f AS (SELECT *, 1 + count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) / 10 AS f FROM events)
SELECT user_id AS instrument, ts AS datetime, round(value * f, 6) AS close, round(length(event_type) / f, 6) AS volume, round(f, 6) AS factor FROM f""",
        "rolling_group": f"""WITH {sql.SIGNAL} SELECT datetime, instrument, 'a' AS market, round(CASE WHEN year(datetime) >= 1997 THEN score + 1 ELSE score END, 6) AS score FROM signal WHERE score IS NOT NULL
UNION ALL SELECT datetime, instrument, 'b', round(-score, 6) FROM signal WHERE score IS NOT NULL""",
        "aligned_sum": f"""WITH {sql.BARS}, x AS (SELECT * FROM bars WHERE month(datetime) % 2 = 1), y AS (SELECT * FROM bars WHERE instrument % 2 = 0)
SELECT coalesce(x.instrument, y.instrument) AS instrument, coalesce(x.datetime, y.datetime) AS datetime, round(x.close + y.close, 4) AS v, round(coalesce(x.close, 0), 4) AS filled FROM x FULL JOIN y ON x.instrument = y.instrument AND x.datetime = y.datetime""",
        "equal_units": """WITH o AS (SELECT o_orderkey AS instrument, o_totalprice AS a, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS direction, CAST(floor(o_totalprice / 100) AS BIGINT) AS n FROM orders),
s AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM o),
p AS (SELECT *, (n // 4 + CASE WHEN slot < n % 4 THEN 1 ELSE 0 END) * 100 + CASE WHEN direction = 'sell' AND slot = 3 THEN a - n * 100 ELSE 0 END AS amount FROM s)
SELECT instrument, round(amount, 4) AS amount, direction, CAST(slot AS INT) AS slot FROM p WHERE amount > 1e-5""",
        "least_impact": """WITH o AS (SELECT o_orderkey AS instrument, o_totalprice AS a, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS direction, nullif(o_custkey % 7, 0) / 2 AS v, unnest([0, 1, 2, 3, 4]) AS slot FROM orders),
k AS (SELECT *, acosh(0.4 * v * v / 2 + 1) AS k FROM o)
SELECT instrument, round(a * coalesce((sinh(k * (5 - slot)) - sinh(k * (4 - slot))) / nullif(sinh(k * 5), 0), 0.2), 4) AS amount, direction, CAST(slot AS INT) AS slot FROM k""",
        "better_of_two": _pairs(),
        "clipped_orders": f"""WITH RECURSIVE {sql.BARS}, e AS MATERIALIZED (SELECT instrument, datetime, date_trunc('month', datetime) AS m, least(close, volume * 100) AS a, day(datetime) * 500.0 AS l, row_number() OVER (PARTITION BY instrument, date_trunc('month', datetime) ORDER BY datetime) AS k FROM bars),
r AS (SELECT *, greatest(least(a, l), 0) AS got, greatest(least(a, l), 0) AS d FROM e WHERE k = 1
  UNION ALL SELECT e.*, greatest(least(e.a, e.l - r.d), 0), r.d + greatest(least(e.a, e.l - r.d), 0) FROM r JOIN e ON e.instrument = r.instrument AND e.m = r.m AND e.k = r.k + 1)
SELECT instrument, datetime, round(got, 4) AS deal_amount FROM r""",
        "weight_orders": """WITH p AS (SELECT l_suppkey AS i, sum(l_extendedprice) / sum(l_quantity) AS p, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
t AS (SELECT sum(a * p) + 1e6 AS account, sum(r) AS r FROM p), g AS (SELECT i, coalesce(p.r / t.r * account * 0.95 / p, 0) - coalesce(a, 0) AS g FROM p CROSS JOIN t)
SELECT i AS instrument, round(abs(g), 4) AS amount, CASE WHEN g > 0 THEN 'buy' ELSE 'sell' END AS direction FROM g WHERE abs(g) > 1e-5""",
        "covariance_shrunk": f"""{returns}, d AS (SELECT sum(v * v) AS fourth FROM (SELECT sum(x * x) AS v FROM c GROUP BY datetime)),
k AS (SELECT trace, n, greatest(0, least(1, (fourth / t - square) / t / (square - trace * trace / n))) AS w FROM m CROSS JOIN d) {drawn}""",
        "covariance_oas": f"""{returns}, k AS (SELECT trace, n, greatest(0, least(1, ((1 - 2 / n) * square + trace * trace) / ((t + 1 - 2 / n) * (square - trace * trace / n)))) AS w FROM m) {drawn}""",
        "inverse_weights": f"{returns} SELECT a AS instrument, round(1 / cov / sum(1 / cov) OVER (), 8) AS weight FROM s WHERE a = b",
        "linear_model": f"""WITH {sql.SIGNAL}, k AS (SELECT regr_slope(label, score) AS w, regr_intercept(label, score) AS b FROM signal WHERE score IS NOT NULL AND label IS NOT NULL AND year(datetime) < 1997)
SELECT instrument, datetime, round(score * w + b, 6) AS score FROM signal CROSS JOIN k WHERE score IS NOT NULL""",
    }
