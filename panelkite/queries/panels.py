"""Queries of scans, ingestion, universes, joins, point-in-time data and days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.operators import intraday, joins, universe
from panelkite.operators.panel import Panel, calendar_of
from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME
from panelkite.queries import sql
from panelkite.sources import health, normalise, store, tables

Query = Callable[[SparkSession, str], DataFrame]
CUT = "1997-01-01"


def _dense(s: SparkSession, d: str) -> Panel:
    return tables.dense_panel(s, d)


def calendar_scan(s: SparkSession, d: str) -> DataFrame:
    return tables.spine_panel(s, d).trading_days("1995-01-01", "1996-12-31").select(TIME, F.col(SLOT).cast("bigint").alias("slot"))


def universe_all(s: SparkSession, d: str) -> DataFrame:
    return universe.list_spans(universe.spans_of_panel(tables.bars(s, d)), "1996-01-01", "1999-12-31")


def calendar_align_spine(s: SparkSession, d: str) -> DataFrame:
    return tables.spine_panel(s, d).rows.groupBy(INSTRUMENT).agg(F.count(F.lit(1)).alias("n_slots"), F.count("close").alias("n_bars"))


def dedup_first(s: SparkSession, d: str) -> DataFrame:
    raw = tables.table(s, d, "lineitem").select(F.col("l_suppkey").alias(INSTRUMENT), F.col("l_shipdate").alias(TIME), "l_extendedprice")
    return store.first_rows(raw, "l_extendedprice").select(INSTRUMENT, TIME, F.col("l_extendedprice").alias("price"))


def field_selection(s: SparkSession, d: str) -> DataFrame:
    return store.chosen_fields(tables.bars(s, d), include=["open", "close", "volume"], exclude=["volume"])


def ingest_update_split(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d).select(INSTRUMENT, TIME, "close")
    old = rows.where((F.col(TIME) < F.lit(CUT).cast("timestamp_ntz")) & (F.col(INSTRUMENT) % 3 != 0))
    later, fresh = store.only_new(rows, store.spans(old))
    return later.withColumn("kind", F.lit("later")).unionByName(fresh.withColumn("kind", F.lit("fresh"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first"))


def health_missing(s: SparkSession, d: str) -> DataFrame:
    return health.missing_values(tables.spine_panel(s, d).rows)


def health_large_step(s: SparkSession, d: str) -> DataFrame:
    return health.large_steps(tables.bars(s, d), 0.9, 30.0).select(INSTRUMENT, TIME, "column", F.round("change", 4).alias("change"))


def normalise_rebase(s: SparkSession, d: str) -> DataFrame:
    return normalise.rebase(tables.bars(s, d)).select(INSTRUMENT, TIME, F.round("close", 6).alias("close"), F.round("volume", 2).alias("volume"))


def normalise_change(s: SparkSession, d: str) -> DataFrame:
    return tables.spine_panel(s, d).rows.select(INSTRUMENT, TIME, F.round(normalise.change(), 6).alias("change"))


def paused_days(s: SparkSession, d: str) -> DataFrame:
    return normalise.traded_days(tables.spine_panel(s, d).rows).select(INSTRUMENT, TIME, "paused_num")


def busy_calendar(s: SparkSession, d: str) -> DataFrame:
    return normalise.busy_calendar(tables.bars(s, d), 0.25, 2)


def index_membership(s: SparkSession, d: str) -> DataFrame:
    return normalise.membership(tables.bars(s, d).where("volume > 25").select(INSTRUMENT, TIME))


def name_filter(s: SparkSession, d: str) -> DataFrame:
    rows = tables.table(s, d, "customer").select(F.col("c_name").alias(INSTRUMENT), F.to_timestamp_ntz(F.lit("1995-01-01")).alias(TIME), F.lit(0).alias(SLOT))
    return universe.NameFilter(pattern=r"Customer#0*1[0-9]+$").flag(None, rows).where("_flag").select(INSTRUMENT)


def expr_filter_spans(s: SparkSession, d: str) -> DataFrame:
    panel = _dense(s, d)
    return universe.apply_filters(panel, None, [universe.ExpressionFilter(rule="Mean($close,5)>Mean($close,20)", start="1996-01-01", end="1998-12-31")])


def membership_mask(s: SparkSession, d: str) -> DataFrame:
    spans = tables.table(s, d, "orders").groupBy(F.col("o_custkey").alias(INSTRUMENT)).agg(F.min("o_orderdate").alias("start_datetime"), F.max("o_orderdate").alias("end_datetime"))
    out = _dense(s, d).features({"v": "Mean($close,5)/$close"}, instruments=spans)
    return out.select(INSTRUMENT, TIME, F.round("v", 6).alias("v"))


def time_range_filter(s: SparkSession, d: str) -> DataFrame:
    return universe.covers_range(tables.bars(s, d), "1995-01-09", "2001-10-20").groupBy(INSTRUMENT).agg(F.count(F.lit(1)).alias("n"))


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.bars(s, d)
    return rows.where("volume > 10").select(INSTRUMENT, TIME, "open", "close"), rows.where("volume < 60").select(INSTRUMENT, TIME, "close", "high")


def join_full_groups(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return joins.side_by_side([a.select(INSTRUMENT, TIME, "open"), b.select(INSTRUMENT, TIME, "high")])


def join_left_nested(s: SparkSession, d: str) -> DataFrame:
    return joins.nested(list(_two(s, d)))


def join_overlay(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return joins.overlay(a.select(INSTRUMENT, TIME, "close"), b.select(INSTRUMENT, TIME, (F.col("close") + 1).alias("close")))


def join_replace_range(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d).select(INSTRUMENT, TIME, "close")
    return joins.replace_range(rows, rows.withColumn("close", -F.col("close")), CUT)


def join_asof(s: SparkSession, d: str) -> DataFrame:
    left = tables.ticks(s, d).select(INSTRUMENT, TIME, "value")
    right = tables.table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias(INSTRUMENT), "ts", F.col("event_id").alias("last_purchase"))
    return joins.as_of(left, right, "ts", ["last_purchase"]).withColumn("last_purchase", F.coalesce("last_purchase", F.lit(-1)))


def join_mature_labels(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d)
    out = joins.mature_labels(rows.select(INSTRUMENT, TIME, F.col("close").alias("price")), calendar_of(rows), 5)
    return out.withColumn("label", F.round("label", 6))


def join_theta_training(s: SparkSession, d: str) -> DataFrame:
    rows = tables.bars(s, d)
    labels = joins.mature_labels(rows.select(INSTRUMENT, TIME, F.col("close").alias("price")), calendar_of(rows), 5)
    origins = joins.month_ends(calendar_of(rows)).select(F.col(TIME).alias("issued_at"))
    return joins.training_rows(labels, origins).groupBy("issued_at").agg(F.count(F.lit(1)).alias("n"), F.max(TIME).alias("last"))


def join_benchmark(s: SparkSession, d: str) -> DataFrame:
    from panelkite.operators import portfolio

    rows = _dense(s, d).features({"return": "$close/Ref($close,1)-1"})
    bench = portfolio.benchmark_returns(rows)
    return rows.join(bench, TIME).select(INSTRUMENT, TIME, F.round(F.col("return") - F.col("bench"), 6).alias("excess"))


def join_daily_minutes(s: SparkSession, d: str) -> DataFrame:
    ticks = tables.ticks(s, d).select(INSTRUMENT, TIME, "value")
    daily = ticks.groupBy(INSTRUMENT, F.date_trunc("day", TIME).cast("timestamp_ntz").alias(TIME)).agg(F.max("value").alias("day_high"))
    return joins.daily_onto_minutes(ticks, daily, ["day_high"])


def date_shift(s: SparkSession, d: str) -> DataFrame:
    cal = calendar_of(tables.bars(s, d))
    return joins.shift_dates(cal.select(TIME), cal, 10)


def date_shift_clipped(s: SparkSession, d: str) -> DataFrame:
    cal = calendar_of(tables.bars(s, d))
    return joins.shift_dates(cal.select(TIME), cal, -10, clip=True)


def month_end_sessions(s: SparkSession, d: str) -> DataFrame:
    return joins.month_ends(calendar_of(tables.bars(s, d)))


def _pit(expression: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = tables.table(s, d, "orders").select(F.col("o_custkey").alias(INSTRUMENT)).distinct()
        days = s.sql("SELECT explode(sequence(TIMESTAMP_NTZ '1992-01-01', TIMESTAMP_NTZ '1998-12-01', INTERVAL 1 MONTH)) AS datetime")
        days = days.withColumn(SLOT, (F.year(TIME) * 12 + F.month(TIME)).cast("int"))
        panel = Panel(rows.join(F.broadcast(days)).select(INSTRUMENT, TIME, SLOT), days, periods=tables.publications(s, d))
        return panel.features({"v": expression}).select(INSTRUMENT, TIME, F.round("v", 4).alias("v"))

    return run


def day_cumsum(s: SparkSession, d: str) -> DataFrame:
    panel = Panel.dense(tables.ticks(s, d))
    return panel.features({"v": "DayCumsum($value,'9:30','14:59')"}).select(INSTRUMENT, TIME, F.round("v", 4).alias("v"))


def day_last(s: SparkSession, d: str) -> DataFrame:
    return Panel.dense(tables.ticks(s, d)).features({"v": "DayLast($value)"})


def _resampled(func: str, freq: str = "6h") -> Query:
    return lambda s, d: intraday.resample(tables.ticks(s, d), "value", freq, func).withColumn("value", F.round("value", 8))


def resample_expression(s: SparkSession, d: str) -> DataFrame:
    out = Panel.dense(tables.ticks(s, d)).features({"v": "TResample($value*2,'1d','max')"})
    return out.select(INSTRUMENT, TIME, F.round("v", 4).alias("v"))


def _calendar(every: int, unit: str) -> Query:
    return lambda s, d: intraday.resample_calendar(calendar_of(tables.bars(s, d)).select(TIME), every, unit)


def range_aggregate(s: SparkSession, d: str) -> DataFrame:
    return intraday.aggregate_range(tables.bars(s, d), "close", "1995-01-01", "1995-06-30", "last")


def between_times(s: SparkSession, d: str) -> DataFrame:
    return intraday.between_times(tables.ticks(s, d), ("9:30", "11:29"), ("13:00", "14:59")).select(INSTRUMENT, TIME, "value")


def session_floor(s: SparkSession, d: str) -> DataFrame:
    rows = tables.ticks(s, d).select(INSTRUMENT, TIME, intraday.session_floor(30).alias("slot"))
    return rows.where("slot IS NOT NULL")


def minute_calendar(s: SparkSession, d: str) -> DataFrame:
    days = calendar_of(tables.bars(s, d)).select(TIME)
    return intraday.minute_calendar(days).groupBy(F.to_date(TIME).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first"), F.max(TIME).alias("last"))


def union_frames(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    return a.unionByName(b, allowMissingColumns=True)


def _codes(s: SparkSession, d: str, how: str) -> DataFrame:
    a, b = _two(s, d)
    left = a.where(F.month(TIME) == 1).select(INSTRUMENT, F.year(TIME).alias("year"))
    right = b.where(F.month(TIME) == 2).select(INSTRUMENT, F.year(TIME).alias("year"))
    return {"intersect": left.intersect(right), "except": left.subtract(right), "union": left.union(right).distinct()}[how]


def tail1_per_instrument(s: SparkSession, d: str) -> DataFrame:
    return tables.bars(s, d).groupBy(INSTRUMENT).agg(F.max_by("close", TIME).alias("close"))


def raw_csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Bars written as CSV and read back as a raw source."""
    path = tables.scratch(s, "raw") + ".csv"
    rows = tables.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows.write.option("header", True).csv(path)
    return tables.read_raw(s, path, "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE")


def stored_update(s: SparkSession, d: str) -> DataFrame:
    """A store that is filled up to a day and then brought up to date gives the panel of all bars."""
    rows = tables.bars(s, d)
    at = store.Store(s, tables.scratch(s, "store"))
    at.ingest_all(rows.where(F.col(TIME) < F.lit(CUT).cast("timestamp_ntz")))
    at.ingest_update(rows)
    return at.read("features").select(INSTRUMENT, TIME, "close")


def queries() -> dict[str, Query]:
    own = [calendar_scan, universe_all, calendar_align_spine, dedup_first, field_selection, ingest_update_split, health_missing, health_large_step, normalise_rebase, normalise_change, paused_days, busy_calendar, index_membership, name_filter, expr_filter_spans, membership_mask, time_range_filter, join_full_groups, join_left_nested, join_overlay, join_replace_range, join_asof, join_mature_labels, join_theta_training, join_benchmark, join_daily_minutes, date_shift, date_shift_clipped, month_end_sessions, day_cumsum, day_last, resample_expression, range_aggregate, between_times, session_floor, minute_calendar, union_frames, tail1_per_instrument, raw_csv_round_trip, stored_update]
    out: dict[str, Query] = {f.__name__: f for f in own}
    out |= {"pit_latest": _pit("P($$total_q)"), "pit_mean2": _pit("P(Mean($$total_q,2))"), "pit_ref1": _pit("P($$total_q/Ref($$total_q,1)-1)"), "pref_fixed": _pit("PRef($$total_q,199402)")}
    out |= {f"resample_{f}": _resampled(f) for f in ("last", "sum", "mean", "ffill", "count")}
    out |= {"calendar_resample_day3": _calendar(3, "day"), "calendar_resample_week": _calendar(1, "week"), "calendar_resample_month2": _calendar(2, "month")}
    out |= {f"{how}_codes": (lambda s, d, how=how: _codes(s, d, how)) for how in ("intersect", "except", "union")}
    return out


_LAST = """known AS (
  SELECT m.instrument, m.date, r.period, arg_max(r.value, r.date) AS value
  FROM (SELECT DISTINCT instrument, date FROM pub) m JOIN pub r ON r.instrument = m.instrument AND r.date <= m.date GROUP BY 1, 2, 3)"""
_PIT = f"""pub AS (
  SELECT o_custkey AS instrument, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS period, CAST(o_orderdate AS DATE) AS date,
         arg_max(o_totalprice, struct_pack(a := o_orderkey, b := o_totalprice)) AS value FROM orders GROUP BY 1, 2, 3),
{_LAST},
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS TIMESTAMP) AS datetime),
grid AS (SELECT i.instrument, d.datetime, (SELECT max(p.date) FROM pub p WHERE p.instrument = i.instrument AND p.date <= d.datetime) AS at
         FROM (SELECT DISTINCT instrument FROM pub) i, days d),
top AS (SELECT instrument, date, max(period) AS period FROM known GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    two = f"WITH {sql.BARS}, x AS (SELECT instrument, datetime, open, close FROM bars WHERE volume > 10), y AS (SELECT instrument, datetime, close, high FROM bars WHERE volume < 60)"
    cal = f"WITH {sql.CALENDAR}"
    mature = f"""{sql.CALENDAR}, labels AS (
  SELECT b.instrument, b.datetime, m.datetime AS matures, CASE WHEN m.datetime IS NOT NULL AND z.close IS NOT NULL THEN z.close / b.close - 1 END AS label,
         CASE WHEN m.datetime IS NULL THEN 'NOT_MATURE' WHEN z.close IS NULL THEN 'NO_MATURITY_PRICE' ELSE 'AVAILABLE' END AS status
  FROM bars b JOIN calendar c USING (datetime) LEFT JOIN calendar m ON m.cal_idx = c.cal_idx + 5 LEFT JOIN bars z ON z.instrument = b.instrument AND z.datetime = m.datetime)"""
    pit = "WITH {0} SELECT g.instrument, g.datetime, {1} AS v FROM grid g LEFT JOIN top t ON t.instrument = g.instrument AND t.date = g.at {2}"
    k0 = "LEFT JOIN known k0 ON k0.instrument = g.instrument AND k0.date = g.at AND k0.period = t.period"
    k1 = f"{k0} LEFT JOIN known k1 ON k1.instrument = g.instrument AND k1.date = g.at AND k1.period = t.period - 1"
    bins = """bins AS (SELECT user_id AS instrument, time_bucket(INTERVAL 6 HOUR, ts) AS datetime, {0} AS value FROM events GROUP BY 1, 2),
slots AS (SELECT instrument, unnest(generate_series(min(datetime), max(datetime), INTERVAL 6 HOUR)) AS datetime FROM bins GROUP BY 1),
filled AS (SELECT s.instrument, s.datetime, b.value FROM slots s LEFT JOIN bins b USING (instrument, datetime))"""
    resample = lambda v, out="round(value, 8)": f"WITH {bins.format(v)} SELECT instrument, datetime, {out} AS value FROM filled"
    minute = "(hour(ts) * 60 + minute(ts))"
    session = f"CASE WHEN {minute} BETWEEN 570 AND 689 THEN {minute} - 570 WHEN {minute} BETWEEN 780 AND 899 THEN {minute} - 660 END"
    codes = two + ", l AS (SELECT instrument, CAST(year(datetime) AS INT) AS year FROM x WHERE month(datetime) = 1), r AS (SELECT instrument, CAST(year(datetime) AS INT) AS year FROM y WHERE month(datetime) = 2) SELECT * FROM l {0} SELECT * FROM r"
    picked = "WITH {0}, p AS (SELECT datetime FROM (SELECT datetime, lag(datetime) OVER (ORDER BY datetime) AS z FROM calendar) WHERE {1}), n AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS n FROM p) SELECT datetime FROM n WHERE n % {2} = 0"
    steps = " UNION ALL ".join(f"SELECT instrument, datetime, '{c}' AS \"column\", {c} / lag({c}) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS change FROM bars" for c in health.REQUIRED)
    first_close = "first_value(close) OVER (PARTITION BY instrument ORDER BY datetime)"
    return {
        "calendar_scan": f"{cal} SELECT datetime, cal_idx AS slot FROM calendar WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
        "universe_all": f"WITH {sql.BARS} SELECT instrument, greatest(min(datetime), TIMESTAMP '1996-01-01') AS start_datetime, least(max(datetime), TIMESTAMP '1999-12-31') AS end_datetime FROM bars GROUP BY 1",
        "calendar_align_spine": f"WITH {sql.SPINE} SELECT instrument, count(*) AS n_slots, count(close) AS n_bars FROM b GROUP BY 1",
        "dedup_first": "SELECT l_suppkey AS instrument, l_shipdate AS datetime, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2",
        "field_selection": f"WITH {sql.BARS} SELECT instrument, datetime, open, close FROM bars",
        "ingest_update_split": f"""WITH {sql.BARS}, old AS (SELECT instrument, max(datetime) AS z FROM bars WHERE datetime < TIMESTAMP '{CUT}' AND instrument % 3 <> 0 GROUP BY 1)
SELECT CASE WHEN o.z IS NULL THEN 'fresh' ELSE 'later' END AS kind, count(*) AS n, min(datetime) AS first FROM bars b LEFT JOIN old o USING (instrument) WHERE o.z IS NULL OR b.datetime > o.z GROUP BY 1""",
        "health_missing": f"WITH {sql.SPINE} SELECT instrument, {', '.join(f'count(*) - count({c}) AS {c}' for c in health.REQUIRED)} FROM b GROUP BY 1 HAVING count(*) > count(close)",
        "health_large_step": f"WITH {sql.BARS}, s AS ({steps}) SELECT instrument, datetime, \"column\", round(change, 4) AS change FROM s WHERE abs(change) > CASE WHEN \"column\" = 'volume' THEN 30.0 ELSE 0.9 END",
        "normalise_rebase": f"WITH {sql.BARS} SELECT instrument, datetime, round(close / {first_close}, 6) AS close, round(volume * {first_close}, 2) AS volume FROM bars",
        "normalise_change": f"""WITH {sql.SPINE}, f AS (SELECT *, last_value(close IGNORE NULLS) OVER e AS c FROM b {sql.windows()})
SELECT instrument, datetime, round(c / lag(c) OVER i - 1, 6) AS change FROM f {sql.windows()}""",
        "paused_days": f"""WITH {sql.SPINE}, r AS (SELECT *, sum(CASE WHEN volume > 0 THEN 0 ELSE 1 END) OVER e AS run FROM b {sql.windows()})
SELECT instrument, datetime, CAST(sum(CASE WHEN volume > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, run ORDER BY cal_idx) AS BIGINT) AS paused_num FROM r""",
        "busy_calendar": f"""WITH {sql.BARS}, s AS (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM bars GROUP BY 1),
t AS (SELECT datetime, count(DISTINCT instrument) AS n FROM bars WHERE volume > 0 GROUP BY 1)
SELECT t.datetime FROM t WHERE t.n >= greatest((SELECT count(*) FROM s WHERE s.a <= t.datetime AND s.z >= t.datetime) * 0.25, 2)""",
        "index_membership": f"""WITH {sql.BARS}, m AS (SELECT instrument, datetime FROM bars WHERE volume > 25), d AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS n FROM (SELECT DISTINCT datetime FROM m)),
r AS (SELECT instrument, datetime, n - row_number() OVER (PARTITION BY instrument ORDER BY n) AS run FROM m JOIN d USING (datetime))
SELECT instrument, min(datetime) AS start_datetime, max(datetime) AS end_datetime FROM r GROUP BY instrument, run""",
        "name_filter": "SELECT c_name AS instrument FROM customer WHERE regexp_matches(c_name, '^(?:Customer#0*1[0-9]+$)')",
        "expr_filter_spans": f"""WITH {sql.DENSE}, f AS (SELECT *, CASE WHEN datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' THEN avg(close) OVER w5 > avg(close) OVER w20 ELSE true END AS ok FROM b {sql.windows(5, 20)}),
r AS (SELECT *, cal_idx - row_number() OVER (PARTITION BY instrument ORDER BY cal_idx) AS run FROM f WHERE ok)
SELECT instrument, min(datetime) AS start_datetime, max(datetime) AS end_datetime FROM r GROUP BY instrument, run""",
        "membership_mask": f"""WITH {sql.DENSE}, m AS (SELECT instrument, datetime, avg(close) OVER w5 / close AS v FROM b {sql.windows(5)}),
s AS (SELECT o_custkey AS instrument, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1)
SELECT m.instrument, m.datetime, round(v, 6) AS v FROM m JOIN s USING (instrument) WHERE m.datetime BETWEEN s.a AND s.z""",
        "time_range_filter": f"WITH {sql.BARS} SELECT instrument, count(*) AS n FROM bars GROUP BY 1 HAVING min(datetime) <= TIMESTAMP '1995-01-09' AND max(datetime) >= TIMESTAMP '2001-10-20'",
        "join_full_groups": f"{two} SELECT coalesce(x.instrument, y.instrument) AS instrument, coalesce(x.datetime, y.datetime) AS datetime, open, high FROM x FULL JOIN y ON x.instrument = y.instrument AND x.datetime = y.datetime",
        "join_left_nested": f"{two} SELECT x.instrument, x.datetime, x.open, y.close, y.high FROM x LEFT JOIN y ON x.instrument = y.instrument AND x.datetime = y.datetime",
        "join_overlay": f"{two} SELECT coalesce(x.instrument, y.instrument) AS instrument, coalesce(x.datetime, y.datetime) AS datetime, coalesce(y.close + 1, x.close) AS close FROM x FULL JOIN y ON x.instrument = y.instrument AND x.datetime = y.datetime",
        "join_replace_range": f"WITH {sql.BARS} SELECT instrument, datetime, CASE WHEN datetime >= TIMESTAMP '{CUT}' THEN -close ELSE close END AS close FROM bars",
        "join_asof": "SELECT e.user_id AS instrument, e.ts AS datetime, e.value, coalesce(p.event_id, -1) AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
        "join_mature_labels": f"WITH {mature} SELECT instrument, datetime, matures, round(label, 6) AS label, status FROM labels",
        "join_theta_training": f"""WITH {mature}, o AS (SELECT max(datetime) AS issued_at FROM calendar GROUP BY date_trunc('month', datetime))
SELECT issued_at, count(*) AS n, max(datetime) AS last FROM o JOIN labels l ON l.matures <= o.issued_at AND l.datetime < o.issued_at WHERE status = 'AVAILABLE' GROUP BY 1""",
        "join_benchmark": f"WITH {sql.DENSE}, r AS (SELECT *, close / lag(close) OVER i - 1 AS r FROM b {sql.windows()}), m AS (SELECT datetime, coalesce(avg(r), 0) AS bench FROM r GROUP BY 1) SELECT instrument, datetime, round(r - bench, 6) AS excess FROM r JOIN m USING (datetime)",
        "join_daily_minutes": "SELECT user_id AS instrument, ts AS datetime, value, max(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS day_high FROM events",
        "date_shift": f"{cal} SELECT a.datetime, z.datetime AS shifted FROM calendar a LEFT JOIN calendar z ON z.cal_idx = a.cal_idx + 10",
        "date_shift_clipped": f"{cal} SELECT a.datetime, z.datetime AS shifted FROM calendar a JOIN calendar z ON z.cal_idx = greatest(a.cal_idx - 10, 0)",
        "month_end_sessions": f"{cal} SELECT max(datetime) AS datetime FROM calendar GROUP BY date_trunc('month', datetime)",
        "day_cumsum": f"SELECT user_id AS instrument, ts AS datetime, round(CASE WHEN {minute} BETWEEN 570 AND 899 THEN sum(CASE WHEN {minute} BETWEEN 570 AND 899 THEN value END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) ELSE 0 END, 4) AS v FROM events",
        "day_last": "SELECT user_id AS instrument, ts AS datetime, last_value(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM events",
        "resample_expression": """WITH bins AS (SELECT user_id AS instrument, time_bucket(INTERVAL 1 DAY, ts) AS datetime, max(value * 2) AS v FROM events GROUP BY 1, 2),
slots AS (SELECT instrument, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 DAY)) AS datetime FROM bins GROUP BY 1)
SELECT s.instrument, s.datetime, round(b.v, 4) AS v FROM slots s LEFT JOIN bins b USING (instrument, datetime)""",
        "range_aggregate": f"WITH {sql.BARS} SELECT instrument, arg_max(close, datetime) AS close FROM bars WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30' GROUP BY 1",
        "between_times": "SELECT user_id AS instrument, ts AS datetime, value FROM events WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '11:29:00.999999' OR CAST(ts AS TIME) BETWEEN TIME '13:00:00' AND TIME '14:59:00.999999'",
        "session_floor": f"""WITH m AS (SELECT user_id AS instrument, ts, {session} AS m FROM events), f AS (SELECT *, CAST(floor(m / 30) * 30 AS BIGINT) AS slot FROM m WHERE m IS NOT NULL)
SELECT instrument, ts AS datetime, CAST(date_trunc('day', ts) AS TIMESTAMP) + to_minutes(CASE WHEN slot < 120 THEN slot + 570 ELSE slot + 660 END) AS slot FROM f""",
        "minute_calendar": f"{cal} SELECT CAST(datetime AS DATE) AS day, CAST(240 AS BIGINT) AS n, datetime + INTERVAL 570 MINUTE AS first, datetime + INTERVAL 899 MINUTE AS last FROM calendar",
        "union_frames": f"{two} SELECT instrument, datetime, open, close, NULL::DOUBLE AS high FROM x UNION ALL SELECT instrument, datetime, NULL, close, high FROM y",
        "tail1_per_instrument": f"WITH {sql.BARS} SELECT instrument, arg_max(close, datetime) AS close FROM bars GROUP BY 1",
        "raw_csv_round_trip": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
        "stored_update": f"WITH {sql.SPINE} SELECT instrument, datetime, close FROM b",
        "pit_latest": pit.format(_PIT, "round(k0.value, 4)", k0),
        "pit_mean2": pit.format(_PIT, "round(CASE WHEN k1.value IS NULL THEN k0.value ELSE (k0.value + k1.value) / 2 END, 4)", k1),
        "pit_ref1": pit.format(_PIT, "round(k0.value / k1.value - 1, 4)", k1),
        "pref_fixed": pit.format(_PIT, "round(k.value, 4)", f"LEFT JOIN known k ON k.instrument = g.instrument AND k.date = g.at AND k.period = {1994 * 4 + 1}"),
        "resample_last": resample("arg_max(value, ts)"),
        "resample_sum": resample("sum(value)"),
        "resample_mean": resample("avg(value)"),
        "resample_ffill": resample("arg_max(value, ts)", "round(last_value(value IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime), 8)"),
        "resample_count": resample("count(value)", "coalesce(value, 0)"),
        "calendar_resample_day3": picked.format(sql.CALENDAR, "true", 3),
        "calendar_resample_week": picked.format(sql.CALENDAR, "z IS NULL OR isodow(datetime) < isodow(z)", 1),
        "calendar_resample_month2": picked.format(sql.CALENDAR, "z IS NULL OR day(datetime) < day(z)", 2),
        "intersect_codes": codes.format("INTERSECT"),
        "except_codes": codes.format("EXCEPT"),
        "union_codes": codes.format("UNION"),
    }
