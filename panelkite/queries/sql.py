"""Common table expressions of the oracle queries, materialised: several are read more than once."""

from __future__ import annotations

BARS = """bars AS MATERIALIZED (
  SELECT l_suppkey AS instrument, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS datetime,
         arg_min(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, struct_pack(a := l_orderkey, b := l_linenumber, c := l_extendedprice)) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS vwap
  FROM lineitem GROUP BY 1, 2)"""
DENSE = f"""{BARS},
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS cal_idx FROM bars)"""
CALENDAR = f"""{BARS},
calendar AS MATERIALIZED (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS cal_idx FROM (SELECT DISTINCT datetime FROM bars))"""
SPINE = f"""{CALENDAR},
b AS MATERIALIZED (
  SELECT s.instrument, c.datetime, c.cal_idx, open, high, low, close, volume, vwap
  FROM (SELECT instrument, min(datetime) AS a, max(datetime) AS z FROM bars GROUP BY 1) s
  JOIN calendar c ON c.datetime BETWEEN s.a AND s.z
  LEFT JOIN bars x ON x.instrument = s.instrument AND x.datetime = c.datetime)"""
SIGNAL = f"""{DENSE},
signal AS MATERIALIZED (
  SELECT instrument, datetime, close / lag(close, 5) OVER i - 1 AS score, lead(close, 2) OVER i / lead(close, 1) OVER i - 1 AS label
  FROM b WINDOW i AS (PARTITION BY instrument ORDER BY cal_idx))"""


def windows(*sizes: int) -> str:
    """WINDOW clause with i (an instrument's slots), e (all so far) and w<n> (the last n)."""
    named = ["i AS (PARTITION BY instrument ORDER BY cal_idx)", "e AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"]
    named += [f"w{n} AS (PARTITION BY instrument ORDER BY cal_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes]
    return "WINDOW " + ", ".join(named)


def finite(expression: str, digits: int = 6) -> str:
    return f"CASE WHEN isfinite({expression}) THEN round({expression}, {digits}) END"
