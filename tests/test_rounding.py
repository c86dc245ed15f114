"""Results are rounded as their SQL rounds them."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkite.functions import elementwise
from panelkite.queries import expressions


def test_halves_are_rounded_as_in_sql(spark):
    values = pd.DataFrame({"i": range(10_000), "x": np.concatenate([np.arange(-2000, 2000) / 640, np.arange(-3000, 3000) / 3200])})
    got = spark.createDataFrame(values).select("i", elementwise.rounded(F.col("x"), 6).alias("r")).toPandas().sort_values("i")["r"]
    want = duckdb.sql("SELECT round(x, 6) AS r FROM values ORDER BY i").df()["r"]
    assert (got.to_numpy() == want.to_numpy()).all()


def test_what_has_no_digits_stays(spark):
    odd = spark.createDataFrame([(0, float("inf")), (1, float("-inf")), (2, 1e300), (3, None), (4, float("nan")), (5, -1e-9)], "i int, x double")
    got = [r[0] for r in odd.orderBy("i").select(elementwise.rounded(F.col("x"), 6)).collect()]
    assert got[:4] == [float("inf"), float("-inf"), 1e300, None]
    assert np.isnan(got[4]) and str(got[5]) == "0.0"


def test_zeros_keep_their_signs_as_in_sql(spark):
    values = pd.DataFrame({"i": range(8), "x": [-0.0, 0.0, -1e-9, 1e-9, -5e-7, 5e-7, -2.5, float("-inf")]})
    got = spark.createDataFrame(values).select("i", elementwise.rounded(F.col("x"), 6, signed=True).alias("r")).toPandas().sort_values("i")["r"]
    want = duckdb.sql("SELECT round(x, 6) AS r FROM values ORDER BY i").df()["r"]
    assert list(map(str, got)) == list(map(str, want))


def test_div_has_the_zeros_of_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    want = con.sql(expressions.oracle_sql()["div"]).df()
    got = expressions.queries()["div"](spark, folder).toPandas()
    both = got.merge(want, on=["instrument", "datetime"])
    assert len(both) == len(got) == len(want)
    assert ((want["v"] == 0) & np.signbit(want["v"])).any()
    assert (both["v_x"].map(str) == both["v_y"].map(str)).all()
