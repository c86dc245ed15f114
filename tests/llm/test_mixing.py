import duckdb
import pytest
from pyspark.sql import functions as F

from panelkite.llm import mixing


def filled(sizes, weights, share, most=2):
    """Targets by resharing, step by step."""
    budget = share * sum(sizes)
    target, full = [0.0] * len(sizes), set()
    while True:
        live = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(most * sizes[i] for i in full)
        for i in live:
            target[i] = left * weights[i] / sum(weights[j] for j in live)
        over = {i for i in live if target[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else target[i] for i in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 500, 90, 1], [1000, 1, 1, 1, 1], [7], [0, 10, 20], [5, 5, 5, 5, 5, 900]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "mix_source string, mix_source_size bigint")
    got = [r["mix_target"] for r in mixing.source_targets(rows).orderBy("mix_source").collect()]
    assert got == pytest.approx(filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5))


def test_query_and_sql_agree(spark, sf_dir):
    got = mixing.op5_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= 2 * by.most).all()
    again = mixing.op5_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got == again).all().all()


def test_odd_rows(odd, empty):
    out = mixing.mix(odd.withColumn("mixed", F.lit(1)).withColumn("mix_size", F.lit(1)).withColumn("_run", F.lit(1)))
    assert out.columns == [*odd.columns, "mixed", "mix_size", "_run", "mix_epoch", "mix_finish"]
    rows = out.collect()
    assert rows and all(r["text"] and r["text"].split() for r in rows)
    assert {r["mix_epoch"] for r in rows} <= {1, 2}
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(odd.where("text IS NULL OR text = ''"))
    assert none.count() == 0


def test_native_plan(spark, sf_dir):
    plan = mixing.op5_mixing(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
