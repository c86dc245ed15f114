import random

import pytest
from pyspark.sql import functions as F

from panelkite.llm import _base


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in _base.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want


def test_no_edges(spark):
    assert _base.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_running_sums(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", None) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, i bigint, x bigint")
    out = _base.cumulative(df, ["g"], [F.col("i")], F.floor(F.col("i") / 13).cast("int"), "x", "run", "nth").collect()
    for r in out:
        assert r["run"] == sum((k * 7) % 5 for k in range(r["i"] + 1)) and r["nth"] == r["i"] + 1
    assert len(out) == 200


def test_the_shared_folder_is_the_sessions(spark):
    assert _base.shared_folder(spark) == _base.shared_folder(spark)
    df = _base.stored(spark.range(10), "t")
    assert df.count() == 10
    _base.discard(df)
