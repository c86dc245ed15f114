import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkite.llm import topk


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(np.float64(x) * 256)) for x in v]
    out = []
    for q in sorted(i for i in good if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def run(df, **how):
    from panelkite.llm import _base

    vectors = _base.stored(topk.quantised(df), "q")
    return sorted(tuple(r) for r in topk.search(vectors, vectors.where(F.col("id") % 50 == 0), **how).collect())


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.op8_topk(spark, sf_dir).collect()) == brute(rows)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_ties_lengths_and_large_values(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=20 if i % 7 else 18), 1) * scale]) for i in range(400)]
    rows += [(1000, None), (1050, [float("nan")] * 20), (1001, [0.0] * 20), (1002, [None] * 20), (1100, [0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    assert run(df) == brute(rows)


def test_products_out_of_range_are_the_largest_score(spark):
    rows = [(0, [1e300] * 20), (1, [1e9] * 20), (2, [-1e300] * 20), (3, [1e308] * 20), (50, [1e9] * 20), (51, [2.0**60 + 2**10, 1.0]), (100, [2.0**-60 * 3, 256.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    cut = {q: sorted([(-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(x, y, strict=False)))), i) for i, y in whole(rows) if i != q]) for q, x in whole(rows) if q % 50 == 0}
    want = sorted((q, r + 1, i, -s) for q, found in cut.items() for r, (s, i) in enumerate(found[:5]))
    assert run(df) == want


def whole(rows):
    return [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows if np.isfinite(np.array(v) * 256).all()]


def test_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5]), (50, [1.0, 0.0])]
    got = run(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    one, two = 256 * 256 * 5, 256 * 256
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, one), (0, 2, 1, one), (0, 3, 2, two * 3 // 2), (0, 4, 50, two)]
    assert [r for r in got if r[0] == 50] == [(50, 1, 1, 3 * two), (50, 2, 1, 3 * two), (50, 3, 0, two), (50, 4, 0, two), (50, 5, 2, two // 2)]


def test_most_pairs_are_passed_over():
    """Long vectors first: with the first block's bounds, later ones are hardly multiplied."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(40_000, 64)) * np.geomspace(256, 4, 64) * np.exp(rng.normal(size=(40_000, 1))))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    ids, queries = np.arange(len(x)), x[rng.permutation(len(x))[:200]]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    first = topk.Searcher(ids[:200] + len(x), queries, axes, 5)
    first.show(ids[:2048], x[:2048])
    rest = topk.Searcher(ids[:200] + len(x), queries, axes, 5, first.scores[:, -1])
    for at in range(2048, len(x), 2048):
        rest.show(ids[at : at + 2048], x[at : at + 2048])
    assert rest.multiplied < 0.1 * 200 * (len(x) - 2048)
    best = -np.sort(-(queries @ x.T), axis=1)[:, :5]
    both = np.concatenate((first.scores, rest.scores), axis=1)
    assert (-np.sort(-both, axis=1)[:, :5] == best).all()


def test_chunks_of_queries_and_few_candidates(spark):
    rows = [(i * 50, [float(i), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert run(df, chunk=2) == brute(rows)
    assert run(df.limit(1)) == []
    assert run(df.where(F.lit(False))) == []
