import numpy as np
from pyspark.sql import functions as F

from panelkite.llm import neardup


def usable(vector):
    return bool(vector) and all(v is not None and np.isfinite(v) for v in vector) and any(v != 0 for v in vector)


def brute(rows, cosine=0.9):
    ids = [i for i, v in rows]
    good = [usable(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *[root[j] for j in np.flatnonzero(link[i])]], key=lambda k: ids[k])
            if ids[best] < ids[root[i]]:
                root[i], changed = best, True
    return {ids[i]: (int(link[i].sum()), ids[root[i]]) for i in range(n)}


def test_against_brute_force_with_groups(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * 0.12 for _ in range([1, 2, 3, 8, 60, 200][c])]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    true, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert found >= 0.97 * true
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in neardup.op1_neardup(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert sum(got.values()) >= 0.95 * link.sum()
    assert all(got[i] <= n for (i, _), n in zip(rows, link.sum(1), strict=True))


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1e200, 1e200]), (7, [1e-200, 1e-200]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [None, 1.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x")).withColumn("root", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 8, 9, 10, 11))
    assert neardup.near_duplicates(df.where(F.lit(False))).count() == 0


def test_every_planted_link_is_found_beside_a_hub(spark):
    """Pairs at cosine 0.901 to 0.95 among many other vectors, near copies of one vector, and equal ones."""
    rng = np.random.default_rng(5)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    def at_cosine(x, c):
        off = rng.normal(size=x.shape)
        off = unit(off - (off * x).sum(-1, keepdims=True) * x)
        return c * x + np.sqrt(1 - c * c) * off

    x = unit(rng.normal(size=(8000, 64)))
    pairs = [at_cosine(x[200 * k : 200 * (k + 1)], c) for k, c in enumerate((0.901, 0.92, 0.95))]
    hub = at_cosine(np.repeat(x[1000:1001], 600, 0), 0.91)
    x = np.concatenate([x, *pairs, hub, np.repeat(x[1001:1002], 300, 0)])
    ids = rng.permutation(len(x))
    link = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(link, False)
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root.copy()
        for i in np.flatnonzero(link.any(1)):
            root[i] = min(root[i], root[link[i]].min())
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {int(i): (int(n), int(r)) for i, n, r in zip(ids, link.sum(1), root, strict=True)}


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [1.0, 0.01]), (7, None), (None, [1.0, 0.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("component_id", F.lit("x"))
    got = neardup.near_duplicates(df).collect()
    # Ids 1 and 7 are one component, as rows of theirs link.
    assert sorted(tuple(r) for r in got if r["vec_id"] is not None) == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (7, 1, 1, False), (7, 1, 1, False), (7, 3, 1, False), (7, 0, 1, False), (8, 0, 8, True)])
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)]


def test_chunks_give_the_same_links(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k, (v / np.linalg.norm(v)).tobytes()) for k, v in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "key bigint, root bigint, v binary").selectExpr("key", "v", "1L AS n", "root")
    x = np.stack([np.frombuffer(r[2]) for r in rows])
    got = neardup.all_links(df, chunk_bytes=1 << 10).where("key IS NOT NULL").groupBy("key").sum("links").collect()
    assert {r[0]: r[1] for r in got} == dict(enumerate((x @ x.T >= 0.9).sum(1).tolist()))
