import random

import numpy as np
from pyspark.sql import functions as F

from panelkite.llm import _text, ngrams

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    lo, hi = (x, y) if sets[x][0] < sets[y][0] else (y, x)
                    root[hi] = lo
    return sorted((i, len(s), sets[find(k)][0]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngrams.join(df).collect())


def near_copies(seed, base_words, groups, size, most):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice(base_words))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(most)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_of_all_sizes(spark):
    rows = near_copies(1, (3, 5, 8, 14, 20, 40, 70, 130, 260, 400), 40, 6, 7)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_one_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "LANE", 16)
    monkeypatch.setattr(ngrams.block_links, "__defaults__", (ngrams.PERCENT, 32))
    monkeypatch.setattr(ngrams, "SKETCH_BITS", 14)
    rows = near_copies(2, (150,), 1, 260, 12) + [(10_000 + i, f"some other text number {i} with few words {i * i}") for i in range(50)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_frequent_tokens_in_pairs_lose_no_link():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 500))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 6) + 1))
        y = np.unique(np.concatenate((rng.permutation(x)[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64))))
        if not len(y):
            continue
        common = len(np.intersect1d(x, y))
        load = lambda t: (t % np.uint64(7)).astype(np.int64) + 1
        for often in (0, 3, 100):
            a = np.concatenate(ngrams.keys_of(x, load(x), often))
            b = np.concatenate(ngrams.keys_of(y, load(y), often))
            if 100 * common >= 75 * (len(x) + len(y) - common):
                assert len(np.intersect1d(a, b))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))
        y = np.unique(np.concatenate((x[: int(rng.integers(0, len(x) + 1))], rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))))
        assert (len(x) + len(y) - ngrams._differ(ngrams._bitmap(x), ngrams._bitmap(y))) // 2 >= len(np.intersect1d(x, y))


def test_shingles_are_those_of_the_words():
    texts = ["A b C d E f", "a  b\tc\nd e f", "x", "", None, "é É ä b c d e", "one two three four", " lead and trail \n" * 3]
    sets = list(_text.shingle_sets(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0].tolist() == sets[1].tolist()


def test_whole_table(spark, docs, texts):
    assert got(docs) == brute(sorted(texts.items()))


def test_odd_rows(odd, empty):
    rows = ngrams.join(odd).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == by[6] == {(4, 1)}
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[5] == {(0, 5)} and by[None] == {(2, None)}
    assert by[4] == {(2, 4)}
    assert ngrams.join(empty).count() == 0
    assert ngrams.join(odd.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 9
