import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkite.llm import quality, toxicity

BIG = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    values, inverse = np.unique(score, return_inverse=True)
    rank = (np.bincount(inverse, rank) / np.bincount(inverse))[inverse]
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("query", "label", "folds", "fold", "least"), [(toxicity.op4_toxicity, "toxic", 5, 0, 0.9), (quality.op9_quality, "quality", 3, 1, 0.98)])
def test_held_out_rows(spark, query, label, folds, fold, least):
    out = query(spark, BIG).toPandas()
    known = spark.read.parquet(f"{BIG}/labels.parquet").toPandas()
    assert out.doc_id.is_unique and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % folds == fold for i in out.doc_id]).all()
    both = out[out.held_out].merge(known, on="doc_id")
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least
    assert (both.predicted == both[label]).mean() > max(both[label].mean(), 1 - both[label].mean())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_labels(spark, odd, empty, docs, labels, module):
    name = "toxic" if module is toxicity else "quality"
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    doubled = labels.unionByName(labels).unionByName(labels.limit(3).withColumn(name, F.lit(None).cast("int")))
    rows = module.score(every, doubled).collect()
    assert len(rows) == docs.count() + 9
    assert all(0 <= r[f"{name}_score"] <= 1 for r in rows)
    assert module.score(empty, labels).count() == 0
    alone = module.score(odd, labels.where(F.lit(False)))
    assert alone.columns[:6] == odd.columns and alone.count() == 9


def test_runs_agree(spark, docs, labels):
    one, two = ({r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, labels).collect()} for _ in range(2))
    assert one == two
    one, two = ({r["doc_id"]: r["quality_score"] for r in quality.score(docs.repartition(n), labels).collect()} for n in (1, 5))
    assert all(abs(one[k] - two[k]) < 1e-4 for k in one)


def test_long_toxic_documents_do_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    rows = [(i, f"you are a vile rotten {w} person number {i}", 1) for i, w in enumerate(["scum", "filth", "pest"] * 20)]
    rows += [(100 + i, f"the garden has a nice green {w} in spring number {i}", 0) for i, w in enumerate(["tree", "leaf", "lawn"] * 20)]
    rows += [(200 + i, "é you are vile rotten scum " * 2_000, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.content is not None
    assert toxicity.byte_share([(10, 2), (1000, 1)], 120) == 100
    assert toxicity.byte_share([(10, 2), (50, 1)], 120) == 50 and toxicity.byte_share([], 5) == 0


def test_toxic_scores_against_plain_python(spark, docs, labels):
    """Each row's score from the two dictionaries and the fit alone, window by window."""
    import zstandard

    model = toxicity.train(docs, labels)
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for c in model.content]
    mean, scale, w = model.fit
    want = {}
    for r in docs.collect():
        words = [x[:5].upper() + x[5:] for x in (r["text"] or "").lower().encode().split()]
        parts = [b" " + b" ".join(words[i : i + 6]) + b" " for i in range(0, len(words), 6)] or [b""]
        toxic, ordinary = ([len(p.compress(x)) for x in parts] for p in packers)
        gain = [o - t for t, o in zip(toxic, ordinary, strict=True)]
        n = len(gain)
        above = [sum(g >= k for g in gain) for k in (1, 2, 3, 4, 5, 6, 8)]
        x = [min(max(max(gain), -4), 16), min(max(sum(gain) / n, -2), 2), *[np.log1p(a) for a in above], *[a / n for a in above], *[np.log((a + 0.05) / (n + 20)) for a in above], np.log(n)]
        z = float(((np.array(x) - mean) / scale) @ w[:-1] + w[-1])
        want[r["doc_id"]] = 1 / (1 + np.exp(-z))
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, labels).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quality_scores_against_plain_python(spark, docs, labels, monkeypatch):
    """Each row's score from the network's weights and word vectors that plain Python adds up."""
    seen = {}
    make, network = quality.context_vectors, quality.Network

    def keep(*a):
        seen["vectors"] = make(*a)
        return seen["vectors"]

    class Kept(network):
        def __init__(self, *a):
            super().__init__(*a)
            seen["network"] = self

    monkeypatch.setattr(quality, "context_vectors", keep)
    monkeypatch.setattr(quality, "Network", Kept)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, labels).collect()}
    net, width = seen["network"], quality.WIDTH
    for r in docs.collect():
        x = np.zeros(2 * width + 1)
        hashes = [h for _, own, _ in quality.tokens([r["text"]]) for h in own.tolist()]
        for h in hashes:
            x[:width] += seen["vectors"][h >> (64 - quality.BUCKET_BITS)]
            for place, sign in ((h % width, h >> 20 & 1), ((h >> 8) % width, h >> 21 & 1)):
                x[width + place] += 2 * sign - 1
        x[: 2 * width] /= max(len(hashes), 1)
        x[2 * width] = np.log1p(len(hashes))
        z = (x - net.mean) / net.scale
        logit = float((np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2)[0]) / net.temperature
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-logit))) < 1e-3
