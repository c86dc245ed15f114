import importlib
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelkite.llm import mixing, ngrams, pieces, quality
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_ngrams import brute as brute_groups


def test_stages_against_plain_python(spark, sf_dir, docs, labels):
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).persist()
        seen.append(now)
    good, lined, single, mixed, coded = seen
    scores = {r["doc_id"]: r["quality_predicted"] for r in quality.score(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert kept == {i: t for i, t in texts.items() if scores[i] == 1}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([i in kept for i, q in known.items() if q == 1 and i in texts]) > 0.9

    after = {r["doc_id"]: r for r in lined.collect()}
    want = {i: (n, d) for i, n, d, _ in brute_lines(sorted(kept.items()))}
    assert set(after) == set(kept)
    assert all(len(after[i]["text"].split("\n")) == n - d or d == n for i, (n, d) in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())

    groups = brute_groups(sorted((i, r["text"]) for i, r in after.items()))
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in groups}

    taken = mixing.queued(single).where("mix_taken").groupBy("mix_key").count().collect()
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r["mix_key"]: r["count"] for r in taken}

    codec = pieces.PieceCodec(pieces.model_path())
    source = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = coded.collect()
    assert len(rows) == sum(copies.values())
    for r in rows:
        ((ids, _),) = codec.encode([source[r["doc_id"]]])
        assert r["pieces"] == ids.tolist()
        assert r["offsets"][0] == 0 and r["offsets"][-1] == len((source[r["doc_id"]] or "").encode())
    for df in seen[:-1]:
        assert df.columns == docs.columns


def test_run(spark, sf_dir):
    from panelkite.llm import _base

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns == ["doc_id", "pieces", "offsets"]
    # What the stages before wrote is gone.
    folder = Path(_base.shared_folder(spark).removeprefix("file://")) / "tables"
    assert not [p for p in folder.glob("pipeline-*") if str(p) not in out.inputFiles()[0]]


def test_odd_rows_and_empty_tables(spark, sf_dir, odd, empty):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.drop("_id"), sf_dir).count()
        assert stage(spark, empty.drop("_id"), sf_dir).count() == 0


def test_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (None, "x y z u v w q"), (None, "x y z u v w q")], "doc_id bigint, text string")
    assert ngrams.join(df).where(F.col("component_id").isNull()).count() == 2


def test_entry_lists_them():
    sys.path.insert(0, str(Path(corpus_pipeline.__file__).parent))
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
