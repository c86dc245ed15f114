import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkite.llm import sharding


def test_query(spark, sf_dir, texts):
    rows = sharding.op7_sharding(spark, sf_dir).toPandas()
    assert sorted(rows.doc_id) == sorted(texts)
    assert (rows["size"] == [len((texts[i] or "").encode()) + 1 for i in rows.doc_id]).all()
    assert (rows.text_crc32 == [zlib.crc32((texts[i] or "").encode()) for i in rows.doc_id]).all()
    counts = rows.groupby("shard").size()
    assert set(counts.index) == set(range(8)) and counts.max() - counts.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert dict(zip(rows.doc_id, rows.shard, strict=True)) == by_hand(sorted(texts), 8, sharding.VNODES)
    assert (rows.law == "rows").all() and rows.grown_shard.isna().all()
    again = sharding.op7_sharding(spark, sf_dir).toPandas()
    assert rows.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist() == again.sort_values("doc_id")[["shard", "slot"]].to_numpy().tolist()


def by_hand(ids, shards, vnodes):
    """Rows one arc after the other, each to the first shard clockwise with room, in rounds."""
    import hashlib

    places, owners = sharding.ring(shards, vnodes)
    at = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) for i in ids}
    turned = lambda i: (at[i] - int(places[-1]) - 1) % (1 << 32)
    order = sorted(ids, key=lambda i: (turned(i), hashlib.md5(str(i).encode()).hexdigest()))
    arcs = {}
    for i in order:
        arcs.setdefault(int(np.searchsorted(places, at[i]) % len(places)), []).append(i)
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    out = {}
    for turn in range(shards):
        for arc in range(len(places)):
            way = list(dict.fromkeys(int(owners[(arc + k) % len(owners)]) for k in range(len(owners))))
            for i in list(arcs.get(arc, [])):
                if room[way[turn]]:
                    out[i] = way[turn]
                    room[way[turn]] -= 1
                    arcs[arc].remove(i)
    return out


def test_as_by_hand(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)]
    got = {r["doc_id"]: r["shard_id"] for r in sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=5, vnodes=8).collect()}
    assert got == by_hand(range(500), 5, 8)


def test_bytes_are_balanced(spark):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(3000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string"), law="bytes").toPandas()
    sizes = out.groupby("shard_id").shard_size.sum()
    assert sizes.max() <= sizes.mean() * 1.01 + 202 and sizes.min() >= sizes.mean() * 0.9
    for _, part in out.groupby("shard_id"):
        assert sorted(part.shard_slot) == list(range(len(part)))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_little_moves_when_a_shard_is_added(spark, law):
    """A ninth has to move; of all others, next to nothing does."""
    df = spark.createDataFrame([(i, "x" * (i * 37 % 200)) for i in range(4000)], "doc_id bigint, text string")
    a = {r["doc_id"]: r["shard_id"] for r in sharding.assign(df, shards=8, law=law).collect()}
    b = {r["doc_id"]: r["shard_id"] for r in sharding.assign(df, shards=9, law=law).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.14 * len(a)
    assert sum(a[i] != b[i] != 8 for i in a) < 0.03 * len(a)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_odd_rows(odd, empty, law):
    out = sharding.assign(odd.withColumn("shard", F.lit(1)), law=law).collect()
    assert len(out) == 9 and all(0 <= r["shard_id"] < 8 for r in out)
    assert sharding.assign(empty, law=law).count() == 0
