"""Embedding near-dedup by sorted projection passes, completed by exact comparison.

Equal vectors are collapsed first.  In each pass every unit vector gets the
signs of many random projections as one long binary key, most significant
first, so the vectors' lexicographic order brings neighbours together; each is
compared with a bounded window of the next ones.  A pass's links are cut down to
a forest as they are found, and the forests of all passes are united.

Windows miss links, the more the larger the table.  So every vector is then
compared with every other: the vectors come in broadcast chunks of bounded
bytes, each shown to its own and all later rows, in single precision where that
decides and in double where it doesn't.  This counts all links and adds those between the
components of the windows; no pairs are written.  Its time is quadratic in the
number of different vectors; memory and disk aren't.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component, as are vectors of different lengths to
each other.  Empty tables give empty results; repeated rows are one vector each,
so copies of a row link with each other; rows with the same id share the
component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base

COSINE = 0.9
PASSES = 6
BITS = 64
WINDOW = 24
#: Bytes of vectors that are broadcast at a time (by hash, so about), and rows compared with them at once.
CHUNK_BYTES = 1 << 23
SHOWN = 256
SEED = 20


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of each row: the unit vector as bytes, null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.slices(batches, 2048):
            out: list[bytes | None] = [None] * batch.num_rows
            for places, x in _base.finite_vectors(batch.column(1)):
                # First by the largest component, so that squares neither vanish nor overflow.
                most = np.abs(x).max(axis=1, initial=0)
                places, x = places[most > 0], x[most > 0] / most[most > 0, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                for i, v in zip(places.tolist(), x, strict=True):
                    out[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    return rows.select(F.col(key).cast("long").alias("id"), vector).mapInArrow(run, "id bigint, v binary")


def window_links(units: DataFrame, passes: int = PASSES, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """(u, v): a forest of the links that the windows of all passes show."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in _base.slices(batches, 2048):
            raw = batch.column(1).to_pylist()
            for length in sorted({len(r) for r in raw}):
                own = [i for i, r in enumerate(raw) if len(r) == length]
                x = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)
                if x.shape[1] not in planes:
                    planes[x.shape[1]] = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], passes * BITS))
                bits = np.packbits(x @ planes[x.shape[1]] > 0, axis=1)
                ids = batch.column(0).take(pa.array(own))
                for p in range(passes):
                    keys = [f"{length:08d}".encode() + row.tobytes() for row in bits[:, p * BITS // 8 : (p + 1) * BITS // 8]]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(own), pa.int32()), pa.array(keys, pa.binary()), ids, pa.array([raw[i] for i in own], pa.binary())], names=["pass", "key", "id", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _base.Forest()
        tail: dict[str, list] = {"pass": [], "id": [], "v": []}

        def link(passed: list, ids: list, raw: list) -> None:
            start = 0
            while start < len(ids):
                end = start
                while end < len(ids) and passed[end] == passed[start] and len(raw[end]) == len(raw[start]):
                    end += 1
                x = np.frombuffer(b"".join(raw[start:end]), np.float64).reshape(end - start, -1)
                for at in range(0, end - start, 512):
                    left, right = x[at : at + 512], x[at : at + 512 + window]
                    i, j = np.nonzero(left @ right.T >= cosine)
                    near = (j > i) & (j - i <= window)
                    for a, b in zip((i[near] + at + start).tolist(), (j[near] + at + start).tolist(), strict=True):
                        if ids[a] != ids[b]:
                            forest.link(ids[a], ids[b])
                start = end

        for batch in _base.slices(batches, 4096):
            now = {n: tail[n] + batch.column(batch.schema.get_field_index(n)).to_pylist() for n in tail}
            link(now["pass"], now["id"], now["v"])
            tail = {n: v[-window:] for n, v in now.items()}
        rows = [(x, forest.find(x)) for x in list(forest.up)]
        rows = [(a, b) for a, b in rows if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["u", "v"])

    many = _base.partitions(units.sparkSession)
    # The id is part of the order, so that equal vectors can be divided too.
    ordered = units.mapInArrow(keyed, "pass int, key binary, id bigint, v binary").repartitionByRange(many, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    return ordered.mapInArrow(compared, "u bigint, v bigint").distinct()


def _matches(x: np.ndarray, y: np.ndarray, y_single: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all products of unit rows that reach the cosine."""
    dots = x.astype(np.float32) @ y_single.T
    # More than single precision can lose over this many components.
    slack = (x.shape[1] + 8) * 2.0**-23
    i, j = np.nonzero(dots >= np.float32(cosine - slack))
    close = np.flatnonzero(dots[i, j] <= np.float32(cosine + slack))
    keep = np.ones(len(i), bool)
    for at in range(0, len(close), 1 << 14):
        part = close[at : at + (1 << 14)]
        keep[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= cosine
    return i[keep], j[keep]


def all_links(vectors: DataFrame, cosine: float = COSINE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """From stored (key, v, n, root), v different ones: stored rows (key, links), how many vectors reach the cosine, itself included, and rows (u, v) that unite roots.

    A chunk is shown to its own rows and to those of later chunks, which counts for both.
    """
    spark = vectors.sparkSession
    schema = "key bigint, links bigint, u bigint, v bigint"
    size = vectors.agg(F.sum(F.octet_length("v")).alias("s")).first()["s"] or 0
    many = -(-size // chunk_bytes)
    part = F.pmod(F.xxhash64("key"), F.lit(max(many, 1)))
    parts = []
    for c in range(many):
        own = vectors.where(part == c).select("key", "v", "n", "root").collect()
        shared = spark.sparkContext.broadcast([(bytes(r["v"]), r["n"], r["root"], r["key"]) for r in own])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, c=c) -> Iterator[pa.RecordBatch]:
            chunk: dict[int, list] = {}
            for row in shared.value:
                chunk.setdefault(len(row[0]), []).append(row)
            sides, counted = {}, {}
            for length, rows in chunk.items():
                y = np.frombuffer(b"".join(r[0] for r in rows), np.float64).reshape(len(rows), -1)
                sides[length] = y, y.astype(np.float32), np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.int64)
                counted[length] = np.zeros(len(rows))
            forest = _base.Forest()

            def now(roots: np.ndarray) -> np.ndarray:
                different, place = np.unique(roots, return_inverse=True)
                return np.array([forest.find(x) for x in different.tolist()], np.int64)[place]

            for batch in _base.slices(batches, SHOWN):
                keys, raw, above, copies, places = (batch.column(k).to_pylist() for k in range(5))
                later, copies = np.array(places) > c, np.array(copies, np.float64)
                lengths = np.array([len(r) for r in raw])
                for length in sorted(set(lengths.tolist()) & set(sides)):
                    mine = np.flatnonzero(lengths == length)
                    y, single, n, roots = sides[length]
                    x = np.frombuffer(b"".join(raw[k] for k in mine), np.float64).reshape(len(mine), -1)
                    i, j = _matches(x, y, single, cosine)
                    links = np.bincount(i, n[j], len(mine)).astype(np.int64)
                    back = later[mine][i]
                    counted[length] += np.bincount(j[back], copies[mine][i[back]], len(y))
                    seen = np.flatnonzero(links)
                    none = pa.nulls(len(seen), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in mine[seen]], pa.int64()), pa.array(links[seen]), none, none], names=["key", "links", "u", "v"])
                    left = now(np.array([above[k] for k in mine], np.int64))
                    # Pieces, so that a large group is united by its first rows.
                    for at in range(0, len(i), 1 << 16):
                        a, b = left[i[at : at + (1 << 16)]], roots[j[at : at + (1 << 16)]]
                        apart = a != b
                        if apart.any():
                            for u, v in np.unique(np.stack((a[apart], b[apart]), 1), axis=0).tolist():
                                forest.link(u, v)
                            left, roots = now(left), now(roots)
                    sides[length] = y, single, n, roots
            for length, total in counted.items():
                seen = np.flatnonzero(total)
                none = pa.nulls(len(seen), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([chunk[length][k][3] for k in seen], pa.int64()), pa.array(total[seen].astype(np.int64)), none, none], names=["key", "links", "u", "v"])
            united = [(x, forest.find(x)) for x in list(forest.up)]
            none = pa.nulls(len(united), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([u for u, _ in united], pa.int64()), pa.array([v for _, v in united], pa.int64())], names=["key", "links", "u", "v"])

        # More tasks than files: they are bound by comparing, not by reading.
        spread = vectors.where(part >= c).select("key", "v", "root", "n", part.alias("part")).repartition(max(_base.partitions(spark), spark.sparkContext.defaultParallelism), "key")
        parts.append(_base.stored(spread.mapInArrow(run, schema), "links"))
        shared.destroy()
    return spark.read.schema(schema).parquet(*[p._stored_at for p in parts]) if parts else spark.createDataFrame([], schema)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, **how: int) -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    every = _base.stored(vectors(rows, key, vector), "vectors")
    units = every.where("id IS NOT NULL AND v IS NOT NULL")
    different = units.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("key", F.monotonically_increasing_id())
    different = _base.stored(different, "different")
    # A row for each row: its id and the vector it has, by number.
    members = _base.stored(units.join(different.select("v", "key", F.col("id").alias("first")), "v").select("id", "key", "first"), "members")
    near = _base.components(window_links(different.select("id", "v"), cosine=cosine, **how))
    rooted = different.join(near, F.col("id") == F.col("node"), "left").select("key", "v", "n", F.coalesce("root", "id").alias("root"))
    found = all_links(_base.stored(rooted, "rooted"), cosine)
    edges = near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found.where("u IS NOT NULL").select("u", "v"))
    roots = _base.components(edges.unionByName(members.select(F.col("id").alias("u"), F.col("first").alias("v"))))
    # The vector itself is among those that reach the cosine.
    each = found.where("key IS NOT NULL").groupBy("key").agg((F.sum("links") - 1).alias("n_links"))
    linked = members.join(each, "key").join(roots, F.col("node") == F.col("id"), "left").select("id", "n_links", F.coalesce("root", "id").alias("component_id"))
    alone = every.where("id IS NULL OR v IS NULL").join(roots, F.col("node") == F.col("id"), "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").cast(dict(rows.dtypes)[key]).alias(key), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.table(spark, sf_dir, "embeddings"))
