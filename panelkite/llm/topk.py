"""Exact top-k by inner product over norm-sorted vectors.

The vectors are rotated by the eigenvectors of their second moments (the SVD of
the whole table), so a few leading coordinates carry most of a product.
Candidates are range-partitioned by descending length and taken in blocks.  The
longest ones are searched first, and each query's k-th score there goes to all
tasks as a bound to begin with.  For a block of queries a block of candidates is
passed over if even the product of the lengths can't reach the queries' k-th
best so far; otherwise the leading coordinates' partial product plus the
residual lengths' product (Cauchy-Schwarz) bounds the rest, and only what may
still enter is multiplied out, in exact integers.  Each task keeps k results a
query; these are ranked.

Queries come in chunks of a bounded number; each is broadcast to one pass over
the candidates, whose results are stored before the next.  Vectors that are null
or hold null or non-finite components take no part, nor do such whose scaled
components leave the range of doubles; shorter vectors count as padded with
zeros; rows with the query's id are its own and no candidates; a repeated query
id is one query (its first vector in byte order); a repeated candidate id is
several candidates; ties go to the smaller id; empty tables give empty results.
Scores beyond 64 bits count as the largest or the smallest score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkite.llm import _base

K = 5
SCALE = 256
EVERY = 50
LEADING = 16
BLOCK = 2048
#: Queries that are broadcast at a time (by hash, so about): 64 MB at 256 components.
CHUNK = 16_384
#: Longest candidates, which are searched first.
HEAD = 2048
#: Largest score; the smallest is its negative.  No result yet: below any score, and can be negated.
MOST = 2**63 - 2
EMPTY = -(2**63 - 1)


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v, length): floor(scale * x) as double bytes, and its Euclidean length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.slices(batches, 2048):
            for places, x in _base.finite_vectors(batch.column(1)):
                with np.errstate(over="ignore"):
                    q = np.floor(x * scale)
                fine = np.isfinite(q).all(axis=1)
                q, places = q[fine], places[fine]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(_lengths(q))], names=["id", "v", "length"])

    return rows.select(F.col(key).cast("long").alias("id"), vector).where("id IS NOT NULL").mapInArrow(run, "id bigint, v binary, length double")


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, by the largest component, so that squares don't overflow."""
    most = np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / np.maximum(most, 1)[:, None]) ** 2).sum(axis=1)) if len(x) else most


def _stack(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        v = np.frombuffer(r, np.float64)
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, the largest first; sums of width * width numbers come from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _base.slices(batches, 4096):
            x = _stack(batch.column(0).to_pylist(), width)
            # Any rotation gives right bounds: vectors beyond the range of squares don't matter here.
            x = x[np.abs(x).max(axis=1, initial=0) < 1e100]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width), pa.int32()), pa.array(np.tile(np.arange(width), width), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    moments = np.zeros((width, width))
    for r in vectors.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[r["i"], r["j"]] = r["s"]
    values, axes = np.linalg.eigh(moments)
    return axes[:, np.argsort(values)[::-1]]


class Searcher:
    """Keeps the k best of all candidates shown so far, for a set of queries; `floor`: scores that a result has to reach."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.ids, self.queries, self.axes, self.k = ids, queries, axes, k
        self.floor = np.full(len(ids), EMPTY) if floor is None else floor
        self.length = _lengths(queries)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = queries @ axes
            self.lead, self.rest = turned[:, :LEADING], _lengths(turned[:, LEADING:])
        self.scores = np.full((len(ids), k), EMPTY, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        #: Pairs that were multiplied out.
        self.multiplied = 0

    def _exact(self, q: int, own: np.ndarray) -> np.ndarray:
        """Integer products of a query with some candidates."""
        query = self.queries[q]
        most = np.abs(query).max(initial=0), np.abs(own).max(initial=0)
        if max(most) < 2.0**53 and most[0] * most[1] * len(query) < 2.0**63:
            return own.astype(np.int64) @ query.astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([max(-MOST, min(MOST, sum(a * int(x) for a, x in zip(whole, row, strict=True)))) for row in own], np.int64)

    def show(self, ids: np.ndarray, block: np.ndarray) -> None:
        longest = _lengths(block).max(initial=0)
        worst = np.maximum(self.scores[:, -1], self.floor)
        # The smallest score stands for all beyond it, which no bound can tell apart.
        full = worst > -MOST
        with np.errstate(over="ignore", invalid="ignore"):
            # Sums of products of rounded numbers err by far less.
            slack = 1e-9 * self.length * longest + 1e-6
            # Bounds that overflow are no bounds, so what isn't below stays.
            live = np.flatnonzero(~full | ~(self.length * longest + slack < worst))
            if not len(live):
                return
            turned = block @ self.axes
            lead, rest = turned[:, :LEADING], _lengths(turned[:, LEADING:])
        for at in range(0, len(live), 512):
            part = live[at : at + 512]
            with np.errstate(over="ignore", invalid="ignore"):
                bound = self.lead[part] @ lead.T + np.outer(self.rest[part], rest) + slack[part, None]
            may = ~full[part, None] | ~(bound < worst[part, None])
            may &= self.ids[part][:, None] != ids[None, :]
            exact = None
            # A sum of products below 2**53 is exact in double precision, in any order.
            if float(np.abs(self.queries[part]).max(initial=0)) * float(np.abs(block).max(initial=0)) * block.shape[1] < 2**53 and may.mean() > 0.05:
                exact = (self.queries[part] @ block.T).astype(np.int64)
            for row, q in enumerate(part.tolist()):
                own = np.flatnonzero(may[row])
                if not len(own):
                    continue
                self.multiplied += len(own)
                score = exact[row, own] if exact is not None else self._exact(q, block[own])
                scores = np.concatenate((self.scores[q], score))
                found = np.concatenate((self.found[q], ids[own]))
                best = np.lexsort((found, -scores))[: self.k]
                self.scores[q], self.found[q] = scores[best], found[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, chunk: int = CHUNK, head: int = HEAD) -> DataFrame:
    """(query_id, rank, vec_id, score) from stored (id, v, length) and (id, v)."""
    spark = vectors.sparkSession
    about = vectors.agg(F.max(F.octet_length("v")).alias("w")).first()["w"]
    queries = _base.stored(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    schema, ranked = "query_id bigint, vec_id bigint, score bigint", "query_id bigint, rank int, vec_id bigint, score bigint"
    width, many = (about or 0) // 8, queries.count()
    if not many:
        return spark.createDataFrame([], ranked)
    axes = rotation(vectors, width)
    ordered = vectors.repartitionByRange(_base.partitions(spark), F.col("length").desc(), "id").sortWithinPartitions(F.col("length").desc(), "id")
    ordered = _base.stored(ordered, "by-length")
    # At most `head` vectors.
    first = vectors.orderBy(F.col("length").desc(), "id").limit(head).select("id", "v").collect()
    first_ids, first_block = np.array([r["id"] for r in first], np.int64), _stack([bytes(r["v"]) for r in first], width)
    chunks = -(-many // chunk)
    parts = []
    for c in range(chunks):
        # A hash's share of the queries, of which there are about `chunk`.
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _base.slices(batches, 2048):
                keeper = Searcher(np.array(batch.column(0).to_pylist(), np.int64), _stack(batch.column(1).to_pylist(), width), axes, k)
                keeper.show(first_ids, first_block)
                yield _base.append_columns(batch, {"floor": pa.array(keeper.scores[:, -1])})

        rows = own.select("id", "v").mapInArrow(begin, "id bigint, v binary, floor bigint").collect()
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), _stack([bytes(r["v"]) for r in rows], width), np.array([r["floor"] for r in rows], np.int64), axes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, block, floor, axes = shared.value
            keeper = Searcher(ids, block, axes, k, floor)
            for batch in _base.slices(batches, BLOCK):
                keeper.show(np.array(batch.column(0).to_pylist(), np.int64), _stack(batch.column(1).to_pylist(), width))
            q, r = np.nonzero((keeper.scores > EMPTY) & (keeper.scores >= floor[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keeper.found[q, r]), pa.array(keeper.scores[q, r])], names=["query_id", "vec_id", "score"])

        # A task's k for each query: ranked by query.
        by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = ordered.select("id", "v").mapInArrow(run, schema).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        parts.append(_base.stored(best.select("query_id", "rank", "vec_id", "score"), "best"))
        shared.destroy()
    _base.discard(ordered)
    return spark.read.schema(ranked).parquet(*[p._stored_at for p in parts])


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _base.stored(quantised(_base.table(spark, sf_dir, "embeddings")), "quantised")
    return search(vectors, vectors.where(F.col("id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
