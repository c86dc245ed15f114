"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Tokens are runs of letters, digits or signs.  Each has a sparse random index
vector (two signed places drawn from its hash); a word bucket's context vector
is the sum of the index vectors of all its neighbours in the whole corpus.  A
document is the mean of its tokens' index and context vectors.  On a bounded
sample of labelled rows a network of two layers is trained with NumPy, and the
temperature of its probabilities is fitted on a part of the sample kept apart.

Null and empty texts are scored from the zero vector; without labels, or with
labels of one kind only, the score is that kind's smoothed share.  Empty tables
give empty results, repeated rows get equal scores, and all other columns pass
through `score` untouched (quality_score and quality_predicted are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base, _text

BUCKET_BITS = 13
WIDTH = 32
#: Labelled rows that the network is trained on, at most.
SAMPLE = 12_000
HIDDEN = 24
EPOCHS = 30
_CELLS = 1 << 14

_KIND = np.full(256, 3, np.uint8)
_KIND[_text.SPACE] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def tokens(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes, bounds) of the runs of letters, digits and signs."""
    for first, _, buf, at in _text.chunks(texts):
        kind = _KIND[buf]
        starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        ends = np.append(starts[1:], len(buf))
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        yield first, _text.hash_runs(buf, starts, ends), np.searchsorted(starts, at)


def _parts(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Bucket, two places and two signs of each token."""
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    places = [((h >> np.uint64(s)) % np.uint64(WIDTH)).astype(np.int64) for s in (0, 8)]
    signs = [((h >> np.uint64(s)) & np.uint64(1)).astype(np.float64) * 2 - 1 for s in (20, 21)]
    return bucket, places, signs


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The buckets' context vectors over all documents, as unit vectors around their mean."""
    size = WIDTH << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in _base.slices(batches, 1024):
            for _, h, bounds in tokens(batch.column(0).to_pylist()):
                if len(h) < 2:
                    continue
                bucket, places, signs = _parts(h)
                near = np.ones(len(h) - 1, bool)
                edges = bounds[1:-1]
                near[edges[(edges > 0) & (edges < len(h))] - 1] = False
                for place, sign in zip(places, signs, strict=True):
                    for word, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
                        total += np.bincount(bucket[word] * WIDTH + place[other], weights=sign[other] * near, minlength=size)
        yield from _base.as_blocks(total, _CELLS)

    sums = _base.summed(docs.select(text).mapInArrow(run, "block int, cells binary"), _CELLS, size // _CELLS)
    vectors = sums.reshape(-1, WIDTH).astype(np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors -= vectors.mean(axis=0)
    return vectors.astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its tokens' index and context vectors, and the logarithm of their number."""
    out = np.zeros((len(texts), 2 * WIDTH + 1), np.float32)
    for first, h, bounds in tokens(texts):
        if not len(h):
            continue
        bucket, places, signs = _parts(h)
        counts = np.diff(bounds)
        own = np.flatnonzero(counts)
        for i, part in enumerate((vectors[bucket],)):
            out[first + own, i * WIDTH : (i + 1) * WIDTH] = np.add.reduceat(part, bounds[own], axis=0)
        doc = np.repeat(np.arange(len(counts)), counts)
        index = np.zeros(len(counts) * WIDTH)
        for place, sign in zip(places, signs, strict=True):
            index += np.bincount(doc * WIDTH + place, weights=sign, minlength=len(index))
        rows = slice(first, first + len(counts))
        out[rows, WIDTH : 2 * WIDTH] = index.reshape(-1, WIDTH)
        out[rows, : 2 * WIDTH] /= np.maximum(counts, 1)[:, None]
        out[rows, 2 * WIDTH] = np.log1p(counts)
    return out


class Network:
    """Two layers, tanh between them, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        self.prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.trained = len(y) >= 20 and 0 < y.sum() < len(y)
        if not self.trained:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        apart = np.arange(len(y)) % 5 == 0
        self.w1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN))
        self.w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1))
        self.b1, self.b2 = np.zeros(HIDDEN), np.zeros(1)
        self._fit(z[~apart], y[~apart].astype(float), rng)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        logit = self._logit(z[apart])
        loss = [np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2)[:, 0]

    def _fit(self, z: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                step += 1
                hidden = np.tanh(z[rows] @ self.w1 + self.b1)
                out = (hidden @ self.w2 + self.b2)[:, 0]
                slope = ((1 / (1 + np.exp(-out))) - y[rows])[:, None] / len(rows)
                back = slope @ self.w2.T * (1 - hidden**2)
                grads = [z[rows].T @ back + 1e-4 * self.w1, back.sum(0), hidden.T @ slope + 1e-4 * self.w2, slope.sum(0)]
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -50, 50)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 1, folds: int = 3, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """docs with quality_score and quality_predicted, learnt from the labels outside the fold."""
    vectors = context_vectors(docs, text)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.slices(batches):
            x = pooled(batch.column(2).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "y", "x"])

    kind = dict(docs.dtypes)[key]
    rows = _base.labelled(docs, labels, label, _base.crc_of_id(key) % folds != fold, sample, text, key)
    # At most `sample` rows of some hundred bytes.
    seen = sorted((r["key"], r["y"], bytes(r["x"])) for r in rows.mapInArrow(features, f"key {kind}, y int, x binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, _, v in seen], np.float64).reshape(len(seen), 2 * WIDTH + 1)
    network = Network(x, np.array([y for _, y, _ in seen], int))
    docs = docs.drop("quality_score", "quality_predicted")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.slices(batches, 512):
            s = network.score(pooled(batch.column(place).to_pylist(), vectors).astype(np.float64))
            yield _base.append_columns(batch, {"quality_score": pa.array(s), "quality_predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, _base.schema_with(docs, ("quality_score", "double"), ("quality_predicted", "int")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, _base.table(spark, sf_dir, "labels"))
    return done.select("doc_id", (_base.crc_of_id() % 3 == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
