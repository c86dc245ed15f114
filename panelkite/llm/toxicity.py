"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text.  The ordinary one is
trained on windows of ordinary documents.  The toxic one holds the same, so that
only what is special to toxic text makes a difference, and in front of it a
dictionary trained on words of toxic windows: those with a character gram that
is in many more of the different toxic windows than of the ordinary ones.  (Of
all toxic windows, nearly all words are ordinary; trained on them as they are,
the dictionary tells little.  The README has figures.)  Where a word begins is
marked, as the same letters inside a word mean little.  A window of a few words
that gets shorter with the toxic dictionary speaks for toxicity.  How many bytes
shorter, in how many windows, makes a probability is calibrated by a logistic
fit on labelled documents that the dictionaries didn't see.

The labelled sample is bounded in documents and bytes (parameters); if a kind's
documents have more bytes, the longest give only their beginnings to training.
Every window of every text is scored.  Null and empty texts have one empty
window; with fewer than ten labels of either kind the score is the smoothed
share of toxic ones, below one half; empty tables
give empty results; repeated rows get equal scores; other columns pass through
`score` (toxic_score and toxic_predicted are replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base

WORDS = 6
GRAM = 5
#: Bytes at a word's beginning that are set apart from those inside words.
HEAD = 5
#: Labelled documents of either kind, and their bytes, at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 4_000, 6_000, 24_000_000
COMMON, SPECIAL = 16384, 4096
#: Ordinary windows that the dictionary is trained on, evenly taken, about.
COMMON_WINDOWS = 100_000
#: Windows with a typical gram, at least; how many times as frequent in toxic text; by how many standard deviations.
LEAST, ODDS, SURE = 8, 6.0, 8.0
_LEVEL = 3


def marked(text: str | None) -> list[bytes]:
    """The words in lower case, their beginnings in upper case: a fragment there isn't found inside a word."""
    return [w[:HEAD].upper() + w[HEAD:] for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]


def windows(text: str | None) -> list[bytes]:
    words = marked(text)
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)] or [b""]


def _grams(raw: bytes) -> set[bytes]:
    return {raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)}


def typical_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Of different toxic windows, the words with a gram that is typical: of frequent ones, in ODDS times the share of windows, and by SURE standard deviations of a count that happens to be so high."""
    with_: Counter[bytes] = Counter()
    without: Counter[bytes] = Counter()
    for w in toxic:
        with_.update(_grams(w))
    live = {g for g, n in with_.items() if n >= LEAST}
    for w in ordinary:
        without.update(_grams(w) & live)
    ratio = len(toxic) / max(len(ordinary), 1)
    chance = {g: ratio * without[g] for g in live}
    typical = {g for g, c in chance.items() if with_[g] + 0.5 >= ODDS * (c + 0.5 * ratio) and with_[g] - c >= SURE * (c + 1) ** 0.5}
    words = (b" " + word + b" " for w in toxic for word in w.split())
    return [w for w in words if not typical.isdisjoint(_grams(w))]


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all that there is
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(_LEVEL, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=how)


class Distance:
    """What the two dictionaries say about a text."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def features(self, text: str | None) -> list[float]:
        parts = windows(text)
        with_, without = self.toxic.compress, self.ordinary.compress
        gain = np.array([len(without(w)) - len(with_(w)) for w in parts])
        above = [int((gain >= k).sum()) for k in (1, 2, 3, 4, 5, 6, 8)]
        n = len(gain)
        return [float(np.clip(gain.max(), -4, 16)), float(np.clip(gain.mean(), -2, 2)), *[np.log1p(a) for a in above], *[a / n for a in above], *[np.log((a + 0.05) / (n + 20)) for a in above], float(np.log(n))]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    # Copies of a text would make its words look typical.
    with_, without = (list(dict.fromkeys(w for t in texts for w in windows(t))) for texts in (toxic, ordinary))
    common = _trained(without[:: max(1, len(without) // COMMON_WINDOWS)], COMMON)
    special = _trained(typical_words(with_, without), SPECIAL, k=48, d=6, dict_id=1)
    return (common + special or b" " * 8), (common or b" " * 8)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Model:
    def __init__(self, rows: list[tuple[int, str]]) -> None:
        """rows: (label, text) in the order of the sample."""
        kinds = [[t for y, t in rows if y == k] for k in (0, 1)]
        self.prior = (len(kinds[1]) + 1) / (len(rows) + 2)
        self.content: tuple[bytes, bytes] | None = None
        if min(map(len, kinds)) < 10:
            return
        # Every third document is kept apart, to calibrate by.
        self.content = dictionaries(*[[t for i, t in enumerate(kinds[k]) if i % 3 < 2] for k in (1, 0)])
        distance = Distance(*self.content)
        apart = [(k, t) for k in (0, 1) for t in kinds[k][2::3]]
        self.fit = _logistic(np.array([distance.features(t) for _, t in apart]), np.array([k for k, _ in apart], float))

    def scores(self, texts: list[str | None], distance: Distance | None) -> np.ndarray:
        if distance is None:
            return np.full(len(texts), min(self.prior, 0.49))
        mean, scale, w = self.fit
        x = (np.array([distance.features(t) for t in texts]).reshape(len(texts), -1) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))


def byte_share(sizes: list[tuple[int, int]], most: int) -> int:
    """The largest number of bytes a text may give so that all (size, count) give `most` at most; the longest size if all fit."""
    left, texts = most, sum(n for _, n in sizes)
    for size, n in sorted(sizes):
        if size * texts > left:
            return left // texts
        left -= size * n
        texts -= n
    return max((size for size, _ in sizes), default=0)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 0, folds: int = 5, text: str = "text", key: str = "doc_id") -> Model:
    rows: list[tuple[int, str]] = []
    crc = _base.crc_of_id(key)
    for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        one = _base.labelled(docs, labels.withColumn(label, F.col(label).cast("int")), label, (crc % folds != fold) & (F.col(label) == kind), most, text, key)
        # A bounded number of rows, and of bytes: long texts give their beginnings, so that all fit.
        lengths = one.groupBy(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).count().collect()
        share = byte_share([(r["size"], r["count"]) for r in lengths], SAMPLE_BYTES)
        begin = F.rtrim(F.make_valid_utf8(F.substring(F.col("text").cast("binary"), 1, share).cast("string")), F.lit("\ufffd"))
        one = one.withColumn("text", F.when(F.octet_length("text") > share, begin).otherwise(F.col("text")))
        rows += [(kind, r["text"] or "") for r in one.select("key", "text").orderBy(F.md5(F.col("key").cast("string").cast("binary")), "key").collect()]
    return Model(rows)


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **how: object) -> DataFrame:
    """docs with toxic_score and toxic_predicted."""
    model = train(docs, labels, text=text, key=key, **how)
    docs = docs.drop("toxic_score", "toxic_predicted")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*model.content) if model.content else None
        for batch in _base.slices(batches):
            s = model.scores(batch.column(place).to_pylist(), distance)
            yield _base.append_columns(batch, {"toxic_score": pa.array(s), "toxic_predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, _base.schema_with(docs, ("toxic_score", "double"), ("toxic_predicted", "int")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, _base.table(spark, sf_dir, "labels"))
    return done.select("doc_id", (_base.crc_of_id() % 5 == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
