"""Line dedup over levelled sorted runs of line hashes.

The long lines of all documents are hashed once and stored by batch; batches
have descending ids, and their number follows the documents.  A batch's lines
become one row for each hash (how many documents, and the largest id).  An
anti-join with the runs so far tells which hashes are new: only those get that
id as their keeper, all others only add to the count.  The rows, bucketed and
sorted by hash, are the newest run, so that joins read runs as they lie.  When a
level has `fanout` runs they are merged into one run of the next level.  At last
the runs give the lines to drop: in at least `copies` documents, and not in the
keeper.

Hashes are 128 bits.  Null or empty texts are one empty line and are kept;
empty tables give empty results; a document id that occurs in several rows
counts as one document, and a null id as the smallest; all other columns are
passed through `dedup`, also such as are named like a column of ours (`marked`
replaces those of its three names).
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Batches at least, and documents of a batch at most, about.
BATCHES, BATCH_ROWS = 4, 1_000_000_000
FANOUT = 2
#: Stands for a null id.
_NO_ID = -(1 << 63)
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


class LineRuns:
    """Runs (hi, lo, n, top) by level; n documents hold the line, top is its keeper where this run saw it first."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        """The oldest first."""
        return [run for level in self.levels[::-1] for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run's rows from several, the oldest first, by merge joins; one of them alone has a hash's keeper."""
        both = runs[0].select("hi", "lo", "n", "top")
        for run in runs[1:]:
            newer = run.select("hi", "lo", F.col("n").alias("_n"), F.col("top").alias("_top"))
            both = both.join(newer, ["hi", "lo"], "full").select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_top", "top").alias("top"))
        return both

    def fresh(self, batch: DataFrame) -> DataFrame:
        """(hi, lo, top) of the hashes that no run has."""
        out = batch.select("hi", "lo", "top")
        for run in self.runs():
            out = out.join(run.select("hi", "lo"), ["hi", "lo"], "left_anti")
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: one row (hi, lo, n, top) for each hash."""
        self._push(0, batch.select("hi", "lo", "n").join(self.fresh(batch), ["hi", "lo"], "left"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(_base.bucketed(run, f"lines_{level}", ["hi", "lo"]))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self.merged(full))
            for old in full:
                _base.discard(old)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))).withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))


def _hashed(rows: DataFrame, least: int) -> DataFrame:
    """(_id, _row, _at, hi, lo) for each line of at least `least` characters."""
    one = rows.select("_id", "_row", F.posexplode("_lines").alias("_at", "_line")).where(F.char_length("_line") >= least).withColumn("_key", line_key(F.col("_line")))
    return one.where(F.char_length("_key") >= least).select("_id", "_row", "_at", F.xxhash64("_key").alias("hi"), F.xxhash64(F.lit(1), F.col("_key")).alias("lo"))


def long_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = LEAST_CHARS, batches: int | None = None) -> tuple[DataFrame, int]:
    """Stored rows (_id, _row, _at, hi, lo, _batch) of all long lines, and the number of batches, the first of the largest ids."""
    most = batches or max(BATCHES, -(-docs.count() // BATCH_ROWS))
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / most for i in range(1, most)], 1000).alias("c")).first()["c"] if most > 1 else None
    cuts = sorted(set(cuts or []))
    rows = _rows(docs.select(key, text), key, text).withColumn("_row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    batch = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c > F.col("_id"))) if cuts else F.lit(0)
    return _base.stored(_hashed(rows, chars).withColumn("_batch", batch), "long-lines", by="_batch"), len(cuts) + 1


def repeated_lines(lines: DataFrame, batches: int, copies: int = LEAST_DOCS) -> DataFrame:
    """Stored rows (hi, lo, top): hashes found in at least `copies` documents, and the document that keeps the line; lines and batches from long_lines."""
    log = LineRuns()
    for k in range(batches):
        rows = lines.where(F.col("_batch") == k).select("hi", "lo", "_id").distinct()
        log.add(rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("top")))
    out = _base.stored(log.merged(log.runs()).where(F.col("n") >= copies).select("hi", "lo", "top"), "repeated-lines")
    for run in log.runs():
        _base.discard(run)
    return out


def _marked(docs: DataFrame, key: str, text: str, chars: int = LEAST_CHARS, copies: int = LEAST_DOCS, batches: int | None = None) -> DataFrame:
    """(_doc, _count, _dropped, _kept): the document, its lines, how many go, and the text without them."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for value, places in zip(texts, dropped, strict=True):
            gone = set() if places is None else set(places)
            out.append(None if value is None else "\n".join([x for i, x in enumerate(value.split("\n")) if i not in gone]))
        return pd.Series(out, dtype=object)

    lines, count = long_lines(docs, key, text, chars, batches)
    repeated = repeated_lines(lines, count, copies)
    fingerprint = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    drops = lines.join(repeated, ["hi", "lo"]).where("_id <> top").groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_set("_at").alias("_drop"))
    # The document's own columns travel as one, so that none is taken for ours.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("_id"), fingerprint.alias("_row"))
    joined = rows.join(drops, (F.col("_id") == F.col("_i")) & (F.col("_row") == F.col("_r")), "left")
    whole = F.coalesce(F.col("_text"), F.lit(""))
    joined = joined.withColumn("_dropped", F.greatest(F.size("_drop"), F.lit(0)).cast("long"))
    joined = joined.withColumn("_count", (F.char_length(whole) - F.char_length(F.translate(whole, "\n", "")) + 1).cast("long"))
    cut = without(F.when(F.col("_dropped") > 0, F.col("_text")), F.col("_drop"))
    return joined.select("_doc", "_count", "_dropped", F.when(F.col("_dropped") > 0, cut).otherwise(whole).alias("_kept"))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """docs with line_count, line_dropped and line_kept (the text without its dropped lines), in place of columns of these names."""
    own = ("line_count", "line_dropped", "line_kept")
    done = _marked(docs, key, text, **how)
    return done.select(*[F.col(f"_doc.{c}") for c in docs.columns if c not in own], F.col("_count").alias(own[0]), F.col("_dropped").alias(own[1]), F.col("_kept").alias(own[2]))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """docs with the repeated lines gone from the text."""
    done = _marked(docs, key, text, **how)
    return done.select(*[F.col("_kept").alias(c) if c == text else F.col(f"_doc.{c}") for c in docs.columns])


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = marked(_base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2(F.col("line_kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, row_, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
    SELECT doc_id, row_number() OVER () AS row_, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.top AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id, row_
"""
