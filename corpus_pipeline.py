"""A training corpus in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages, documents are written as Parquet and read again, and what
no later stage reads is deleted.

Texts of any length are worked on whole.  Null and empty texts: the classifier
scores them as any other and may drop them; line dedup leaves them as they are
(null becomes empty); they have no near duplicates; they have no words, so the
mix takes none.  A null id stays null; documents without one are told apart by
their texts.  Of rows with equal id and text the near-duplicate stage keeps one;
equal ids with different texts are different documents.  Of near duplicates the
one with the smallest id stays.  A null source is a source of its own.  Nulls in
other columns, and columns whose names are used inside, pass through.  Empty
tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base, lines, mixing, ngrams, pieces, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    done = quality.score(docs, _base.table(spark, sf_dir, "labels"))
    return done.where("quality_predicted = 1").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others repeat; all documents stay."""
    done = lines.dedup(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of repeated rows one stays; documents without an id stay unless they repeat.
    """
    keep = ngrams.join(docs).where("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    return kept.withColumn("_same", F.xxhash64("text")).dropDuplicates(["doc_id", "_same"]).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs).select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, with the end id, and the byte offset in the text at which each begins, and the last ends."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The first stage is a trained classifier, which SQL can't express; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = _base.stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
        if before is not None:
            _base.discard(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
