"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source are shuffled by the MD5 of their id and queued up to
`epochs` times.  A queued copy's virtual finish time is the source's words up
to and including it, divided by the source's target.  All copies are taken in
order of finish time until the total budget is reached.  The order is cut into
ranges of finish time whose sums are added up first: only the range with the
cut is summed row by row.

Empty tables give empty results; null texts have size 0; a null source is a
source of its own and comes last; documents of size 0 are never taken; repeated
rows are separate documents; extra columns stay in `mix`, whatever their names
(mix_epoch and mix_finish are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkite.llm import _base

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = EPOCHS) -> DataFrame:
    """(mix_source, mix_source_size, mix_target) from one row a source (mix_source, mix_source_size).

    Shares are proportional to weight; none exceeds `most` times its source, and
    what is over goes to the others by weight.  Sources by most * size / weight
    fill up in that order, so with the first k full the level of the rest is
    (budget - their sizes) / (weights of the rest), which rises with k as long as
    the next one would be over it, and falls from there: the highest is the
    solution.  One row a source: windows over these rows are small whatever the
    number of documents.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("mix_source_size") * most)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("mix_source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_wfull", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    ranked = ranked.withColumn("_budget", F.sum("mix_source_size").over(everything) * percent / 100.0).withColumn("_wall", F.sum("_w").over(everything))
    level = (F.col("_budget") - F.col("_full")) / (F.col("_wall") - F.col("_wfull"))
    level = F.max(level).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap").cast("double")))
    return ranked.select("mix_source", "mix_source_size", target.alias("mix_target"))


def queued(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: Sequence[int] = WEIGHTS, percent: int = SHARE_PERCENT, epochs: int = EPOCHS, carry: bool = False) -> DataFrame:
    """One row for each copy that may be taken, with mix_taken telling whether it is."""
    spark = docs.sparkSession
    # Enough ranges that each fits a task: as many as the session's shuffles, for a source that holds all rows.
    ranges = max(64, _base.partitions(spark))
    rows = docs.select(
        F.col(key).alias("mix_key"),
        F.col(source).alias("mix_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("mix_size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("mix_order"),
        # The document's own columns travel as one, so that none is taken for ours.
        *([F.struct(*docs.columns).alias("mix_doc")] if carry else []),
    )
    sizes = rows.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    targets = source_targets(sizes, weights, percent, epochs)
    spread = F.floor(F.conv(F.substring("mix_order", 1, 7), 16, 10).cast("long") * ranges / (1 << 28)).cast("int")
    order = [F.col("mix_order"), F.col("mix_key"), F.col("mix_size")]
    rows = _base.cumulative(rows, ["mix_source"], order, spread, "mix_size", "_run")
    # A row for each source: its number doesn't follow the number of documents.
    rows = rows.join(targets.withColumnRenamed("mix_source", "_s"), F.col("mix_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    through = F.col("_run") + (F.col("mix_epoch") - 1) * F.col("mix_source_size")
    rows = rows.withColumn("mix_finish", F.when(F.col("mix_size") > 0, through.cast("double") / F.col("mix_target"))).drop("_run")
    live = rows.where("mix_size > 0")
    budget = sizes.agg(F.coalesce(F.sum("mix_source_size"), F.lit(0)).alias("_all")).select((F.col("_all") * percent / 100.0).alias("_budget"))
    slot = F.least(F.floor(F.col("mix_finish") * ranges).cast("long"), F.lit(4 * ranges).cast("long"))
    by_slot = live.groupBy(slot.alias("_slot")).agg(F.sum("mix_size").alias("_sum"))
    runs = by_slot.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The range with the cut: at most one row.
    cut = runs.join(F.broadcast(budget)).where("_before <= _budget").groupBy("_budget").agg(F.max(F.struct("_slot", "_before")).alias("_c")).select("_budget", F.col("_c._slot").alias("_cut"), F.col("_c._before").alias("_before"))
    marked = rows.withColumn("_slot", slot).join(F.broadcast(cut), F.lit(True), "left")
    in_cut = F.coalesce(F.col("_slot") == F.col("_cut"), F.lit(False))
    # Only rows of the cut's range (1 / ranges of a source's virtual time) are dealt out again and ordered.
    upto = Window.partitionBy("_cut").orderBy("mix_finish", F.col("mix_source").asc_nulls_last(), *order, "mix_epoch").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_before") + F.sum("mix_size").over(upto)
    inside = marked.where(in_cut).withColumn("mix_taken", at <= F.col("_budget"))
    outside = marked.where(~in_cut).withColumn("mix_taken", F.coalesce(F.col("_slot") < F.col("_cut"), F.lit(False)))
    return outside.unionByName(inside).drop("_slot", "_cut", "_before", "_budget")


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """The mixed documents, each repeated as often as it is taken, with mix_epoch and mix_finish (to order by) in place of columns of these names."""
    own = ("mix_epoch", "mix_finish")
    taken = queued(docs, carry=True, **how).where("mix_taken")
    return taken.select(*[F.col(f"mix_doc.{c}") for c in docs.columns if c not in own], *own)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queued(_base.table(spark, sf_dir, "documents"))
    first = rows.groupBy("mix_key", "mix_source", "mix_size", "mix_source_size", "mix_target").agg(
        F.sum(F.when(F.col("mix_taken"), F.col("mix_size")).otherwise(0)).alias("taken"), F.sum(F.when(F.col("mix_epoch") == 1, 1)).alias("_copies")
    )
    # Rows that are equal in all of these come out as they went in, each with its share of what was taken.
    each = first.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    whole = F.try_divide(F.col("taken"), F.col("mix_size")).cast("long")
    share = F.floor(whole / F.col("_copies")) + (F.col("_nth") <= whole % F.col("_copies")).cast("long")
    return each.select(
        F.col("mix_key").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.coalesce(share * F.col("mix_size"), F.lit(0)).cast("long").alias("taken"),
    )


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2 AS cap FROM sizes),
filled AS (
  SELECT *, coalesce(sum(cap) OVER f, 0) AS full_, coalesce(sum(w) OVER f, 0) AS wfull,
         CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0 AS budget, sum(w) OVER () AS wall
  FROM weighed WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (budget - CAST(full_ AS DOUBLE)) / CAST(wall - wfull AS DOUBLE) AS lv FROM filled),
level AS (SELECT max(lv) AS lv FROM levels),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT lv FROM level) * w, CAST(cap AS DOUBLE))) AS target FROM levels),
runs AS (
  SELECT r.*, t.source_size, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(run + (epoch - 1) * source_size AS DOUBLE) / target AS finish
  FROM runs, (VALUES (1), (2)) e(epoch) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, ord, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
kept AS (
  SELECT doc_id, source, size, sum(size) AS taken FROM cut
  WHERE upto <= (SELECT CAST(sum(source_size) * 150 AS DOUBLE) / 100.0 FROM sizes) GROUP BY doc_id, source, size)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM runs r LEFT JOIN kept k ON r.doc_id IS NOT DISTINCT FROM k.doc_id AND r.source IS NOT DISTINCT FROM k.source AND r.size = k.size
"""
