"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` places of a 32-bit ring; a row's place is the MD5 of
its id, and its shard is that of the next place clockwise.  A shard takes no
more than its bound; the rows of an arc that a full shard can't take go on to
the next different shard clockwise, in rounds, until all are placed.  All rows
of an arc have the same way round the ring, so only the arcs' totals are needed
to plan (one row for each virtual node, whatever the size of the table); rows
then find their segment by their running place in the arc.

law "rows": bounds are the row counts of an exact split, so counts differ by at
most one.  law "bytes": bounds are (1 + slack) times the mean bytes, and a row
counts where it begins, so a shard is over its bound by one row at most.

Null texts have no bytes (size 1, crc32 0); a null id hashes as empty; repeated
ids are placed one after the other; empty tables give empty results; other
columns, whatever their names, are passed through by `assign` (shard_size,
shard_id and shard_slot are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base

SHARDS = 8
#: Places of a shard; with 256, about an eighth of the rows moves when a ninth shard is added, a ninth being the least.
VNODES = 256
SLACK = 0.01


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending order and their shards; a shard's places don't depend on how many shards there are."""
    at = sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))
    return np.array([a for a, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def plan(totals: Sequence[int], owners: np.ndarray, bounds: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): from <= place < to in the arc goes to the shard."""
    shards, arcs = len(bounds), len(owners)
    ways = []
    for arc in range(arcs):
        way, i = [], arc
        while len(way) < shards:
            if owners[i % arcs] not in way:
                way.append(int(owners[i % arcs]))
            i += 1
        ways.append(way)
    left, done, out = list(bounds), [0] * arcs, []
    for turn in range(shards):
        for arc in range(arcs):
            shard = ways[arc][turn]
            take = min(totals[arc] - done[arc], left[shard])
            if take > 0:
                out.append((arc, done[arc], done[arc] + take, shard))
                done[arc] += take
                left[shard] -= take
    return out


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "rows", key: str = "doc_id", text: str = "text", vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """docs with shard_size, shard_id and shard_slot."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark = docs.sparkSession
    places, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy()) % len(places)).astype("int32")

    ranges = max(64, _base.partitions(spark))
    # The row's own columns travel as one, so that none is taken for ours.
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("shard_size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_md5"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
    )
    rows = rows.withColumn("_at", F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long")).withColumn("_arc", arc_of("_at"))
    rows = rows.withColumn("_load", F.lit(1).cast("long") if law == "rows" else F.col("shard_size"))
    # The arc across zero continues after the last place.
    turned = F.pmod(F.col("_at") - int(places[-1]) - 1, F.lit(1 << 32))
    cut = F.floor(turned * ranges / (1 << 32)).cast("int")
    order = [turned, F.col("_md5"), F.col("shard_size"), F.col("_crc")]
    rows = _base.cumulative(rows, ["_arc"], order, cut, "_load", "_through").withColumn("_begin", F.col("_through") - F.col("_load"))
    by_arc = {r["_arc"]: (r["n"], r["load"]) for r in _arc_totals(docs, key, text, arc_of, law)}
    totals = [by_arc.get(a, (0, 0))[1] for a in range(len(places))]
    whole = sum(totals)
    bounds = [whole // shards + (s < whole % shards) for s in range(shards)] if law == "rows" else [int(whole * (1 + slack) / shards) + 1] * shards
    segments = sorted(plan(totals, owners, bounds))
    spread: dict[int, int] = {}
    table = []
    for arc, low, high, shard in segments:
        table.append((arc, low, high, shard, spread.get(shard, 0)))
        spread[shard] = spread.get(shard, 0) + high - low
    # At most vnodes * shards * shards rows.
    found = spark.createDataFrame(table, "_a int, _low long, _high long, shard_id int, _base long")
    rows = rows.join(F.broadcast(found), (F.col("_arc") == F.col("_a")) & (F.col("_begin") >= F.col("_low")) & (F.col("_begin") < F.col("_high")))
    if law == "rows":
        rows = rows.withColumn("shard_slot", F.col("_base") + F.col("_begin") - F.col("_low"))
    else:
        rows = _base.cumulative(rows, ["shard_id"], order, cut, "_load", "_sum", "_nth").withColumn("shard_slot", F.col("_nth") - 1)
    own = ("shard_size", "shard_id", "shard_slot")
    return rows.select(*[F.col(f"_doc.{c}") for c in docs.columns if c not in own], "shard_size", F.col("shard_id").cast("int").alias("shard_id"), F.col("shard_slot").cast("long").alias("shard_slot"))


def _arc_totals(docs: DataFrame, key: str, text: str, arc_of: object, law: str) -> list:
    load = F.lit(1) if law == "rows" else F.coalesce(F.octet_length(text), F.lit(0)) + 1
    md5 = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(arc_of(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")).alias("_arc"), load.cast("long").alias("_load"))
    return rows.groupBy("_arc").agg(F.count(F.lit(1)).alias("n"), F.sum("_load").alias("load")).collect()


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # Only ids and sizes are dealt out, not the texts.
    sized = docs.select("doc_id", "text_crc32", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    placed = assign(sized.withColumn("_none", F.lit(None).cast("string")), text="_none")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard_id").alias("shard"), F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
