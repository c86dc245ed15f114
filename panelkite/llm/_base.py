"""Shared pieces: tables in the shared folder, connected components, prefix sums, row-batch maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a session on one machine (tests) may leave it unset: it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, in a folder for each value of `by`, and reads it back: the lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = _path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, tag: str, keys: Sequence[str]) -> DataFrame:
    """As stored(), bucketed and sorted by the keys, so that joins and sums by them need no shuffle of it."""
    spark = df.sparkSession
    name, path = f"{tag}_{uuid.uuid4().hex}", _path(spark, tag)
    many = partitions(spark)
    # A task writes whole buckets, one file each.
    df.repartition(many, *keys).write.bucketBy(many, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stored_at, out._stored_as = path, name
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() or bucketed() wrote and that nothing reads any more."""
    spark = df.sparkSession
    if name := getattr(df, "_stored_as", None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its user sets by the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that Python objects exist for few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_of_id(column: str = "doc_id") -> Column:
    """The unsigned crc32 of an id's decimal text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    nodes = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = nodes.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the undirected edges (u, v): root is the smallest node of the component.

    Alternates large-star and small-star until the edges are stars.  Each half
    pre-aggregates minima before its shuffle, so a hub costs one row a task, and
    each round is a table in the shared folder.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def cumulative(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], slice_of: Column, amount: str, out: str, count: str | None = None
) -> DataFrame:
    """Adds the running sum of `amount` (itself included) inside each group, and 1, 2, ... as `count`.

    slice_of numbers equal ranges of the order.  Sums of slices are added up
    first, so no task holds a group, only one slice of it.
    """
    cut = df.withColumn("_cum_slice", slice_of)
    sums = cut.groupBy(*group, "_cum_slice").agg(F.sum(amount).alias("_cum_sum"), F.count(F.lit(1)).alias("_cum_rows"))
    before = Window.partitionBy(*group).orderBy("_cum_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"_cum_{g}") for g in group],
        F.col("_cum_slice").alias("_cum_at"),
        F.coalesce(F.sum("_cum_sum").over(before), F.lit(0)).alias("_cum_before"),
        F.coalesce(F.sum("_cum_rows").over(before), F.lit(0)).alias("_cum_rows_before"),
    )
    same = F.col("_cum_slice") == F.col("_cum_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_cum_{g}"))
    inside = Window.partitionBy(*group, "_cum_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = cut.withColumn("_cum_run", F.sum(amount).over(inside)).withColumn("_cum_nth", F.count(F.lit(1)).over(inside)).join(starts, same)
    done = done.withColumn(out, F.col("_cum_run") + F.col("_cum_before"))
    if count:
        done = done.withColumn(count, F.col("_cum_nth") + F.col("_cum_rows_before"))
    return done.drop("_cum_slice", "_cum_at", "_cum_before", "_cum_rows_before", "_cum_run", "_cum_nth", *[f"_cum_{g}" for g in group])


class Forest:
    """Union-find over arbitrary keys, for the links of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def column(values: object, kind: pa.DataType) -> pa.Array:
    """An Arrow array from NumPy values or a list."""
    return pa.array(values.tolist() if isinstance(values, np.ndarray) and values.dtype == object else values, kind)


def summed(blocks: DataFrame, cells: int, count: int) -> np.ndarray:
    """The int64 sums of a table of count * cells counters, given as rows (block int, cells binary of int32).

    The table's size is fixed by its caller and doesn't follow the data.  Rows
    are added up as they stream in, one block's sum held at a time for each block.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(block, np.zeros(cells, np.int64))
                totals[block] += np.frombuffer(raw.as_buffer(), np.int32)
        for block, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])

    out = np.zeros((count, cells), np.int64)
    for row in blocks.repartition(min(count, max(1, partitions(blocks.sparkSession))), "block").mapInArrow(add, "block int, cells binary").collect():
        out[row["block"]] += np.frombuffer(row["cells"], np.int64)
    return out.ravel()


def as_blocks(table: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """A task's counters as rows for summed(), without blocks of zeros."""
    parts = table.reshape(-1, cells).astype(np.int32)
    live = np.flatnonzero(parts.any(axis=1))
    for block in live.tolist():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([parts[block].tobytes()], pa.binary())], names=["block", "cells"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, y, text) for at most `most` labelled documents for which fold holds, chosen by the MD5 of their id.

    Rows with a null id or label don't count; of several labels for an id the largest does.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(fold).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    order = F.md5(F.col(key).cast("string").cast("binary"))
    ids = docs.select(key).where(F.col(key).isNotNull()).distinct()
    pick = known.join(ids, key, "left_semi").orderBy(order, key).limit(most)
    pick = pick.select(F.col(key).alias("_key"), "_y")
    # At most `most` ids.
    rows = docs.select(key, text).join(F.broadcast(pick), F.col(key) == F.col("_key"))
    return rows.select(F.col(key).alias("key"), F.col("_y").alias("y"), F.col(text).alias("text"))


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as rows in double precision) by length, of the vectors that are not null and have neither null nor non-finite components."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    starts = ends - np.maximum(lengths, 0)
    fine = (lengths >= 0) & (bad[ends] == bad[starts])
    for length in np.unique(lengths[fine]).tolist():
        own = np.flatnonzero(fine & (lengths == length))
        yield own, flat[starts[own][:, None] + np.arange(length)]


def append_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def schema_with(df: DataFrame, *extra: tuple[str, str]) -> str:
    """The DDL of df's columns and some more."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *[f"{name} {kind}" for name, kind in extra]])
