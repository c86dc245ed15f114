"""Reading tables, and the panels that the queries are about."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.operators.panel import Panel, calendar_of
from panelkite.plans.compiler import INSTRUMENT, TIME


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own beside the tables of the session (the shared folder, where one is set); what is there goes with the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for ending in ("", ".csv"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path + ending)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once for those who read them more than once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_raw(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Raw bars from CSV, Parquet, JSON or ORC, by the ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet", "json", "orc"):
        raise ValueError(f"{path}: csv, parquet, json or orc is needed")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema else reader.option("inferSchema", True)
    return getattr(reader, kind)(path)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of suppliers: first, last, highest and lowest price of a day's items, quantity and mean price."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    # A total order on what is read: order and line number alone aren't unique.
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    day = F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")
    # Items are dealt out by instrument once, so that bars and all windows over them need no further shuffle.
    out = items.repartition("l_suppkey").groupBy(F.col("l_suppkey").alias(INSTRUMENT), day.alias(TIME)).agg(
        F.min(key).alias("_a"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.max(key).alias("_b"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("_v"),
    )
    return out.select(INSTRUMENT, TIME, F.col("_a.l_extendedprice").alias("open"), "high", "low", F.col("_b.l_extendedprice").alias("close"), "volume", F.try_divide("_v", "volume").alias("vwap"))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of `bars`, from the items' days alone."""
    return calendar_of(table(spark, folder, "lineitem").select(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias(TIME)))


def dense_panel(spark: SparkSession, folder: str) -> Panel:
    return Panel.dense(bars(spark, folder))


def spine_panel(spark: SparkSession, folder: str) -> Panel:
    return Panel.on_calendar(bars(spark, folder))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users as ticks."""
    return table(spark, folder, "events").select(F.col("user_id").alias(INSTRUMENT), F.col("ts").alias(TIME), "value", "event_type")


def publications(spark: SparkSession, folder: str, field: str = "total_q") -> DataFrame:
    """Orders as published values of quarters; of several on a day the last by key counts."""
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias(INSTRUMENT),
        (F.year("o_orderdate") * 100 + F.quarter("o_orderdate")).alias("period"),
        F.to_date("o_orderdate").alias("date"),
        "o_totalprice",
        "o_orderkey",
    )
    one = rows.groupBy(INSTRUMENT, "period", "date").agg(F.max_by("o_totalprice", F.struct("o_orderkey", "o_totalprice")).alias("value"))
    return one.withColumn("field", F.lit(field))


def benchmark_weights(rows: DataFrame, index: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(datetime, instrument, weight as a share) of one index from rows (code, date, index, weight in percent)."""
    own = rows.where(F.col("index") == index)
    own = own if start is None else own.where(F.col("date") >= F.lit(start).cast("date"))
    own = own if end is None else own.where(F.col("date") <= F.lit(end).cast("date"))
    return own.groupBy(F.col("date").alias(TIME), F.col("code").alias(INSTRUMENT)).agg((F.avg("weight") / 100).alias("weight"))
