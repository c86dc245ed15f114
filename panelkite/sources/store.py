"""A panel store of Parquet tables: calendar, instruments and features, and how raw bars get in.

`features` is partitioned by nothing but sorted by instrument and slot inside
its files, so scans of a few instruments or a range skip most row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkite.operators.panel import Panel, calendar_of
from panelkite.plans.compiler import INSTRUMENT, SLOT, TIME


def first_rows(raw: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each instrument and moment: the first by `order`, or by all its columns."""
    columns = [order] if order else [c for c in raw.columns if c not in (INSTRUMENT, TIME)]
    rank = F.row_number().over(Window.partitionBy(INSTRUMENT, TIME).orderBy(*[F.col(c).asc_nulls_last() for c in columns]))
    return raw.withColumn("_n", rank).where("_n = 1").drop("_n")


def chosen_fields(raw: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    return raw.select(INSTRUMENT, TIME, *[c for c in raw.columns if c not in (INSTRUMENT, TIME) and c not in exclude and (include is None or c in include)])


def spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy(INSTRUMENT).agg(F.min(TIME).alias("start_datetime"), F.max(TIME).alias("end_datetime"))


def only_new(raw: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after their instrument's end, rows of instruments not listed yet)."""
    known = raw.join(ends.select(INSTRUMENT, "end_datetime"), INSTRUMENT)
    return known.where(F.col(TIME) > F.col("end_datetime")).drop("end_datetime"), raw.join(ends, INSTRUMENT, "left_anti")


@dataclass(frozen=True)
class Store:
    """Tables under one folder; each write is a new version that a pointer table names."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        path = self.spark.read.parquet(f"{self.folder}/{name}/_current").orderBy(F.desc("at")).first()["path"]
        return self.spark.read.parquet(path)

    def exists(self, name: str) -> bool:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}/_current").head() is not None
        except AnalysisException:
            return False

    def write(self, name: str, rows: DataFrame) -> None:
        """The pointer is appended after the rows are complete, so readers see the old or the new version."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(path).alias("path")).write.mode("append").parquet(f"{self.folder}/{name}/_current")

    def _write_features(self, rows: DataFrame) -> None:
        self.write("features", rows.repartitionByRange(INSTRUMENT, SLOT).sortWithinPartitions(INSTRUMENT, SLOT))

    def panel(self) -> Panel:
        return Panel(self.read("features"), self.read("calendar"))

    def ingest_all(self, raw: DataFrame) -> None:
        """Everything anew: calendar, spans and bars aligned to the calendar."""
        rows = first_rows(raw)
        self.write("calendar", calendar_of(rows))
        self.write("instruments", spans(rows))
        self._write_features(Panel.on_calendar(rows, self.read("calendar")).rows)

    def ingest_fix(self, raw: DataFrame) -> None:
        """Supplied instruments are rewritten on the calendar as it is; spans of unlisted ones are added."""
        calendar = self.read("calendar")
        rows = first_rows(raw).join(calendar.select(TIME), TIME, "left_semi")
        old = self.read("instruments")
        self.write("instruments", old.unionByName(spans(rows).join(old, INSTRUMENT, "left_anti")))
        kept = self.read("features").join(rows.select(INSTRUMENT).distinct(), INSTRUMENT, "left_anti")
        self._write_features(kept.unionByName(Panel.on_calendar(rows, calendar).rows, allowMissingColumns=True))

    def ingest_update(self, raw: DataFrame) -> None:
        """The calendar goes on past its end, instruments past theirs, and new instruments come in."""
        rows = first_rows(raw)
        calendar, old = self.read("calendar"), self.read("instruments")
        last = calendar.agg(F.max(TIME).alias("t"), F.max(SLOT).alias("i")).first()
        more = rows.select(TIME).distinct().where(F.col(TIME) > F.lit(last["t"]))
        more = more.withColumn(SLOT, F.row_number().over(Window.orderBy(TIME)) + last["i"])
        self.write("calendar", calendar.unionByName(more))
        later, fresh = only_new(rows, old)
        features = self.read("features")
        before = features.select(INSTRUMENT, TIME, *[c for c in rows.columns if c not in (INSTRUMENT, TIME)])
        joined = before.unionByName(later, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)
        # Slots missing between an instrument's old end and its new rows become NULL rows.
        self._write_features(Panel.on_calendar(joined, self.read("calendar")).rows)
        self.write("instruments", spans(old.select(INSTRUMENT, F.explode(F.array("start_datetime", "end_datetime")).alias(TIME)).unionByName(later.select(INSTRUMENT, TIME)).unionByName(fresh.select(INSTRUMENT, TIME))))

    def ingest_periods(self, raw: DataFrame, overwrite: bool = False) -> None:
        """Published values (instrument, field, period, date, value); all revisions stay, and none is written twice."""
        if overwrite or not self.exists("periods"):
            self.write("periods", raw)
            return
        old = self.read("periods")
        last = old.groupBy(INSTRUMENT, "field").agg(F.max("date").alias("_last"))
        new = raw.join(last, [INSTRUMENT, "field"], "left").where("_last IS NULL OR date > _last").drop("_last")
        self.write("periods", old.unionByName(new))

    def extend_calendar(self, moments: DataFrame) -> None:
        both = self.read("calendar").select(TIME).unionByName(moments.select(TIME)).distinct()
        self.write("calendar", both.withColumn(SLOT, F.row_number().over(Window.orderBy(TIME)) - 1))

    def remove_moments(self, moments: DataFrame) -> None:
        left = self.read("calendar").select(TIME).join(moments.select(TIME), TIME, "left_anti")
        self.write("calendar", left.withColumn(SLOT, F.row_number().over(Window.orderBy(TIME)) - 1))

    def put_instruments(self, new: DataFrame) -> None:
        """New spans take the place of an instrument's old ones."""
        self.write("instruments", self.read("instruments").join(new.select(INSTRUMENT).distinct(), INSTRUMENT, "left_anti").unionByName(new))

    def drop_instruments(self, names: DataFrame) -> None:
        self.write("instruments", self.read("instruments").join(names.select(INSTRUMENT), INSTRUMENT, "left_anti"))

    def write_feature(self, new: DataFrame, field: str) -> None:
        """Rows (instrument, cal_idx, value): new values win, old ones stay elsewhere."""
        old = self.read("features")
        side = new.select(INSTRUMENT, SLOT, F.col("value").alias("_new"))
        both = old.join(side, [INSTRUMENT, SLOT], "full")
        kept = F.coalesce("_new", field) if field in old.columns else F.col("_new")
        out = both.withColumn(field, kept).drop("_new", TIME).join(self.read("calendar"), SLOT)
        self._write_features(out.select(INSTRUMENT, TIME, SLOT, *[c for c in out.columns if c not in (INSTRUMENT, TIME, SLOT)]))
