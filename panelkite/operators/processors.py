"""Cross-sectional and fitted processors.

A processor turns a frame with (instrument, datetime, columns) into another.
Fitted ones are estimators: fit() looks at the rows of a time range and gives a
processor whose parameters are plain numbers, one small row for any input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkite.functions.elementwise import finite, known, number
from panelkite.plans.compiler import INSTRUMENT, TIME

#: A normal distribution's deviation from its median absolute one, and that of a uniform rank.
MAD_SCALE, RANK_SCALE, TINY = 1.4826, 3.46, 1e-12


def on_date() -> WindowSpec:
    return Window.partitionBy(TIME)


class Processor:
    """A step of a pipeline; not all may be used at inference."""

    for_inference = True

    def fit(self, df: DataFrame) -> Processor:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def _each(df: DataFrame, columns: Sequence[str], change: Callable[[Column, str], Column]) -> DataFrame:
    return df.withColumns({c: change(F.col(f"`{c}`"), c) for c in columns})


@dataclass
class DropMissing(Processor):
    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=list(self.columns))


class DropMissingLabel(DropMissing):
    for_inference = False


@dataclass
class DropColumns(Processor):
    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


@dataclass
class KeepColumns(Processor):
    """Of a group's columns only some; columns outside the group stay."""

    group: Sequence[str]
    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.select([F.col(f"`{c}`") for c in df.columns if c not in self.group or c in self.columns])


@dataclass
class Tanh(Processor):
    """tanh(x - 1) of all but label columns."""

    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, [c for c in self.columns if "LABEL" not in c], lambda x, _: F.tanh(number(x) - 1))


@dataclass
class FillInfinite(Processor):
    """Infinities become the date's mean of the others."""

    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, self.columns, lambda x, _: F.when(x.isin(float("inf"), float("-inf")), F.avg(finite(x)).over(on_date())).otherwise(x))


@dataclass
class Fill(Processor):
    columns: Sequence[str]
    value: float = 0.0

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, self.columns, lambda x, _: F.coalesce(known(number(x)), F.lit(float(self.value))))


@dataclass
class Fitted(Processor):
    """Parameters from the rows between two moments, both included."""

    columns: Sequence[str]
    start: str
    end: str
    params: dict = field(default_factory=dict)

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.where((F.col(TIME) >= F.lit(self.start).cast("timestamp_ntz")) & (F.col(TIME) <= F.lit(self.end).cast("timestamp_ntz")))

    def _learn(self, df: DataFrame, **aggregates: Callable[[str], Column]) -> dict[str, dict]:
        columns = [f(c).alias(f"{name}|{c}") for name, f in aggregates.items() for c in self.columns]
        row = self._rows(df).agg(*columns).first().asDict()
        return {name: {c: row[f"{name}|{c}"] for c in self.columns} for name in aggregates}

    def _scaled(self, df: DataFrame, center: dict, scale: dict) -> DataFrame:
        def one(x: Column, c: str) -> Column:
            if center[c] is None or not scale[c]:
                return x
            return (number(x) - center[c]) / scale[c]

        return _each(df, self.columns, one)


class MinMax(Fitted):
    """To [0, 1] of the fitted range; a constant column stays."""

    def fit(self, df: DataFrame) -> MinMax:
        self.params = self._learn(df, low=lambda c: F.min(known(number(F.col(f"`{c}`")))), high=lambda c: F.max(known(number(F.col(f"`{c}`")))))
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        low, high = self.params["low"], self.params["high"]
        return self._scaled(df, low, {c: None if low[c] is None else high[c] - low[c] for c in self.columns})


class ZScore(Fitted):
    """By mean and population deviation; a constant column stays."""

    def fit(self, df: DataFrame) -> ZScore:
        self.params = self._learn(df, mean=lambda c: F.avg(known(number(F.col(f"`{c}`")))), std=lambda c: F.stddev_pop(known(number(F.col(f"`{c}`")))))
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return self._scaled(df, self.params["mean"], self.params["std"])


@dataclass
class RobustZScore(Fitted):
    """By median and scaled median absolute deviation, cut at 3."""

    clip: bool = True
    exact: bool = True

    def _median(self, x: Column) -> Column:
        return F.percentile(x, F.lit(0.5)) if self.exact else F.percentile_approx(x, 0.5, 10_000).cast("double")

    def fit(self, df: DataFrame) -> RobustZScore:
        self.params = self._learn(df, median=lambda c: self._median(known(number(F.col(f"`{c}`")))))
        middle = self.params["median"]
        mad = self._learn(df, mad=lambda c: self._median(F.abs(known(number(F.col(f"`{c}`"))) - F.lit(middle[c]))))["mad"]
        self.params["scale"] = {c: None if v is None else (v + TINY) * MAD_SCALE for c, v in mad.items()}
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self._scaled(df, self.params["median"], self.params["scale"])
        return _each(out, self.columns, lambda x, _: _cut(x)) if self.clip else out


def _cut(x: Column, at: float = 3.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(at)), F.lit(-at)))


@dataclass
class DateZScore(Processor):
    """Each date's cross-section by its mean and deviation, or by median and median deviation."""

    columns: Sequence[str]
    method: str = "zscore"

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.method == "zscore":
            return _each(df, self.columns, lambda x, _: F.try_divide(known(number(x)) - F.avg(known(number(x))).over(on_date()), F.nullif(F.stddev_samp(known(number(x))).over(on_date()), F.lit(0.0))))
        if self.method != "robust":
            raise ValueError(f"{self.method} isn't zscore or robust")
        off = _each(df, self.columns, lambda x, _: known(number(x)) - F.percentile(known(number(x)), F.lit(0.5)).over(on_date()))
        spread = _each(off, self.columns, lambda x, _: F.try_divide(x, F.nullif(F.percentile(F.abs(x), F.lit(0.5)).over(on_date()) * MAD_SCALE, F.lit(0.0))))
        return _each(spread, self.columns, lambda x, _: _cut(x))


def date_rank(x: Column) -> Column:
    """A value's percentile rank among its date's values, ties averaged; missing ones don't count."""
    here = Window.partitionBy(TIME, x.isNull()).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(TIME, x))
    return F.when(x.isNotNull(), (F.rank().over(here) + (ties - 1) / 2) / F.count(x).over(on_date()))


@dataclass
class DateRank(Processor):
    """Each date's percentile ranks around zero, scaled to about unit deviation."""

    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, self.columns, lambda x, _: (date_rank(known(number(x))) - 0.5) * RANK_SCALE)


@dataclass
class DateFill(Processor):
    """Missing values become the date's mean."""

    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, self.columns, lambda x, _: F.coalesce(known(number(x)), F.avg(known(number(x))).over(on_date())))


@dataclass
class CoversRange(Processor):
    """Instruments whose data cover a range; looks ahead."""

    start: str
    end: str

    def __call__(self, df: DataFrame) -> DataFrame:
        from panelkite.operators.universe import covers_range

        return covers_range(df, self.start, self.end)


@dataclass
class Repartition(Processor):
    """Rows of an instrument together, for operators that go through instruments."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.repartition(INSTRUMENT)


@dataclass
class Cast(Processor):
    columns: Sequence[str]
    kind: str = "float"

    def __call__(self, df: DataFrame) -> DataFrame:
        return _each(df, self.columns, lambda x, _: x.cast({"int8": "tinyint", "float32": "float"}.get(self.kind, self.kind)))


@dataclass
class GroupNorm(Fitted):
    """One center and mean deviation for each group of columns; volumes by their logarithm first; missing values become 0."""

    groups: Sequence[Sequence[str]] = ()

    @staticmethod
    def _prepared(c: str) -> Column:
        x = known(number(F.col(f"`{c}`")))
        return F.log1p(x) if c.lower().endswith("volume") else x

    def fit(self, df: DataFrame) -> GroupNorm:
        rows = self._rows(df)
        self.params = {"mean": {}, "std": {}}
        for i, group in enumerate(self.groups):
            long = rows.select(F.explode(F.array(*[self._prepared(c) for c in group])).alias("x"))
            mean = long.agg(F.avg("x").alias("m")).first()["m"]
            spread = long.agg(F.stddev_pop(F.abs(F.col("x") - F.lit(mean))).alias("s")).first()["s"] if mean is not None else None
            self.params["mean"][i], self.params["std"][i] = mean, spread
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        for i, group in enumerate(self.groups):
            mean, spread = self.params["mean"][i], self.params["std"][i]
            if mean is None or not spread:
                continue
            df = df.withColumns({c: F.coalesce((self._prepared(c) - mean) / spread, F.lit(0.0)) for c in group})
        return df


#: Fixed values, in order: columns whose names begin so are bent like this, then scaled; a column can be of several steps.
FAMILY_STEPS: tuple[tuple[tuple[str, ...], Callable[[Column], Column]], ...] = (
    (("KLEN", "KLOW", "KUP"), lambda x: F.pow(x, 0.25)),
    (("KLOW2", "KUP2"), lambda x: F.pow(x, 0.5)),
    (
        ("KMID", "KSFT", "OPEN", "HIGH", "LOW", "CLOSE", "VWAP", "ROC", "MA", "BETA", "RESI", "QTLU", "QTLD", "RSV", "SUMP", "SUMN", "SUMD", "VSUMP", "VSUMN", "VSUMD"),
        lambda x: x,
    ),
    (("STD", "VOLUME", "VMA", "VSTD"), lambda x: F.ln(x)),
    (("RSQR",), lambda x: F.coalesce(x, F.lit(0.0))),
    (("MAX", "HIGH0"), lambda x: F.pow(x - 1, 0.5)),
    (("MIN", "LOW0"), lambda x: F.pow(1 - x, 0.5)),
    (("CORR", "CORD"), lambda x: F.exp(x)),
    (("WVMA",), lambda x: F.log1p(x)),
)
_BENT_ELSEWHERE = ("HIGH0", "LOW0")


@dataclass
class FamilyNorm(Processor):
    """Factor families brought to similar shapes, then each date by median and median deviation; labels by mean and deviation."""

    columns: Sequence[str]
    labels: Sequence[str] = ()
    clip: bool = False
    shrink: bool = True
    fill: bool = True
    clip_label: bool = False
    fill_label: bool = False

    def _scaled(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        off = _each(df, columns, lambda x, _: x - F.percentile(x, F.lit(0.5)).over(on_date()))
        scaled = _each(off, columns, lambda x, _: F.try_divide(x, F.nullif(F.percentile(F.abs(x), F.lit(0.5)).over(on_date()) * MAD_SCALE, F.lit(0.0))))
        if self.clip:
            scaled = _each(scaled, columns, lambda x, _: _cut(x))
        if self.shrink:
            # What is over 3 is brought into half a unit, the largest to its end; then the same below.
            over = lambda x, _: F.when(x > 3, 3 + F.try_divide(x - 3, F.max(x).over(on_date()) - 3) * 0.5).otherwise(x)
            under = lambda x, _: F.when(x < -3, -3 - F.try_divide(x + 3, F.min(x).over(on_date()) + 3) * 0.5).otherwise(x)
            scaled = _each(_each(scaled, columns, over), columns, under)
        return _each(scaled, columns, lambda x, _: F.coalesce(x, F.lit(0.0))) if self.fill else scaled

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.labels:
            df = DateZScore(self.labels)(df)
            if self.clip_label:
                df = _each(df, self.labels, lambda x, _: _cut(x))
            if self.fill_label:
                df = df.fillna(0.0, subset=list(self.labels))
        for prefixes, bend in FAMILY_STEPS:
            plain = "KMID" in prefixes
            own = [c for c in self.columns if c.startswith(prefixes) and not (plain and c in _BENT_ELSEWHERE)]
            if own:
                df = self._scaled(_each(df, own, lambda x, _, bend=bend: known(bend(known(number(x))))), own)
        return df


@dataclass
class Pipeline:
    """Shared, inference and learning processors; learning goes on from inference ("append") or from shared ("independent")."""

    shared: Sequence[Processor] = ()
    infer: Sequence[Processor] = ()
    learn: Sequence[Processor] = ()
    how: str = "append"

    @staticmethod
    def _through(df: DataFrame, steps: Sequence[Processor], fit: bool) -> DataFrame:
        for step in steps:
            df = (step.fit(df) if fit else step)(df)
        return df

    def run(self, df: DataFrame, fit: bool = True) -> dict[str, DataFrame]:
        if any(not p.for_inference for p in (*self.shared, *self.infer)):
            raise ValueError("a processor for learning only is used for inference")
        shared = self._through(df, self.shared, fit)
        infer = self._through(shared, self.infer, fit)
        learn = self._through(infer if self.how == "append" else shared, self.learn, fit)
        return {"raw": df, "infer": infer, "learn": learn}


def by_date(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A pandas function of each date's rows."""
    return df.groupBy(TIME).applyInPandas(function, schema)
