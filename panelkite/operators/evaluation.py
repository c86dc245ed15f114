"""Walk-forward evaluation and the statistics of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forecast_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mae, rmse, r2, direction) of rows (forecast, actual, benchmark): r2 is against the benchmark."""
    e, b = F.col("actual") - F.col("forecast"), F.col("actual") - F.col("benchmark")
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.sum(b * b))).alias("r2"),
        F.avg((F.signum("forecast") == F.signum("actual")).cast("double")).alias("direction"),
    )


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Slopes of standardised columns, turned back, and the intercept."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return w, float(y.mean() - mean @ w)


def walk_forward(training: DataFrame, targets: DataFrame, features: Sequence[str], alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """(issued_at, alpha, forecast, benchmark, actual): an expanding ridge for each origin, one task each.

    training: (issued_at, datetime, label, features), what an origin may see;
    targets: (issued_at, actual, features).  The penalty is the one that forecast
    the last fifth of the training rows best; rows of one date are in order of their values.
    """

    def run(known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        known = known.dropna(subset=["label", *features]).sort_values(["datetime", *features, "label"])
        x, y = known[list(features)].to_numpy(float), known["label"].to_numpy(float)
        if len(y) < 5:
            return pd.DataFrame(columns=["issued_at", "alpha", "forecast", "benchmark", "actual"])
        cut = max(len(y) * 4 // 5, 2)

        def error(alpha: float) -> float:
            w, b = ridge(x[:cut], y[:cut], alpha)
            return float(((x[cut:] @ w + b - y[cut:]) ** 2).mean())

        alpha = min(alphas, key=error)
        w, b = ridge(x, y, alpha)
        return wanted.assign(alpha=alpha, forecast=wanted[list(features)].to_numpy(float) @ w + b, benchmark=y.mean())[["issued_at", "alpha", "forecast", "benchmark", "actual"]]

    # Both may come from the same frames: columns of their own keep them apart.
    training, targets = (df.select([F.col(c).alias(c) for c in df.columns]) for df in (training, targets))
    return training.groupBy("issued_at").cogroup(targets.groupBy("issued_at")).applyInPandas(run, "issued_at timestamp_ntz, alpha double, forecast double, benchmark double, actual double")


def _moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> pd.DataFrame:
    """Numbers, means and covariances of columns by keys: one row a key, around the key's own means."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    means = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *means, *[F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i, j in pairs]).toPandas()


def _arrays(frame: pd.DataFrame, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = frame["_n"].to_numpy(float)
    mean = frame[[f"_m{i}" for i in range(many)]].to_numpy(float)
    cov = np.stack([np.stack([frame[f"_c{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(many)], -1) for i in range(many)], -2)
    return n, mean, cov


def _merged(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    n, mean, cov = (np.concatenate(x) for x in zip(*parts, strict=True))
    all_n = n.sum()
    whole = n @ mean / all_n
    off = mean - whole
    return all_n, whole, np.einsum("i,ijk->jk", n, cov + off[:, :, None] * off[:, None, :]) / all_n


def _ridge_of(mean: np.ndarray, cov: np.ndarray, n: float, alpha: float) -> tuple[np.ndarray, float]:
    """`ridge` from moments of the columns and, last, the label."""
    scale = np.sqrt(np.diag(cov)[:-1])
    scale = np.where(scale > 0, scale, 1.0)
    z = n * cov[:-1, :-1] / np.outer(scale, scale)
    w = np.linalg.solve(z + alpha * np.eye(len(scale)), n * cov[:-1, -1] / scale) / scale
    return w, float(mean[-1] - mean[:-1] @ w)


def walk_forward_by_date(rows: DataFrame, origins: DataFrame, targets: DataFrame, features: Sequence[str], alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """`walk_forward` of rows (datetime, matures, label, features) whose labels mature in order of their dates.

    What an origin may learn from is then the dates up to one, so moments of
    dates, which are few, make all models; an origin's rows are never gathered.
    Only the date in which the last fifth begins is read row by row.
    """
    columns = [*features, "label"]
    known = rows.where(F.col("matures").isNotNull()).dropna(subset=columns)
    for c in columns:
        known = known.where(~F.isnan(c))
    dates = _moments(known, ["datetime", "matures"], columns).sort_values("datetime")
    n, mean, cov = _arrays(dates, len(columns))
    days, matures = dates["datetime"].to_numpy(), dates["matures"].to_numpy()
    before = np.concatenate([[0.0], np.cumsum(n)])
    cuts = []
    for origin in sorted(r[0] for r in origins.distinct().collect() if r[0] is not None):
        last = int(((matures <= np.datetime64(origin)) & (days < np.datetime64(origin))).sum())
        if before[last] >= 5:
            cut = max(int(before[last]) * 4 // 5, 2)
            at = int(np.searchsorted(before, cut, "right")) - 1
            cuts.append((origin, last, at, int(cut - before[at])))
    spark = rows.sparkSession
    schema = "issued_at timestamp_ntz, alpha double, intercept double, benchmark double, w array<double>"
    fits = []
    split: dict = {}
    inside = [(origin, pd.Timestamp(days[at]).to_pydatetime(), rest) for origin, _, at, rest in cuts if rest]
    if inside:
        side = spark.createDataFrame(inside, "issued_at timestamp_ntz, _day timestamp_ntz, _cut long")
        order = Window.partitionBy("issued_at").orderBy(*columns)
        ranked = known.join(F.broadcast(side), F.col("datetime") == F.col("_day")).withColumn("_late", F.row_number().over(order) > F.col("_cut"))
        for (origin, late), part in _moments(ranked, ["issued_at", "_late"], columns).groupby(["issued_at", "_late"]):
            split[pd.Timestamp(origin), bool(late)] = _arrays(part, len(columns))
    for origin, last, at, rest in cuts:
        span = lambda a, b: (n[a:b], mean[a:b], cov[a:b])
        halves = [split[key] for late in (False, True) if (key := (pd.Timestamp(origin), late)) in split] if rest else []
        early = _merged([span(0, at), *halves[:1]])
        late = _merged([span(at + bool(rest), last), *halves[1:]])

        def error(alpha: float, early: tuple = early, late: tuple = late) -> float:
            w, b = _ridge_of(early[1], early[2], early[0], alpha)
            off = np.append(w, -1.0)
            return float((late[1] @ off + b) ** 2 + off @ late[2] @ off)

        alpha = min(alphas, key=error)
        whole = _merged([span(0, last)])
        w, b = _ridge_of(whole[1], whole[2], whole[0], alpha)
        fits.append((origin, float(alpha), b, float(whole[1][-1]), [float(x) for x in w]))
    models = F.broadcast(spark.createDataFrame(fits, schema))
    forecast = sum((F.col(c) * F.col("w")[i] for i, c in enumerate(features)), F.lit(0.0)) + F.col("intercept")
    return targets.join(models, "issued_at").select("issued_at", "alpha", forecast.alias("forecast"), "benchmark", "actual")


def block_bootstrap(values: np.ndarray, block: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Means of circular blocks drawn with replacement."""
    rng = np.random.default_rng(seed)
    n = len(values)
    starts = rng.integers(0, n, (rounds, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)) % n
    return values[at.reshape(rounds, -1)[:, :n]].mean(axis=1)


def hac_t(values: np.ndarray, lags: int) -> float:
    """A mean by its deviation, that allows for correlation up to so many lags."""
    n, e = len(values), values - values.mean()
    var = e @ e / n
    for k in range(1, lags + 1):
        var += 2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n
    return float(values.mean() / np.sqrt(var / n)) if var > 0 else float("nan")


def holm(p: Sequence[float]) -> list[float]:
    """Step-down adjusted probabilities."""
    order = np.argsort(p)
    out, top = [0.0] * len(p), 0.0
    for i, k in enumerate(order):
        top = max(top, min(1.0, (len(p) - i) * p[k]))
        out[k] = top
    return out
