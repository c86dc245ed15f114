"""Learned models of spark.ml over panels: rows (instrument, datetime, features, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows.dropna(subset=list(features)))


def _scored(model: object, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(_assembled(rows, features)).withColumnRenamed("prediction", "score").drop("_features")  # type: ignore[attr-defined]


def linear(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "label", ridge: float = 0.0, weight: str | None = None) -> DataFrame:
    """rows with the score of a linear model fitted on the training rows; ridge is the penalty on standardised coefficients."""
    known = _assembled(train.where(F.col(label).isNotNull()), features)
    how = {"weightCol": weight} if weight else {}
    return _scored(LinearRegression(featuresCol="_features", labelCol=label, regParam=ridge, elasticNetParam=0.0, solver="normal", **how).fit(known), rows, features)


def boosted(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 10, depth: int = 4, seed: int = 1) -> DataFrame:
    """rows with the score of boosted trees fitted on the training rows."""
    known = _assembled(train.where(F.col(label).isNotNull()), features)
    return _scored(GBTRegressor(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).fit(known), rows, features)
