"""Gradient-boosted trees with isotonic calibration over an array column of dense features."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass
class Boosted:
    """A fitted classifier; without trees (labels of one class only) every score is `rate`."""

    rate: float
    trees: Any = None
    calibration: Any = None

    def score(self, df: DataFrame, features: str, score: str) -> DataFrame:
        """df with a column score, 0 to 1; the column features goes."""
        if self.trees is None:
            return df.withColumn(score, F.lit(self.rate)).drop(features)
        raw = _margins(self.trees, df, features)
        out = self.calibration.setPredictionCol(score).transform(raw)
        return out.withColumn(score, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).drop(features, *_COLUMNS)


_COLUMNS = ("_vector", "_raw", "_probability", "_class", "_margin")


def _margins(trees, df: DataFrame, features: str) -> DataFrame:
    return trees.transform(df.withColumn("_vector", array_to_vector(features))).withColumn("_margin", vector_to_array("_raw")[1])


def fit(rows: DataFrame, features: str, label: str, held: str, rounds: int = 20, depth: int = 4) -> Boosted:
    """rows: features array<double>, label 0/1, held boolean (rows that calibrate).

    rows is a bounded sample, so it is sorted into one partition; the fit then does not depend on how Spark dealt it.
    """
    rows = written(rows.repartition(1).sortWithinPartitions(features, label, held), "training-rows")
    n, ones, held_ones, held_n = rows.agg(F.count("*"), F.sum(label), F.count_if((F.col(label) == 1) & F.col(held)), F.count_if(F.col(held))).first()
    rate = (ones or 0) / n if n else 0.0
    own = rows.filter(~F.col(held))
    if not ones or ones == n or own.select(label).distinct().count() < 2:
        return Boosted(rate)
    flat = own.select(array_to_vector(features).alias("_vector"), F.col(label).cast("double").alias(label))
    booster = GBTClassifier(featuresCol="_vector", labelCol=label, predictionCol="_class", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=5)
    trees = booster.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(flat)
    enough = held_ones and held_n > held_ones
    base = _margins(trees, rows.filter(held) if enough else rows, features)
    calibration = IsotonicRegression(featuresCol="_margin", labelCol=label, predictionCol="_score").fit(base.select("_margin", F.col(label).cast("double").alias(label)))
    return Boosted(rate, trees, calibration)
