"""Standardised multinomial logistic regression and its metrics."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.operators import merging


def scale_statistics(rows: DataFrame, column: str = "features") -> DataFrame:
    """(dim, mean, std) of each feature: population deviation, 1 where it is 0. One aggregate of vectors' moments."""
    found = merging.merged(rows.select(column), lambda batch: merging.moments(merging.matrix(batch.column(0))), merging.merge_moments)
    n, mean, squares = found or (0, np.zeros(0), np.zeros(0))
    std = np.sqrt(squares / max(n, 1))
    values = [(k, float(m), float(d) if d > 0 else 1.0) for k, (m, d) in enumerate(zip(mean, std))]
    return rows.sparkSession.createDataFrame(values, "dim int, mean double, std double")


class Learner:
    """``fit`` on (label, features), ``predict`` adds ``predicted``."""

    def __init__(self, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-8):
        self._c, self._max_iter, self._tol = c, max_iter, tol
        self._model: LogisticRegressionModel | None = None

    def fit(self, rows: DataFrame) -> Learner:
        stats = {r.dim: (r.mean, r.std) for r in scale_statistics(rows).collect()}  # a row per feature
        if not stats:
            raise ValueError("features must not be empty")
        self._mean, self._std = ([stats[k][j] for k in range(len(stats))] for j in (0, 1))
        labels = sorted(r[0] for r in rows.select("label").distinct().collect())
        if len(labels) < 2:
            raise ValueError("training needs two classes at least")
        self._labels, n = labels, rows.count()
        index = F.element_at(F.create_map(*[F.lit(x) for p in ((v, float(k)) for k, v in enumerate(labels)) for x in p]), F.col("label"))
        data = self._scaled(rows).withColumn("_index", index)
        self._model = LogisticRegression(featuresCol="_x", labelCol="_index", regParam=1 / (self._c * n), standardization=False, maxIter=self._max_iter, tol=self._tol, family="multinomial").fit(data)
        return self

    def _scaled(self, rows: DataFrame) -> DataFrame:
        mean, std = F.array(*map(F.lit, self._mean)), F.array(*map(F.lit, self._std))
        x = F.transform("features", lambda v, i: (v - F.get(mean, i)) / F.get(std, i))
        return rows.withColumn("_x", array_to_vector(x))

    def predict(self, rows: DataFrame) -> DataFrame:
        if self._model is None:
            raise ValueError("learner isn't fitted")
        out = self._model.transform(self._scaled(rows))
        return out.withColumn("predicted", F.get(F.array(*map(F.lit, self._labels)), F.col("prediction").cast("int"))).select(*rows.columns, "predicted")


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame, classes: int = 10) -> DataFrame:
    """(actual, predicted, n) for all pairs of classes, zeros too."""
    spark = predictions.sparkSession
    grid = spark.range(classes * classes).select(F.expr(f"cast(id div {classes} as int)").alias("actual"), (F.col("id") % classes).cast("int").alias("predicted"))
    n = predictions.groupBy(F.col("label").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
