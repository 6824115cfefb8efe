"""Fewer dimensions: principal components and F-test selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from netspark.ml.preprocess import Scaler


def to_matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Arrow list column to a dense matrix."""
    if not len(rows):
        return np.empty((0, width))
    return np.stack(rows.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class Projection:
    """Principal components of centred data; each component's largest entry is positive."""

    mean: list[float]
    components: list[list[float]]
    explained: list[float]

    @staticmethod
    def fit(
        df: DataFrame,
        features: str = "features",
        *,
        k: int | None = None,
        variance: float | None = None,
        center: list[float] | None = None,
    ) -> Projection:
        """Keep ``k`` components, or the fewest that explain more than ``variance``.

        The covariance is summed on the executors; only its d x d matrix is decomposed.
        """
        center = Scaler.fit(df, features).mean if center is None else center
        width = len(center)
        rows = df.select(array_to_vector(F.col(features)).alias("v"))
        fitted = PCA(k=width if variance is not None else min(k, width), inputCol="v", outputCol="p").fit(rows)
        explained = np.asarray(fitted.explainedVariance.toArray())
        parts = np.asarray(fitted.pc.toArray()).T
        if variance is not None:
            keep = int(np.searchsorted(np.cumsum(explained), variance, side="right")) + 1
            parts, explained = parts[:keep], explained[:keep]
        largest = np.argmax(np.abs(parts), axis=1)
        parts = parts * np.sign(parts[np.arange(len(parts)), largest])[:, None]
        return Projection(list(center), parts.tolist(), explained.tolist())

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        return (rows - np.asarray(self.mean)) @ np.asarray(self.components).T

    def column(self, features: Column) -> Column:
        @pandas_udf("array<double>")
        def project(values: pd.Series) -> pd.Series:
            return pd.Series(list(self.matrix(to_matrix(values, len(self.mean)))))

        return project(features)

    def columns(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add PC1, PC2, ..."""
        projected = df.withColumn("_p", self.column(F.col(features)))
        parts = {f"PC{i + 1}": F.col("_p")[i] for i in range(len(self.components))}
        return projected.withColumns(parts).drop("_p")


def f_statistics(df: DataFrame, *, features: str = "features", label: str = "label") -> DataFrame:
    """One-way ANOVA F per feature position, from per-class counts, means and variances.

    Infinite if the classes differ and no value within them does; null if all values are equal.
    """
    cells = (
        df.filter(F.col(label).isNotNull())
        .select(label, F.posexplode(features).alias("position", "x"))
        .groupBy("position", label)
        .agg(
            F.count("x").alias("n"),
            F.avg("x").alias("m"),
            F.var_pop("x").alias("v"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
    )
    # A row per feature and class: deviations of the class means lose no digits, as sums of squares would.
    feature = Window.partitionBy("position")
    mean = F.try_divide(F.sum(F.col("n") * F.col("m")).over(feature), F.sum("n").over(feature))
    apart = cells.withColumn("apart", F.col("m") - mean)
    sums = apart.groupBy("position").agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("n") > 0).alias("classes"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.col("apart") * F.col("apart")).alias("between"),
        (F.min("low") < F.max("high")).alias("varies"),
        F.bool_and(F.coalesce(F.col("low") == F.col("high"), F.lit(True))).alias("flat"),
    )
    between = F.try_divide("between", F.col("classes") - 1)
    within = F.when(F.col("flat"), 0.0).otherwise(F.try_divide("within", F.col("n") - F.col("classes")))
    # Classes without spread of their own: infinitely far apart, or nothing to tell.
    f = F.when(~F.col("varies"), F.lit(None)).when(within > 0, between / within).when(
        F.col("flat"), F.lit(float("inf"))
    )
    return sums.select("position", f.alias("f_value"))


def select_k_best(df: DataFrame, k: int, *, features: str = "features", label: str = "label"):
    """(positions, frame with only those features): the k largest F, in original order."""
    if df.select(label).dropna().distinct().limit(2).count() < 2:
        raise ValueError("feature selection needs at least two classes")
    best = (
        f_statistics(df, features=features, label=label)
        .filter(F.col("f_value").isNotNull())
        .orderBy(F.desc("f_value"), "position")
        .limit(k)
        .collect()
    )
    positions = sorted(row.position for row in best)
    return positions, df.withColumn(features, F.array(*[F.col(features)[i] for i in positions]))


def variance_parts(df: DataFrame, features: str = "features") -> DataFrame:
    """Variance (sample) per position; their sum is what components share out."""
    return (
        df.select(F.posexplode(features).alias("position", "x"))
        .groupBy("position")
        .agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))
    )
