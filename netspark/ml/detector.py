"""The anomaly detector: scale, project, score; one of three models or their vote."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from netspark.ml.boundary import NU, Boundary, FourierMap
from netspark.ml.forest import IsolationForest
from netspark.ml.outlier_factor import OutlierFactor
from netspark.operators.metric_index import MetricIndex
from netspark.ml.preprocess import Scaler
from netspark.ml.reduce import Projection, to_matrix
from netspark.operators import ordering
from netspark.session import cut_lineage

FOREST, BOUNDARY, FACTOR, ENSEMBLE = "isolation_forest", "one_class_svm", "lof", "ensemble"
MODEL_TYPES = (FOREST, BOUNDARY, FACTOR, ENSEMBLE)
PCA_VARIANCE = 0.95


def contamination_offset(scored: DataFrame, score: str, contamination: float) -> float:
    """The training-score percentile below which rows count as anomalies."""
    return ordering.exact_quantiles(scored, score, [contamination])[0]


def vote(first, second, third):
    """Sign of the sum of three labels of 1 and -1."""
    return F.signum(first + second + third).cast("int")


@dataclass(frozen=True)
class AnomalyDetector:
    """A fitted detector. Build one with :meth:`fit`.

    Input frames have ``id`` (bigint) and ``features`` (array<double>); ``transform``
    adds ``anomaly_score`` (lower is worse), ``prediction`` (1 or -1) and ``is_anomaly``.
    """

    model_type: str
    scaler: Scaler
    projection: Projection | None
    forest: IsolationForest | None = None
    boundary: Boundary | None = None
    factor: OutlierFactor | None = None

    # --- fitting ----------------------------------------------------------------

    @staticmethod
    def fit(
        df: DataFrame,
        model_type: str = FOREST,
        *,
        use_pca: bool = True,
        pca_variance: float = PCA_VARIANCE,
        contamination: float | None = None,
        forest_options: dict | None = None,
        boundary_options: dict | None = None,
        factor_options: dict | None = None,
    ) -> AnomalyDetector:
        if model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type {model_type!r}")
        # Every step of the fit reads the rows, and what makes them may be costly.
        rows = cut_lineage(df.select("id", "features"))
        scaler = Scaler.fit(rows)
        projection = None
        if use_pca:
            scaled = rows.select(scaler.column(F.col("features")).alias("features"))
            zero = [0.0] * len(scaler.mean)
            projection = Projection.fit(scaled, variance=pca_variance, center=zero)
        detector = AnomalyDetector(model_type, scaler, projection)
        prepare = detector.prepare
        forest = boundary = factor = None
        if model_type in (FOREST, ENSEMBLE):
            forest = IsolationForest.fit(rows, prepare=prepare, **(forest_options or {}))
        if model_type != FOREST:
            # Read many times from here on, so the prepared rows are written once.
            vectors = cut_lineage(detector._vectors(rows))
        if model_type in (BOUNDARY, ENSEMBLE):
            options = dict(boundary_options or {})
            options.setdefault("nu", NU if contamination is None else contamination)
            boundary = Boundary.fit(vectors.withColumnRenamed("vector", "features"), **options)
        if model_type in (FACTOR, ENSEMBLE):
            factor = OutlierFactor.fit(vectors, **(factor_options or {}))
        detector = replace(detector, forest=forest, boundary=boundary, factor=factor)
        if contamination is not None:
            detector = detector._with_contamination(rows, contamination)
        return detector

    def _with_contamination(self, rows: DataFrame, contamination: float) -> AnomalyDetector:
        forest, factor = self.forest, self.factor
        if forest is not None:
            raw = self._matrix_scores({"s": forest.raw_scores})
            scored = cut_lineage(rows.select(raw("features")["s"].alias("s")))
            forest = forest.with_offset(contamination_offset(scored, "s", contamination))
        if factor is not None:
            factor = factor.with_offset(contamination_offset(factor.known, "raw", contamination))
        return replace(self, forest=forest, factor=factor)

    # --- scoring ----------------------------------------------------------------

    def prepare(self, matrix: np.ndarray) -> np.ndarray:
        scaled = self.scaler.matrix(matrix)
        return scaled if self.projection is None else self.projection.matrix(scaled)

    def _matrix_scores(self, models: dict):
        """One Arrow pass that prepares the rows once and scores them with every model."""
        width = len(self.scaler.mean)
        prepare = AnomalyDetector(self.model_type, self.scaler, self.projection).prepare
        fields = ", ".join(f"{name} double" for name in models)

        @pandas_udf(f"struct<{fields.replace(' double', ':double')}>")
        def score(values: pd.Series) -> pd.DataFrame:
            rows = prepare(to_matrix(values, width)) if len(values) else np.empty((0, 1))
            return pd.DataFrame({name: model(rows) for name, model in models.items()})

        return score

    def _vectors(self, df: DataFrame) -> DataFrame:
        width = len(self.scaler.mean)
        prepare = AnomalyDetector(self.model_type, self.scaler, self.projection).prepare

        @pandas_udf("array<double>")
        def project(values: pd.Series) -> pd.Series:
            return pd.Series(list(prepare(to_matrix(values, width))))

        return df.select("id", project("features").alias("vector"))

    def component_scores(self, df: DataFrame) -> DataFrame:
        """``df`` with one ``score_<model>`` column per fitted model."""
        models = {}
        if self.forest is not None:
            models[f"score_{FOREST}"] = self.forest.scores
        if self.boundary is not None:
            models[f"score_{BOUNDARY}"] = self.boundary.scores
        result = df
        if models:
            score = self._matrix_scores(models)
            result = result.withColumn("_s", score("features")).select(
                *df.columns, *[F.col(f"_s.{name}").alias(name) for name in models]
            )
        if self.factor is not None:
            found = self.factor.scores(self._vectors(df))
            result = result.join(
                found.withColumnRenamed("score", f"score_{FACTOR}"), "id", "left"
            )
        return result

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.component_scores(df)
        label = lambda c: F.when(F.col(c) < 0, -1).otherwise(1)
        if self.model_type == ENSEMBLE:
            names = [f"score_{m}" for m in (FOREST, BOUNDARY, FACTOR)]
            score = (F.col(names[0]) + F.col(names[1]) + F.col(names[2])) / 3
            prediction = vote(*[label(n) for n in names])
        else:
            names = [f"score_{self.model_type}"]
            score, prediction = F.col(names[0]), label(names[0])
        return (
            scored.withColumn("anomaly_score", score)
            .withColumn("prediction", prediction)
            .drop(*names)
            .withColumn("is_anomaly", F.col("prediction") == -1)
        )

    # --- persistence --------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters as JSON, trees and neighbour tables as parquet, below ``path``."""
        settings = {
            "model_type": self.model_type,
            "scaler": vars(self.scaler),
            "projection": None if self.projection is None else vars(self.projection),
            "forest": None,
            "boundary": None,
            "factor": None,
        }
        if self.forest is not None:
            settings["forest"] = {"sample_rows": self.forest.sample_rows, "offset": self.forest.offset}
            nodes = spark.createDataFrame(self.forest.nodes())
            nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
        if self.boundary is not None:
            settings["boundary"] = {
                "weights": self.boundary.fourier.weights.tolist(),
                "phase": self.boundary.fourier.phase.tolist(),
                "normal": self.boundary.normal.tolist(),
                "rho": self.boundary.rho,
                "scale": self.boundary.scale,
            }
        if self.factor is not None:
            settings["factor"] = {"k": self.factor.k, "offset": self.factor.offset}
            self.factor.index.cells.write.mode("overwrite").parquet(f"{path}/factor_cells")
            settings["factor"]["pivots"] = self.factor.index.bounds.pivots.tolist()
            self.factor.known.write.mode("overwrite").parquet(f"{path}/factor_known")
        text = spark.createDataFrame([(json.dumps(settings),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> AnomalyDetector:
        settings = json.loads(spark.read.text(f"{path}/settings").first().value)
        projection = settings["projection"]
        detector = AnomalyDetector(
            settings["model_type"],
            Scaler(**settings["scaler"]),
            None if projection is None else Projection(**projection),
        )
        if settings["forest"]:
            nodes = spark.read.parquet(f"{path}/forest").toPandas()
            forest = IsolationForest.from_nodes(nodes, **settings["forest"])
            detector = replace(detector, forest=forest)
        if settings["boundary"]:
            b = settings["boundary"]
            fourier = FourierMap(np.asarray(b["weights"]), np.asarray(b["phase"]))
            boundary = Boundary(fourier, np.asarray(b["normal"]), b["rho"], b["scale"])
            detector = replace(detector, boundary=boundary)
        if settings["factor"]:
            f = settings["factor"]
            pivots = np.asarray(f["pivots"], np.float64)
            cells = spark.read.parquet(f"{path}/factor_cells")
            index = MetricIndex.of_cells(cells, pivots, neighbours=f["k"] + 1)
            factor = OutlierFactor(index, spark.read.parquet(f"{path}/factor_known"), f["k"], f["offset"])
            detector = replace(detector, factor=factor)
        return detector


def hash_split(df: DataFrame, *, id_column: str = "id", test_percent: int = 20, seed: int = 42):
    """(train, test): the same rows on every run and for every partitioning.

    The bucket is the start of the MD5 of id and seed as text, which other engines compute as well.
    """
    digest = F.md5(F.concat_ws("-", F.col(id_column).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % 100
    return df.filter(bucket >= test_percent), df.filter(bucket < test_percent)


