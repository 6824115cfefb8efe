"""Anomalies in runs of packets: how badly a linear autoencoder rebuilds the run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from netspark.ml.features import feature_array
from netspark.ml.preprocess import Scaler
from netspark.ml.reduce import Projection
from netspark.operators import ordering
from netspark.session import cut_lineage

LENGTH = 10
ENCODING = 8
QUANTILE = 0.95


def scaled_sequences(
    packets: DataFrame, scaler: Scaler, features: list[str], *, length: int, entity: str
) -> DataFrame:
    """(packet_id, flat): the scaled run that ends at each packet, as one array."""
    rows = packets.filter(F.col(entity).isNotNull()).select(
        "packet_id", entity, "timestamp", scaler.column(feature_array(features)).alias("x")
    )
    history = ordering.with_history(
        rows, [entity], "timestamp", ["x"], length, "_h", tie="packet_id"
    )
    flat = F.flatten(F.transform("_h", lambda item: item["x"]))
    return history.filter(F.size("_h") == length).select("packet_id", flat.alias("flat"))


@dataclass(frozen=True)
class SequenceDetector:
    """Runs of one source; a run is judged at its last packet."""

    features: list[str]
    scaler: Scaler
    projection: Projection
    threshold: float
    length: int = LENGTH
    entity: str = "src_ip"

    @staticmethod
    def fit(
        packets: DataFrame,
        features: list[str],
        *,
        length: int = LENGTH,
        encoding: int = ENCODING,
        quantile: float = QUANTILE,
        entity: str = "src_ip",
    ) -> SequenceDetector:
        return SequenceDetector._fit(packets, features, length, encoding, quantile, entity)[0]

    @staticmethod
    def fit_transform(
        packets: DataFrame,
        features: list[str],
        *,
        length: int = LENGTH,
        encoding: int = ENCODING,
        quantile: float = QUANTILE,
        entity: str = "src_ip",
    ) -> tuple[SequenceDetector, DataFrame]:
        """The detector and its own packets judged, from the errors that gave the threshold: runs are built once."""
        detector, errors = SequenceDetector._fit(packets, features, length, encoding, quantile, entity)
        return detector, detector._judged(packets, errors)

    @staticmethod
    def _fit(packets, features, length, encoding, quantile, entity) -> tuple[SequenceDetector, DataFrame]:
        scaler = Scaler.fit(packets.select(feature_array(features).alias("features")))
        # Read by two fits and the threshold, so the shuffled runs are written once.
        runs = cut_lineage(
            scaled_sequences(packets, scaler, features, length=length, entity=entity)
        )
        projection = Projection.fit(runs, "flat", k=encoding)
        detector = SequenceDetector(features, scaler, projection, 0.0, length, entity)
        errors = cut_lineage(runs.select("packet_id", detector._error()("flat").alias("_error")))
        limit = ordering.exact_quantiles(errors.withColumnRenamed("_error", "e"), "e", [quantile])[0]
        return SequenceDetector(features, scaler, projection, limit, length, entity), errors

    def _error(self):
        mean = np.asarray(self.projection.mean)
        parts = np.asarray(self.projection.components)

        @pandas_udf("double")
        def error(flat: pd.Series) -> pd.Series:
            if not len(flat):
                return pd.Series([], dtype="float64")
            rows = np.stack(flat.to_numpy()) - mean
            rest = rows - rows @ parts.T @ parts
            return pd.Series((rest * rest).mean(axis=1))

        return error

    def transform(self, packets: DataFrame) -> DataFrame:
        """Every packet; one without a whole run before it is normal with score 0."""
        runs = scaled_sequences(
            packets, self.scaler, self.features, length=self.length, entity=self.entity
        )
        return self._judged(packets, runs.select("packet_id", self._error()("flat").alias("_error")))

    def _judged(self, packets: DataFrame, errors: DataFrame) -> DataFrame:
        bad = F.coalesce(F.col("_error") > self.threshold, F.lit(False))
        return (
            packets.join(errors, "packet_id", "left")
            .withColumn("anomaly_score", F.coalesce(-F.col("_error"), F.lit(0.0)))
            .withColumn("prediction", F.when(bad, -1).otherwise(1))
            .drop("_error")
        )
