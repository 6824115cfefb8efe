"""Impute, scale and encode packet columns; fitted once, applied anywhere."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.ml.features import NOT_FEATURES, numeric_columns
from netspark.operators import ordering

UNKNOWN = "unknown"


def string_columns(df: DataFrame, *, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    left_out = set(exclude)
    return [name for name, kind in df.dtypes if kind == "string" and name not in left_out]


def numeric_statistics(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(median, mean, population deviation) per column, the last two after imputing.

    A column without spread gets the scale 1.
    """
    medians = ordering.exact_column_quantiles(df, columns, 0.5)
    medians = {c: 0.0 if m is None else m for c, m in medians.items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns}
    row = df.agg(
        *[F.avg(filled[c]).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (medians[c], row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def fit_preprocessor(
    df: DataFrame,
    *,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    output: str = "features",
    hashed: int | None = None,
) -> PipelineModel:
    """Median impute and standardise numbers; impute ``unknown`` and one-hot encode strings.

    Labels and addresses are left out. An unseen string encodes as all zeros. One-hot
    encoding keeps a list of all values of a column; for columns with very many, leave
    them out of ``categorical`` or give ``hashed``, the positions that each string column
    is hashed to instead. The result is an ordinary PipelineModel, so it is saved and loaded like any other.
    """
    numeric = numeric_columns(df) if numeric is None else numeric
    categorical = string_columns(df) if categorical is None else categorical
    statistics = numeric_statistics(df, numeric) if numeric else {}
    expressions = [
        f"(coalesce(cast(`{c}` as double), {median!r}D) - {mean!r}D) / {scale!r}D AS `_n_{c}`"
        for c, (median, mean, scale) in statistics.items()
    ] + [f"coalesce(`{c}`, '{UNKNOWN}') AS `_s_{c}`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")]
    if categorical and hashed:
        stages += [FeatureHasher(inputCols=[f"_s_{c}"], outputCol=f"_e_{c}", numFeatures=hashed) for c in categorical]
    elif categorical:
        stages.append(
            StringIndexer(
                inputCols=[f"_s_{c}" for c in categorical],
                outputCols=[f"_i_{c}" for c in categorical],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        # The last index is that of unseen values; dropping it makes them all zeros.
        stages.append(
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in categorical],
                outputCols=[f"_e_{c}" for c in categorical],
                dropLast=True,
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[f"_n_{c}" for c in numeric] + [f"_e_{c}" for c in categorical],
            outputCol=output,
        )
    )
    return Pipeline(stages=stages).fit(df)


def apply_preprocessor(model: PipelineModel, df: DataFrame, *, output: str = "features") -> DataFrame:
    """Add the feature array and drop the working columns."""
    done = model.transform(df)
    working = [c for c in done.columns if c[:3] in ("_n_", "_s_", "_i_", "_e_")]
    return done.withColumn(output, vector_to_array(output)).drop(*working)


@dataclass(frozen=True)
class Scaler:
    """Z-score with the population deviation; a constant dimension keeps scale 1."""

    mean: list[float]
    scale: list[float]

    @staticmethod
    def fit(df: DataFrame, features: str = "features") -> Scaler:
        vector = array_to_vector(F.col(features))
        row = (
            df.select(vector.alias("v"))
            .agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
            .first()
            .s
        )
        correction = (row["count"] - 1) / row["count"] if row["count"] else 1.0
        deviation = np.sqrt(np.asarray(row["variance"].toArray()) * correction)
        return Scaler(
            row["mean"].toArray().tolist(), np.where(deviation == 0, 1.0, deviation).tolist()
        )

    def column(self, features: Column) -> Column:
        """Scaled array as a built-in expression."""
        literal = lambda values: F.array(*[F.lit(v) for v in values])
        centred = F.zip_with(features, literal(self.mean), lambda x, m: x - m)
        return F.zip_with(centred, literal(self.scale), lambda x, s: x / s)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        return (rows - np.asarray(self.mean)) / np.asarray(self.scale)
