"""One-class boundary with a Gaussian kernel, at a cost linear in the rows.

The kernel is replaced by random Fourier features (Rahimi and Recht 2007); the dual
of the one-class machine is then solved by Frank-Wolfe steps. A step needs the mean
feature vector of the share ``nu`` of rows with the lowest margins, which is a sum
per margin bin: one pass over the data and a few kilobytes per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from netspark.ml.reduce import to_matrix
from netspark.operators import ordering
from netspark.session import cut_lineage

NU = 0.01
FEATURES = 128
STEPS = 20
BINS = 64
SEED = 42
_EDGE = 1.5


@dataclass(frozen=True)
class FourierMap:
    weights: np.ndarray
    phase: np.ndarray

    @staticmethod
    def draw(width: int, gamma: float, *, features: int = FEATURES, seed: int = SEED) -> FourierMap:
        generator = np.random.default_rng(seed)
        weights = generator.normal(scale=np.sqrt(2.0 * gamma), size=(width, features))
        return FourierMap(weights, generator.uniform(0.0, 2.0 * np.pi, size=features))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phase)) * np.cos(rows @ self.weights + self.phase)


@dataclass(frozen=True)
class Boundary:
    """Score = scale * (margin - rho); below 0 is outside.

    The scale is nu * rows, the sum of the dual weights in their usual form.
    """

    fourier: FourierMap
    normal: np.ndarray
    rho: float
    scale: float = 1.0

    @staticmethod
    def fit(
        df: DataFrame,
        *,
        prepare=None,
        nu: float = NU,
        features: int = FEATURES,
        steps: int = STEPS,
        seed: int = SEED,
    ) -> Boundary:
        prepare = prepare or (lambda rows: rows)
        total, width, variance = _spread(df, prepare)
        if total == 0:
            raise ValueError("cannot fit a boundary on no rows")
        fourier = FourierMap.draw(width, 1.0 / (width * (variance or 1.0)), features=features, seed=seed)
        _, sums = _bin_sums(df, prepare, fourier, np.zeros(features))
        normal = sums.sum(axis=0) / total
        for _ in range(steps):
            counts, sums = _bin_sums(df, prepare, fourier, normal)
            target = _lowest_mean(counts, sums, nu * total)
            move = normal - target
            length = float(move @ move)
            if length < 1e-12:
                break
            step = min(1.0, max(0.0, float(normal @ move) / length))
            if step == 0.0:
                break
            normal = normal - step * move

        @pandas_udf("double")
        def margin(values: pd.Series) -> pd.Series:
            return pd.Series(fourier(prepare(to_matrix(values, width))) @ normal)

        margins = cut_lineage(df.select(margin("features").alias("m")))
        rho = ordering.exact_quantiles(margins, "m", [nu])[0]
        return Boundary(fourier, normal, rho, nu * total)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        return self.scale * (self.fourier(matrix) @ self.normal - self.rho)


def _spread(df: DataFrame, prepare) -> tuple[int, int, float]:
    """Rows, dimensions and overall variance of the prepared matrix, in one pass."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = prepare(np.stack(batch["features"].to_numpy()).astype(np.float64))
                yield pd.DataFrame(
                    [(len(rows), rows.shape[1], float(rows.sum()), float((rows * rows).sum()))],
                    columns=["n", "w", "s", "q"],
                )

    row = (
        df.select("features")
        .mapInPandas(partial, "n bigint, w int, s double, q double")
        .agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        .first()
    )
    if not row.n:
        return 0, 0, 0.0
    cells = row.n * row.w
    return row.n, row.w, row.q / cells - (row.s / cells) ** 2


def _bin_sums(df: DataFrame, prepare, fourier: FourierMap, normal: np.ndarray):
    """Rows and summed feature vectors per margin bin, over the whole input."""
    width = len(normal)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(BINS), np.zeros((BINS, width))
        for batch in batches:
            if len(batch):
                z = fourier(prepare(np.stack(batch["features"].to_numpy()).astype(np.float64)))
                place = (z @ normal + _EDGE) / (2.0 * _EDGE) * BINS
                index = np.clip(place.astype(int), 0, BINS - 1)
                counts += np.bincount(index, minlength=BINS)
                np.add.at(sums, index, z)
        used = np.flatnonzero(counts)
        if len(used):
            yield pd.DataFrame({"bin": used, "n": counts[used], "total": list(sums[used])})

    parts = df.select("features").mapInPandas(partial, "bin int, n double, total array<double>")
    rows = (
        parts.groupBy("bin")
        .agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"),
        )
        .collect()  # at most BINS rows
    )
    counts, sums = np.zeros(BINS), np.zeros((BINS, width))
    for row in rows:
        counts[row.bin], sums[row.bin] = row.n, row.total
    return counts, sums


def _lowest_mean(counts: np.ndarray, sums: np.ndarray, wanted: float) -> np.ndarray:
    """Mean vector of the ``wanted`` rows in the lowest bins, the last one in part."""
    wanted = max(1.0, wanted)
    taken, total = 0.0, np.zeros(sums.shape[1])
    for count, vector in zip(counts, sums):
        if count == 0:
            continue
        share = min(1.0, (wanted - taken) / count)
        taken, total = taken + share * count, total + share * vector
        if taken >= wanted:
            break
    return total / max(taken, 1.0)
