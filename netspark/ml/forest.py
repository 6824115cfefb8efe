"""Isolation forest (Liu, Ting and Zhou 2008), grown and scored on the executors.

All draws are counted, not taken from a generator: the MD5 of seed, tree and row id orders the rows of a sample,
the MD5 of seed, tree and node picks a node's feature and threshold. So a forest depends on nothing but the rows
and the seed, and any engine with MD5 can grow the same one level by level.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 100
SAMPLE_ROWS = 256
SEED = 42
AUTO_OFFSET = -0.5
#: Values of a draw: 13 hexadecimal digits, which a double holds exactly.
DRAWS = 1 << 52
_NODE = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_samples(
    df: DataFrame, *, trees: int, rows: int, seed: int, total: int, id_column: str = "id"
) -> DataFrame:
    """(tree, id, features): ``rows`` rows per tree, uniform and without repeats.

    One hash per row picks the rows that take part at all, about ``trees x rows`` of
    them; only those are tried against every tree. A wide margin on both thresholds
    leaves enough candidates, of which the smallest draws are kept. The same rows are
    chosen however the data is partitioned.
    """
    chance = min(1.0, (rows + 8.0 * math.sqrt(rows) + 32.0) / max(total, 1))
    taking_part = min(1.0, trees * chance)
    draw = lambda *parts: F.md5(F.concat_ws("-", F.lit(seed), *parts, F.col(id_column)))
    # Draws are compared as hexadecimal text, whose order is that of the numbers.
    limit = lambda share: F.lit(f"{min(int(share * DRAWS), DRAWS - 1):013x}g")
    candidates = (
        df.select(id_column, "features")
        .filter(draw() <= limit(taking_part))
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_draw", draw(F.col("tree")))
        .filter(F.col("_draw") <= limit(chance / taking_part))
    )
    order = Window.partitionBy("tree").orderBy("_draw", id_column)
    return (
        candidates.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= rows)
        .select("tree", id_column, "features")
    )


def node_draws(seed: int, tree: int, node: int) -> tuple[int, float]:
    """What picks the feature of a node, and where its threshold lies between 0 and 1."""
    digest = hashlib.md5(f"{seed}-{tree}-node-{node}".encode()).hexdigest()
    return int(digest[24:], 16), int(digest[:13], 16) / DRAWS


def _grow(matrix: np.ndarray, seed: int, tree: int, depth_limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path); a leaf has feature -1, node n the children 2n + 1 and 2n + 2."""
    nodes: list[tuple] = []
    stack = [(0, np.arange(len(matrix)), 0)]
    while stack:
        node, members, depth = stack.pop()
        part = matrix[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(members) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, node, node, depth + average_path(len(members))))
            continue
        pick, share = node_draws(seed, tree, node)
        feature = int(usable[pick % len(usable)])
        threshold = float(low[feature] + share * (high[feature] - low[feature]))
        if not threshold < high[feature]:  # rounded up: the highest row still goes right
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        left, right = 2 * node + 1, 2 * node + 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        stack.append((right, members[~goes_left], depth + 1))
        stack.append((left, members[goes_left], depth + 1))
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Flat node arrays, [tree, node]; small enough to travel in a task closure."""

    sample_rows: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    offset: float = AUTO_OFFSET

    @staticmethod
    def fit(
        df: DataFrame,
        *,
        prepare=None,
        trees: int = TREES,
        sample_rows: int = SAMPLE_ROWS,
        seed: int = SEED,
        id_column: str = "id",
    ) -> IsolationForest:
        """``prepare`` maps the raw matrix of a tree's sample (scaling, projection)."""
        total = df.count()
        if total == 0:
            raise ValueError("cannot grow a forest on no rows")
        rows = min(sample_rows, total)
        depth_limit = max(1, math.ceil(math.log2(max(rows, 2))))

        def grow(sample: pd.DataFrame) -> pd.DataFrame:
            tree = int(sample["tree"].iloc[0])
            sample = sample.sort_values(id_column)
            matrix = np.stack(sample["features"].to_numpy()).astype(np.float64)
            if prepare is not None:
                matrix = prepare(matrix)
            found = _grow(matrix, seed, tree, depth_limit)
            frame = pd.DataFrame(
                found, columns=["node", "feature", "threshold", "left", "right", "path"]
            )
            frame.insert(0, "tree", tree)
            return frame

        samples = tree_samples(
            df, trees=trees, rows=rows, seed=seed, total=total, id_column=id_column
        )
        nodes = samples.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
        return IsolationForest.from_nodes(nodes, rows)

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, sample_rows: int, offset: float = AUTO_OFFSET):
        """Arrays from the node table: at most trees x (2 x sample - 1) rows."""
        shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
        where = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())

        def filled(name, kind, default):
            table = np.full(shape, default, dtype=kind)
            table[where] = nodes[name].to_numpy()
            return table

        return IsolationForest(
            sample_rows,
            filled("feature", np.int32, -1),
            filled("threshold", np.float64, 0.0),
            filled("left", np.int32, 0),
            filled("right", np.int32, 0),
            filled("path", np.float64, 0.0),
            offset,
        )

    def nodes(self) -> pd.DataFrame:
        tree, node = np.indices(self.feature.shape)
        frame = pd.DataFrame({"tree": tree.ravel(), "node": node.ravel()})
        for name in ("feature", "threshold", "left", "right", "path"):
            frame[name] = getattr(self, name).ravel()
        return frame

    def with_offset(self, offset: float) -> IsolationForest:
        return IsolationForest(
            self.sample_rows, self.feature, self.threshold, self.left, self.right, self.path, offset
        )

    def raw_scores(self, matrix: np.ndarray) -> np.ndarray:
        """-2^(-E[h] / c(sample)); lower is more anomalous."""
        rows = np.arange(len(matrix))
        total = np.zeros(len(matrix))
        for tree in range(len(self.feature)):
            feature, threshold = self.feature[tree], self.threshold[tree]
            left, right = self.left[tree], self.right[tree]
            at = np.zeros(len(matrix), dtype=np.int32)
            while True:
                split = feature[at]
                inner = split >= 0
                if not inner.any():
                    break
                goes_left = matrix[rows, np.maximum(split, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += self.path[tree][at]
        scale = average_path(self.sample_rows) or 1.0
        return -np.power(2.0, -(total / len(self.feature)) / scale)

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        return self.raw_scores(matrix) - self.offset
