"""Quality of documents by naive Bayes support vectors.

Features are indicators of n-grams, hashed to buckets: of lower-case words, of word shapes, and of how far
back each word occurred before. An indicator is scaled by the log ratio of its share in the two classes,
counted over all labelled rows for learning; a linear hinge-loss model on the scaled indicators is fitted by
dual coordinate descent on a bounded sample of them. Its margins become scores through a sigmoid that is
fitted on a fifth of the sample kept back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.shingles import mixed
from netspark.llm.workers import prepared, worker_state
from netspark.session import cut_lineage

BUCKETS = 1 << 18
#: Labelled rows that the hinge-loss model is fitted on, chosen by a hash of their id.
SAMPLE_ROWS = 8000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
FIT_SEED = 7
CACHE_TOKENS = 300_000

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """Runs of digits as 9, of capitals as A, of other letters as a; everything else stays, shortened."""
    text = _UPPER.sub("\x01", _DIGIT.sub("\x02", token))
    return _LOWER.sub("a", text).replace("\x01", "A").replace("\x02", "9")[:12]


class TokenFeatures(dict):
    """A number for each token as it is written; by number the hashes of its word and its shape."""

    def __init__(self):
        super().__init__()
        self.words, self.shapes = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        if number == len(self.words):
            self.words, self.shapes = (np.concatenate((x, x)) for x in (self.words, self.shapes))
        self.words[number] = xxhash.xxh3_64_intdigest(token.strip(".,;:!?").lower().encode("utf-8", "surrogatepass"))
        self.shapes[number] = xxhash.xxh3_64_intdigest(shape(token).encode("utf-8", "surrogatepass"))
        return number


def _grams(values: np.ndarray, longest: int, view: int) -> np.ndarray:
    """Distinct hashed 1- to ``longest``-grams of a stream of hashes, as buckets of that view."""
    found = []
    total = values
    for n in range(1, longest + 1):
        if n > 1:
            if len(values) < n:
                break
            total = total[:-1] * _STEP + values[n - 1 :]
        found.append(mixed(total + np.uint64(view << 8 | n)))
    joined = np.concatenate(found) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.unique(joined.astype(np.int32))


def features(text: str | None) -> list[np.ndarray]:
    """Buckets of each view of a text: words, shapes, distances. None of a text without tokens."""
    tokens = text.split() if text else []
    if not tokens:
        return []
    known = worker_state("quality tokens", TokenFeatures)
    if len(known) > CACHE_TOKENS:
        known.clear()
    at = np.array(list(map(known.__getitem__, tokens)))
    order = np.argsort(at, kind="stable")
    back = np.zeros(len(at), np.int64)
    same = at[order[1:]] == at[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    # How far back: 1, 2, ... 8 words; up to 64; further; never.
    back = np.where(back > 64, 10, np.where(back > 8, 9, back)).astype(np.uint64)
    return [_grams(known.words[at], 1, 1), _grams(known.shapes[at], 3, 2), _grams(back + np.uint64(1), 3, 3)]


@dataclass(frozen=True)
class QualityModel:
    """Weights of buckets (log ratios included), bias, and the sigmoid of a margin."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, views: list[np.ndarray]) -> float:
        buckets, values = scaled(views, self.ratios)
        return float(values @ self.weights[buckets]) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scaled(views: list[np.ndarray], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their scaled indicators, of unit length in each view."""
    values = []
    for own in views:
        value = ratios[own]
        length = np.sqrt(value @ value)
        values.append(value / length if length else value)
    if not values:
        return np.empty(0, np.int32), np.empty(0)
    return np.concatenate(views), np.concatenate(values)


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of least w.w/2 + COST * sum of hinge losses, by coordinate descent on the dual.

    Each dual variable, between 0 and COST, is set to its best value while the others stay; the weights follow.
    """
    weights, bias = np.zeros(BUCKETS), 0.0
    duals = np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1 for _, v in rows])
    random = np.random.default_rng(FIT_SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for k in random.permutation(len(rows)).tolist():
            buckets, values = rows[k]
            y = labels[k]
            slope = y * (float(values @ weights[buckets]) + bias) - 1
            new = min(max(duals[k] - slope / squares[k], 0.0), COST)
            step = (new - duals[k]) * y
            if step:
                np.add.at(weights, buckets, step * values)
                bias += step
                duals[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on margins, by Newton steps with a little damping."""
    good = float((labels > 0).sum())
    goal = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    x = np.stack((margins, np.ones_like(margins)))
    beta = np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, x @ (p - goal) + 1e-3 * (beta - [2.0, 0.0]))
    return max(float(beta[0]), 0.05), float(beta[1])


_FEATURE_SCHEMA = "pick double, good boolean, sizes array<int>, buckets array<int>"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column("text")]
        sizes = [[len(v) for v in views] for views in found]
        buckets = [np.concatenate(views) if views else np.empty(0, np.int32) for views in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("pick"),
                batch.column("good"),
                pa.array(sizes, pa.list_(pa.int32())),
                pa.array(buckets, pa.list_(pa.int32())),
            ],
            names=["pick", "good", "sizes", "buckets"],
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that have a bucket, summed within the task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        buckets = batch.column("buckets")
        for k in range(batch.num_rows):
            counts[int(good[k])][buckets[k].values.to_numpy()] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some])],
        names=["bucket", "bad", "good"],
    )


def _fitting(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("pick")  # SAMPLE_ROWS rows or a few more
        rows = []
        for sizes, buckets in zip(table["sizes"].to_pylist(), table["buckets"]):
            own = buckets.values.to_numpy()
            rows.append(scaled(np.split(own, np.cumsum(sizes)[:-1]) if sizes else [], ratios))
        labels = np.where(table["good"].to_numpy(), 1.0, -1.0)
        kept = np.arange(len(rows)) % 5 == 4
        weights, bias = fit_hinge([r for r, k in zip(rows, kept) if not k], labels[~kept])
        margins = np.array([float(v @ weights[b]) + bias for (b, v), k in zip(rows, kept) if k])
        slope, shift = fit_sigmoid(margins, labels[kept]) if kept.any() else (2.0, 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), *(pa.array([x]) for x in (bias, slope, shift))],
            names=["weights", "bias", "slope", "shift"],
        )

    return run


def majority_labels(labels: DataFrame) -> DataFrame:
    """doc_id and ``good``: the label that most rows of the id have. Ids with a tie or without a label are out."""
    rate = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("r"))
    return rate.where("r <> 0.5").select(F.col("doc_id").cast("long").alias("_label_id"), (F.col("r") > 0.5).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from ``labels`` (doc_id, quality) on the texts of ``docs`` (doc_id, text) where ``learn`` holds.

    Only ``text`` becomes features. Without rows of both classes the model knows nothing: all scores are 0.5.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.where(learn).select(F.col("doc_id").cast("long").alias("_label_id"), "text")
    # Labels grow with the corpus: the same plan at every size.
    labelled = texts.join(majority_labels(labels).hint("merge"), "_label_id").select(
        (F.xxhash64("_label_id", "text").cast("double") / 2.0**64 + 0.5).alias("pick"), "good", "text"
    )
    rows = cut_lineage(labelled.mapInArrow(_featured, _FEATURE_SCHEMA))
    sizes = {r.good: r.n for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return QualityModel(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    counts = rows.select("good", "buckets").mapInArrow(_counted, "bucket int, bad long, good long")
    summed = counts.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    table = summed.toArrow()  # a row per bucket at most
    share = np.full((2, BUCKETS), SMOOTHING)
    for k, name in enumerate(("bad", "good")):
        share[k][table["bucket"].to_numpy()] += table[name].to_numpy()
        share[k] /= sizes[bool(k)] + 2 * SMOOTHING
    ratios = np.log(share[1] / share[0])
    chosen = rows.where(F.col("pick") < min(1.0, sample_rows / sum(sizes.values())))
    found = chosen.repartition(1).mapInArrow(
        _fitting(ratios), "weights binary, bias double, slope double, shift double"
    ).first()
    return QualityModel(ratios, np.frombuffer(bytes(found.weights)), found.bias, found.slope, found.shift)


def with_scores(
    docs: DataFrame, model: QualityModel, with_text: bool = True, output: str = "score"
) -> DataFrame:
    """``docs`` with a column ``output`` (0 to 1, higher is better) of each whole text; null texts count as empty.

    Other columns are kept (``text`` unless asked otherwise); one named like ``output`` is replaced.
    """
    spark = prepared(docs.sparkSession)
    # BUCKETS numbers, twice; as plain values, which a worker reads without this package.
    shared = spark.sparkContext.broadcast((model.ratios, model.weights, model.bias, model.slope, model.shift))
    out = [c for c in docs.columns if c != output and (with_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = QualityModel(*shared.value)
        for batch in batches:
            scores = [known.score(t.as_py()) for t in batch.column("text")]
            columns = [batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*out, output])

    schema = docs.select(*out).withColumn(output, F.lit(0.0)).schema
    return docs.select(*out, *([] if with_text else ["text"])).mapInArrow(run, schema)


def learnable() -> Column:
    """Rows that labels may be learned from: the CRC-32 of doc_id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) != 1
