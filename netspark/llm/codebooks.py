"""Codes of vectors by codebooks of their parts, trained with Lloyd rounds that compare active entries only.

All arithmetic is on integers, so results do not depend on order or partitions. Each row keeps, by part, its
entry and the exact squared distance to it. After an update of the codebook a part looks

* at the moved entries alone, if its own entry stayed: the kept distance still holds, and all other entries that
  stayed were no better before;
* at all entries, if its own entry moved.

Among equal distances the lower index stands in both cases, as in a complete comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm.workers import prepared
from netspark.session import cut_lineage, remove_folder, scratch_path

#: Integers of 64 bits hold squared distances below this one.
LARGEST = 1 << 62

STATE = "vec_id long, label string, parts binary, entries array<int>, distances array<long>"
RESULT = "vec_id long, label string, code string, error long"


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite components; squared distances of the rows must fit 64 bits."""
    scaled = np.floor(scale * vectors)
    largest = float(np.abs(scaled).max(initial=0.0))
    if vectors.shape[1] * (2 * largest) ** 2 >= LARGEST:
        raise ArithmeticError("squared distances of these vectors do not fit a long")
    return scaled.astype(np.int64)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to all entries."""
    bound = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if rows.shape[1] * (2 * bound) ** 2 < 1 << 53:  # float64 holds every term and every sum exactly
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(rows), len(entries)), np.int64)
    for k in range(rows.shape[1]):
        step = rows[:, k, None] - entries[None, :, k]
        out += step * step
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and its distance."""
    all_of = distances(rows, entries)
    best = all_of.argmin(axis=1)
    return best.astype(np.int32), all_of[np.arange(len(rows)), best]


def reassigned(
    rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, own: np.ndarray, kept: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries and distances after ``moved`` entries changed, and how many distances were computed."""
    if not len(moved):
        return own, kept, 0
    own, kept = own.copy(), kept.copy()
    is_moved = np.zeros(len(entries), bool)
    is_moved[moved] = True
    anew = is_moved[own]
    active = np.flatnonzero(~anew)
    if len(active):
        best, near = nearest(rows[active], entries[moved])
        best = moved[best].astype(np.int32)
        better = (near < kept[active]) | ((near == kept[active]) & (best < own[active]))
        own[active[better]], kept[active[better]] = best[better], near[better]
    whole = np.flatnonzero(anew)
    if len(whole):
        own[whole], kept[whole] = nearest(rows[whole], entries)
    return own, kept, len(active) * len(moved) + len(whole) * len(entries)


class Codebooks:
    """Integer codebooks, one per part: (parts, entries, width)."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale

    def sha256(self) -> str:
        """Of all decimal components by part, entry and place, joined by commas; lowercase hex."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _rows(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Integer parts of a batch of states: (rows, parts, width)."""
    flat = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i8")
    return flat.reshape(batch.num_rows, parts, -1)


def _lists(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _state(batch: pa.RecordBatch, rows: np.ndarray, entries: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, entries.size + 1, entries.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("vec_id"),
            batch.column("label"),
            pa.array([r.tobytes() for r in rows], pa.binary()),
            pa.ListArray.from_arrays(ends, pa.array(entries.ravel(), pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(kept.ravel(), pa.int64())),
        ],
        names=["vec_id", "label", "parts", "entries", "distances"],
    )


def _first_states(books: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _lists(batch.column("vector"), np.float64, batch.num_rows)
            rows = integers(vectors, scale).reshape(batch.num_rows, len(books), -1)
            found = [nearest(rows[:, p], books[p]) for p in range(len(books))]
            yield _state(batch, rows, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1))

    return run


def _next_states(books: np.ndarray, moved: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch, len(books))
            own = _lists(batch.column("entries"), np.int32, batch.num_rows)
            kept = _lists(batch.column("distances"), np.int64, batch.num_rows)
            found = [reassigned(rows[:, p], books[p], moved[p], own[:, p], kept[:, p]) for p in range(len(books))]
            yield _state(batch, rows, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1))

    return run


def _sums(shape: tuple[int, int, int]):
    """Count and component sums of the rows of each used entry, once per task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros(shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch, parts)
            own = _lists(batch.column("entries"), np.int32, batch.num_rows)
            for p in range(parts):
                counts[p] += np.bincount(own[:, p], minlength=entries)
                np.add.at(sums[p], own[:, p], rows[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(p.astype(np.int32)),
                pa.array(e.astype(np.int32)),
                pa.array(counts[p, e]),
                pa.array(list(sums[p, e]), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each used entry becomes floor(sum / count) of its rows; the others stay.

    Sums are added up by Spark; what reaches the driver is as large as the codebooks.
    """
    partial = state.select("parts", "entries").mapInArrow(_sums(books.shape), "part int, entry int, n long, sums array<long>")
    total = (
        partial.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    )
    out = books.copy()
    found = total.toArrow()
    part, entry, place, n, value = (found[c].to_numpy() for c in ("part", "entry", "place", "n", "value"))
    out[part, entry, place] = value // n  # integer division of numpy goes down
    return out


def train_and_encode(
    df: DataFrame,
    parts: int = 4,
    size: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors and the codebooks: (vec_id, label, code, error), Codebooks.

    Vectors become integers floor(scale * x), cut into ``parts`` equal consecutive parts. Codebooks start as the
    parts of the rows with the ``size`` smallest ids (ties: smaller vector, null ids last; all rows, if fewer).
    ``code`` holds the entry of each part in part order, two hex digits each, ``error`` the squared distances
    summed over parts, both for the final codebooks.

    Null vectors and those with null or non-finite components take no part. Repeated rows count as often as
    they stand there. An empty table gives empty codebooks and no rows. Lengths must be equal and a multiple of
    ``parts``, and squared distances must fit a long: else an error is raised. ``label`` is only carried along
    (as text; null without such a column); other columns are ignored.
    """
    if not 1 <= size <= 256:
        raise ValueError("an entry has two hex digits: size must be from 1 to 256")
    spark = prepared(df.sparkSession)
    kept = df.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        (F.lit(None) if label is None else F.col(label)).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(usable(F.col("vector")))
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(size).collect()
    if not first:
        return spark.createDataFrame([], RESULT), Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    width = len(first[0].vector)
    sizes = kept.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if sizes.low != sizes.high or width % parts:
        raise ValueError(f"vectors of {sizes.low} to {sizes.high} components cannot be cut into {parts} equal parts")
    start = integers(np.array([r.vector for r in first], np.float64).reshape(len(first), width), scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))

    path = _stored(kept.mapInArrow(_first_states(books, scale), STATE))
    for _ in range(rounds):
        state = spark.read.schema(STATE).parquet(path)
        after = _updated(state, books)
        moved = [np.flatnonzero((after[p] != books[p]).any(axis=1)) for p in range(parts)]
        books = after
        if any(len(m) for m in moved):
            before, path = path, _stored(state.mapInArrow(_next_states(books, moved), STATE))
            remove_folder(spark, before)
    state = spark.read.schema(STATE).parquet(path)
    code = F.array_join(F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda total, d: total + d)
    return state.select("vec_id", "label", code.alias("code"), error.alias("error")), Codebooks(books, scale)


def _stored(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "codes")
    df.write.parquet(path)
    return path


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors summed over rows of equal label, nulls together.

    Errors are summed before they meet the rows again, so a label of very many rows is one row there.
    """
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    sums = sums.withColumnRenamed("label", "sum_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("sum_label")), "left").drop("sum_label")


def codes(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of all usable rows (see ``train_and_encode``)."""
    coded, books = train_and_encode(df, **options)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))
