"""Nearest vectors by cosine: a block matrix join of int8 tiles, exact after a second look.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own, u = s c + e. For two of them

    | u.v - s t c.d | <= |e| + |f| + |e| |f|

so a tile of integer products bounds all its cosines from both sides. Per query the k-th largest lower bound is
a threshold; pairs whose upper bound reaches it survive and are computed again from the original vectors in
double precision. Each tile gives the k best of each query, and heaps merge the tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.workers import prepared
from netspark.session import cut_lineage

#: Queries and candidates of a tile, on average.
QUERY_BLOCK, CANDIDATE_BLOCK = 2000, 8000
#: Candidates whose products with all queries of a tile are held at once.
STRIP = 2048
#: For rounding in the bounds themselves.
SLACK = 1e-6

RESULT_SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Neither null, zero nor with null or non-finite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit vectors (int8 values as float32), their scales and the lengths of what rounding lost."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, lost


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows: as float32 matrices, exact while dim * 127^2 stays below 2^24."""
    exact = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return left.astype(exact) @ right.astype(exact).T


def cosines(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values wherever they stand."""
    dots = (others * query).sum(axis=1)
    return dots / (np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(axis=1)))


def _first_of_equals(ids: np.ndarray, vectors: np.ndarray, kept: int) -> np.ndarray:
    """Places of the ``kept`` smallest ids of each group of equal vectors: all others lose every tie to them."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order]).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    begins = np.concatenate(([0], np.flatnonzero(np.diff(sorted_group)) + 1))
    rank = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    return order[by_group[rank < kept]]


def best_of_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best candidates of the tile as (-score, id), best first."""
    few = _first_of_equals(ids, vectors, k + 1)
    ids, vectors = ids[few], vectors[few]
    unit_q = queries / np.linalg.norm(queries, axis=1)[:, None]
    unit_v = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    codes_q, scale_q, lost_q = quantised(unit_q)
    codes_v, scale_v, lost_v = quantised(unit_v)
    threshold = np.full((len(queries), k), -np.inf)
    strips = []
    for at in range(0, len(ids), STRIP):
        part = slice(at, at + STRIP)
        near = products(codes_q, codes_v[part]) * (scale_q[:, None] * scale_v[part])
        error = lost_q[:, None] + lost_v[part] + lost_q[:, None] * lost_v[part] + SLACK
        own = query_ids[:, None] == ids[part]
        lower = np.where(own, -np.inf, near - error)
        both = np.concatenate((threshold, lower), axis=1)
        threshold = -np.partition(-both, k - 1, axis=1)[:, :k]
        # Later strips only raise the threshold, so what fails now fails for good.
        rows, columns = np.nonzero((near + error >= threshold.min(axis=1)[:, None]) & ~own)
        strips.append((rows, columns + at, (near + error)[rows, columns]))
    rows, columns, upper = (np.concatenate(x) for x in zip(*strips))
    alive = upper >= threshold.min(axis=1)[rows]
    rows, columns = rows[alive], columns[alive]
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], columns[order]
    bounds = np.searchsorted(rows, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        chosen = columns[bounds[q] : bounds[q + 1]]
        if len(chosen):
            exact = cosines(queries[q], vectors[chosen])
            pairs = zip((-exact).tolist(), ids[chosen].tolist())
            yield int(query_ids[q]), heapq.nsmallest(k, pairs)


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if queries.num_rows and candidates.num_rows:
            # Vectors of unequal length are not comparable; each length is a tile of its own.
            sizes_q, sizes_v = (np.array([len(v) for v in t["vector"]]) for t in (queries, candidates))
            for size in np.unique(sizes_q):
                some_q, some_v = np.flatnonzero(sizes_q == size), np.flatnonzero(sizes_v == size)
                if not len(some_v):
                    continue
                ids_q, vectors_q = _matrix(queries, some_q, int(size))
                ids_v, vectors_v = _matrix(candidates, some_v, int(size))
                for query_id, best in best_of_tile(ids_q, vectors_q, ids_v, vectors_v, k):
                    out += [(query_id, vec_id, -score) for score, vec_id in best]
        return pa.table(
            {
                "query_id": pa.array([r[0] for r in out], pa.int64()),
                "vec_id": pa.array([r[1] for r in out], pa.int64()),
                "score": pa.array([r[2] for r in out], pa.float64()),
            }
        )

    return run


def _matrix(table: pa.Table, some: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    part = table.take(pa.array(some)).combine_chunks()
    flat = part["vector"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return part["vec_id"].to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _merge(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # k entries for each query of this partition.
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query_id, vec_id, score in zip(batch.query_id.tolist(), batch.vec_id.tolist(), batch.score.tolist()):
                heap = heaps.setdefault(query_id, [])
                entry = (score, -vec_id)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        rows = [
            (query_id, rank, -negative, score)
            for query_id, heap in heaps.items()
            for rank, (score, negative) in enumerate(sorted(heap, reverse=True), 1)
        ]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row where ``is_query`` holds: query_id, rank, vec_id, score.

    Score is the cosine of the original vectors in double precision; the nearest comes first, ties go to the
    smaller id, fewer candidates give fewer rows. Unusable vectors (see ``usable``) and rows without id take
    no part. Rows of one id are one row: equal ones count once, of unequal ones the smallest vector. A query
    is never its own candidate; vectors of other lengths are no candidates. Other columns are ignored.
    """
    prepared(df.sparkSession)
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    asking = rows.where("asks").select("vec_id", "vector")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).first()
    query_blocks = max(1, -(-counts.asking // QUERY_BLOCK))
    blocks = max(1, -(-counts.n // CANDIDATE_BLOCK))
    place = F.xxhash64("vec_id")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asking.select("vec_id", "vector", F.pmod(place, F.lit(query_blocks)).cast("int").alias("q"), every(blocks, "c"))
    right = rows.select("vec_id", "vector", F.pmod(place, F.lit(blocks)).cast("int").alias("c"), every(query_blocks, "q"))
    tiles = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_tile(k), RESULT_SCHEMA)
    merged = tiles.repartition("query_id").mapInPandas(
        _merge(k), "query_id long, rank int, vec_id long, score double"
    )
    return merged
