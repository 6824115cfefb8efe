"""The k nearest rows in exact Euclidean distance, by pivots and triangle bounds.

Indexed rows lie in the cell of their nearest pivot, with the distance to it. Copies are one row with their
smallest ids, as many as a query can need. A query first searches its own cell; the k-th distance found there
(or, if smaller, the one that the pivots promise) is its reach. Of the other cells it visits those that a bound
does not put out of reach:

    d(query, pivot) - largest distance of the cell's rows to the pivot
    smallest such distance - d(query, pivot)
    (d(query, pivot)^2 - d(query, own pivot)^2) / (2 d(pivot, own pivot))

Near cells share a block, large cells are cut into several, and queries visit blocks. Where distances hardly
differ (many dimensions) no bound leaves much out and the search compares all with all: a block of queries meets a
block of rows in one task, by a matrix product in single precision whose error is bounded; only pairs that can be
among the nearest are compared exactly. Each row travels once per block of queries, not once per cell and query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.session import cut_lineage

#: Pivots of an index: the square root of its rows, up to this many.
MAX_PIVOTS = 256
#: Rows and visitors of a block: an eighth of all, but at least so many rows and at most so many components.
LEAST_BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 22
#: Components that a task subtracts at a time.
MAX_CELLS = 2_000_000
#: Products that a task holds at a time, and limits of the queries that this is worth.
STRIP_CELLS, LEAST_STRIP, MOST_STRIP = 1 << 22, 16, 1024
#: Rows of which the nearest stands for all until it is in reach.
GROUP = 16
#: Digits of a distance that are kept, so equal rows tie wherever they were compared.
DIGITS = 12

#: How an index stores its rows.
CELLS = "cell int, gap double, vector array<double>, ids array<bigint>"
_LINK = "q long, right_id long, distance double"
_BEST = "best array<struct<distance: double, right_id: bigint>>"


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows."""
    out = np.empty((len(left), len(right)))
    rows = max(1, MAX_CELLS // max(1, right.size))
    for start in range(0, len(left), rows):
        gap = left[start : start + rows, None, :] - right[None, :, :]
        out[start : start + rows] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _loosened(reach: np.ndarray) -> np.ndarray:
    """Room for the rounding of distances and bounds."""
    return reach * (1 + 1e-9) + 1e-9


def _in_cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = distances(_matrix(batch.column("vector")), pivots)
                cell = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int32)),
                        pa.array(to[np.arange(len(cell)), cell]),
                        batch.column("vector"),
                        batch.column("ids"),
                    ],
                    names=["cell", "gap", "vector", "ids"],
                )

    return run


@dataclass(frozen=True)
class Bounds:
    """What tasks know of all cells; bounded by the number of pivots and of neighbours."""

    pivots: np.ndarray
    between: np.ndarray  # distances of pivots
    nearest_gaps: np.ndarray  # by cell, the smallest distances to the pivot; infinite where there are fewer rows
    lowest: np.ndarray  # by cell, the extremes of all its distances; an empty cell is out of every reach
    highest: np.ndarray
    sizes: np.ndarray  # by cell, stored rows
    kept: int

    def promised(self, to: np.ndarray) -> np.ndarray:
        """For distances of queries to the pivots, a reach that is known to hold all neighbours."""
        sums = to[:, :, None] + self.nearest_gaps[None]
        return np.partition(sums.reshape(len(to), -1), self.kept - 1, axis=1)[:, self.kept - 1]

    def within(self, to: np.ndarray, own: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells in reach of each query: (queries, cells), its own one left out."""
        mine = to[np.arange(len(to)), own][:, None]
        apart = self.between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to * to - mine * mine) / (2 * apart), 0.0)
        bound = np.maximum(np.maximum(to - self.highest, self.lowest - to), plane)
        near = bound <= _loosened(reach)[:, None]
        near[np.arange(len(to)), own] = False
        return near & (self.sizes > 0)


@dataclass(frozen=True)
class MetricIndex:
    """Rows in cells: ``cells`` has cell, gap, vector, ids."""

    bounds: Bounds
    cells: DataFrame

    @staticmethod
    def build(rows: DataFrame, *, neighbours: int, max_pivots: int = MAX_PIVOTS) -> MetricIndex:
        """Index ``id`` and ``vector`` (array<double> of one length) for searches of up to ``neighbours``."""
        first = Window.partitionBy("vector").orderBy("id")
        # The limit on the rank acts before the shuffle, so very many copies do not travel.
        few = rows.select("id", "vector").withColumn("at", F.row_number().over(first))
        distinct = cut_lineage(
            few.filter(F.col("at") <= neighbours)
            .groupBy("vector")
            .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        )
        wanted = int(min(max_pivots, np.ceil(np.sqrt(distinct.count()))))
        chosen = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(wanted).collect()
        pivots = np.array([r.vector for r in chosen], np.float64) if chosen else np.empty((0, 0))
        placed = distinct.mapInArrow(_in_cells(pivots), CELLS)
        return MetricIndex.of_cells(cut_lineage(placed), pivots, neighbours=neighbours)

    @staticmethod
    def of_cells(cells: DataFrame, pivots: np.ndarray, *, neighbours: int) -> MetricIndex:
        """An index whose cells have been stored."""
        in_cell = Window.partitionBy("cell").orderBy("gap")
        near = (
            cells.select("cell", "gap", F.size("ids").alias("n"))
            .withColumn("at", F.row_number().over(in_cell))
            .filter(F.col("at") <= neighbours)
            .orderBy("cell", "at")
            .collect()  # pivots x neighbours
        )
        gaps: list[list[float]] = [[] for _ in pivots]
        for row in near:
            gaps[row["cell"]] += [row["gap"]] * row["n"]
        padded = np.array([(g + [np.inf] * neighbours)[:neighbours] for g in gaps]).reshape(-1, neighbours)
        lowest, highest, sizes = (np.full(len(pivots), x) for x in (np.inf, -np.inf, 0.0))
        for row in cells.groupBy("cell").agg(F.min("gap"), F.max("gap"), F.count(F.lit(1))).collect():
            lowest[row[0]], highest[row[0]], sizes[row[0]] = row[1], row[2], row[3]
        known = Bounds(pivots, distances(pivots, pivots), padded, lowest, highest, sizes, neighbours)
        return MetricIndex(known, cells)


def _queries(known: Bounds):
    """Own cell, distance to its pivot and promised reach of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                to = distances(_matrix(part.column("vector")), known.pivots)
                own = to.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("q"),
                        pa.array(own.astype(np.int32)),
                        pa.array(to[np.arange(len(own)), own]),
                        pa.array(known.promised(to)),
                        part.column("vector"),
                    ],
                    names=["q", "cell", "gap", "reach", "vector"],
                )

    return run


@dataclass(frozen=True)
class Blocks:
    """How cells are dealt to blocks: near cells share one, a large cell is cut into several."""

    first: np.ndarray  # by cell, its block, or the first of several
    parts: np.ndarray  # by cell, its blocks
    rows: int  # rows that a block holds, on average

    @staticmethod
    def of(known: Bounds, block_rows: int | None = None) -> Blocks:
        if block_rows is None:
            most = max(256, BLOCK_CELLS // max(1, known.pivots.shape[1]))
            block_rows = int(min(most, max(LEAST_BLOCK_ROWS, np.ceil(known.sizes.sum() / 8))))
        first, parts = (np.zeros(len(known.pivots), np.int64) for _ in range(2))
        block, filled = 0, 0.0
        for cell in _chain(known.between):
            size = known.sizes[cell]
            if filled and filled + size > block_rows:
                block, filled = block + 1, 0.0
            first[cell], parts[cell] = block, max(1, int(-(-size // block_rows)))
            filled += size
            if parts[cell] > 1:
                block, filled = block + int(parts[cell]), 0.0
        return Blocks(first, parts, block_rows)

    def of_cells(self) -> np.ndarray:
        """(cells, blocks): whether the block has rows of the cell."""
        block = np.arange((self.first + self.parts).max())
        return (block >= self.first[:, None]) & (block < (self.first + self.parts)[:, None])


def _chain(between: np.ndarray) -> Iterator[int]:
    """All pivots, each followed by the nearest that is left."""
    left = np.ones(len(between), bool)
    at = 0
    for _ in range(len(between)):
        left[at] = False
        yield at
        at = int(np.where(left, between[at], np.inf).argmin())
        if not left[at]:
            at = int(left.argmax())


def _visits(known: Bounds, blocks: Blocks):
    """The blocks that have cells in reach of a query, for each query that has any."""
    members = blocks.of_cells().astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                to = distances(_matrix(part.column("vector")), known.pivots)
                near = known.within(to, part.column("cell").to_numpy(), part.column("reach").to_numpy())
                query, block = np.nonzero(near.astype(np.float32) @ members)
                asking, begins = np.unique(query, return_index=True)
                some = part.take(pa.array(asking))
                offsets = pa.array(np.append(begins, len(query)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("q"),
                        some.column("cell"),
                        some.column("reach"),
                        some.column("vector"),
                        pa.ListArray.from_arrays(offsets, pa.array(block.astype(np.int32))),
                    ],
                    names=["q", "cell", "reach", "vector", "blocks"],
                )

    return run


class _Points:
    """Rows of a block, and which of them can be among the nearest of some queries.

    |y|^2 - 2 x.y is one matrix product, in single precision with a bound of its error. The smallest values of
    ``kept`` groups of rows are a bound of the kept-th distance. What it leaves is compared exactly.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.center = np.zeros(points.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            self.usable = np.isfinite(np.einsum("ij,ij->i", points, points))
            if self.usable.any():
                self.center = points[self.usable].mean(axis=0)
            moved = np.where(self.usable[:, None], points - self.center, 0.0)
            norms = np.einsum("ij,ij->i", moved, moved)
        self.largest = float(np.sqrt(norms.max(initial=0.0)))
        # Rows without a finite length are never a bound, and always compared.
        right = np.column_stack((-2 * moved, np.where(self.usable, norms, np.inf)))
        self.right = {np.float64: right}
        if self.largest < 1e15:
            self.right[np.float32] = right.astype(np.float32)

    def candidates(self, queries: np.ndarray, reach: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs with all that are in reach and among the ``kept`` nearest, ties included."""
        with np.errstate(over="ignore", invalid="ignore"):
            usable = np.isfinite(np.einsum("ij,ij->i", queries, queries))
            moved = np.where(usable[:, None], queries - self.center, 0.0)
            norms = np.einsum("ij,ij->i", moved, moved)
        left = np.column_stack((moved, np.ones(len(moved))))
        kinds = [k for k in (np.float32, np.float64) if k in self.right]
        if len(norms) and norms.max() >= 1e30:
            kinds = [np.float64]
        for kind in kinds:
            query, row = self._below(left.astype(kind, copy=False), self.right[kind], norms, reach, kept)
            if kind is np.float64 or len(query) <= 16 * kept * len(queries):
                break
        if usable.all() and self.usable.all():
            return query, row
        known = usable[query]
        others = np.nonzero(~(usable[:, None] & self.usable))
        return np.concatenate((query[known], others[0])), np.concatenate((row[known], others[1]))

    def _below(self, left, right, norms, reach, kept) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.finfo(right.dtype)
        sums = left @ right.T
        error = 2 * (left.shape[1] + 16) * float(sizes.eps) * (np.sqrt(norms) + self.largest) ** 2 + 64 * float(sizes.tiny)
        group = GROUP if len(right) >= 4 * GROUP * kept else 1
        groups = len(right) // group
        least = sums[:, : groups * group].reshape(len(sums), group, groups).min(axis=1)
        limit = _loosened(reach)
        if groups >= kept:
            last = np.partition(least, kept - 1, axis=1)[:, kept - 1].astype(np.float64)
            limit = np.minimum(limit, _loosened(np.sqrt(np.maximum(last + norms + error, 0.0))))
        # The error has room for rounding this bound to the type of the sums, too.
        bound = (limit * limit - norms + error).astype(right.dtype)
        query, at = np.divmod(np.flatnonzero(least <= bound[:, None]), groups)
        row = (at[:, None] + groups * np.arange(group)).ravel()
        query = np.repeat(query, group)
        rest, more = np.nonzero(sums[:, groups * group :] <= bound[:, None])
        query, row = np.concatenate((query, rest)), np.concatenate((row, more + groups * group))
        near = (sums[query, row] <= bound[query]) & self.usable[row]
        return query[near], row[near]


def _compared(kept: int):
    """Up to ``kept`` nearest rows of a block for each of its visitors, those of the cell ``skip`` left out."""

    def run(visitors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if visitors.num_rows and rows.num_rows:
            visitors, rows = visitors.combine_chunks(), rows.combine_chunks()
            points, cells = _matrix(rows["vector"]), rows["cell"].to_numpy()
            block = _Points(points)
            lists = rows["ids"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            many = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy()
            begins = np.cumsum(many) - many
            q, skip, reach = (visitors[c].to_numpy() for c in ("q", "skip", "reach"))
            vectors = _matrix(visitors["vector"])
            strip = int(min(MOST_STRIP, max(LEAST_STRIP, STRIP_CELLS // len(points))))
            for start in range(0, len(q), strip):
                some = slice(start, start + strip)
                query, row = block.candidates(vectors[some], reach[some], kept)
                query = query + start
                other = cells[row] != skip[query]
                query, row = query[other], row[other]
                far = np.round(_pair_distances(vectors, points, query, row), DIGITS)
                near = far <= _loosened(reach)[query]
                query, row, far = query[near], row[near], far[near]
                sizes = many[row]
                pair = np.repeat(np.arange(len(row)), sizes)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                right = ids[begins[row][pair] + at]
                query, far = query[pair], far[pair]
                order = np.lexsort((right, far, query))
                query, right, far = query[order], right[order], far[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
                best = rank < kept
                out.append((q[query[best]], right[best], far[best]))
        q, right, far = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0),) * 3
        return pa.table(
            {
                "q": pa.array(q.astype(np.int64)),
                "right_id": pa.array(right.astype(np.int64)),
                "distance": pa.array(far.astype(np.float64)),
            }
        )

    return run


def _pair_distances(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows ``i`` of ``left`` and ``j`` of ``right``."""
    out = np.empty(len(i))
    pairs = max(1, MAX_CELLS // max(1, left.shape[1]))
    for start in range(0, len(i), pairs):
        some = slice(start, start + pairs)
        gap = left[i[some]] - right[j[some]]
        out[some] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _by_cell(values: np.ndarray):
    """A number of each row's cell."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)


def _own_cells(placed: DataFrame, index: MetricIndex, counts: np.ndarray, block_rows: int) -> DataFrame:
    """(q, right_id, distance) of the best rows of each block of the queries' own cells."""
    visitor_blocks, row_blocks = (
        _by_cell(np.maximum(1, -(-n // block_rows))) for n in (counts, index.bounds.sizes)
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visitors = placed.select("q", "cell", F.lit(-1).alias("skip"), "reach", "vector").withColumns(
        {"vb": F.pmod(F.xxhash64("q"), visitor_blocks).cast("int"), "rb": every(row_blocks)}
    )
    rows = index.cells.filter(F.col("cell").isin([int(c) for c in np.flatnonzero(counts)])).withColumns(
        {"rb": F.pmod(F.xxhash64("vector"), row_blocks).cast("int"), "vb": every(visitor_blocks)}
    )
    keys = ["cell", "vb", "rb"]
    return visitors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_compared(index.bounds.kept), _LINK)


def _visited_blocks(visits: DataFrame, index: MetricIndex, blocks: Blocks) -> DataFrame:
    """(q, right_id, distance) of the best rows of each visited block."""
    part = F.pmod(F.xxhash64("vector"), _by_cell(blocks.parts))
    rows = index.cells.withColumn("rb", (_by_cell(blocks.first) + part).cast("int"))
    # Pairs of blocks, however many rows these have.
    pairs = F.broadcast(visits.select(F.col("vb").alias("vb"), F.col("rb").alias("rb")).distinct())
    keys = ["vb", "rb"]
    return visits.groupBy(*keys).cogroup(rows.join(pairs, "rb").groupBy(*keys)).applyInArrow(
        _compared(index.bounds.kept), _LINK
    )


def _best(links: DataFrame, kept: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "right_id")
    return links.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= kept)


def visited(queries: DataFrame, index: MetricIndex, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best rows of the own cells of ``queries`` (q, vector), and the blocks that each must still visit."""
    known, blocks = index.bounds, Blocks.of(index.bounds, block_rows)
    placed = cut_lineage(
        queries.mapInArrow(_queries(known), "q long, cell int, gap double, reach double, vector array<double>")
    )
    counts = np.zeros(len(known.pivots))
    for row in placed.groupBy("cell").agg(F.count(F.lit(1))).collect():
        counts[row[0]] = row[1]
    own = cut_lineage(_best(_own_cells(placed, index, counts, blocks.rows), known.kept))
    # A full list of the own cell gives a reach, too.
    last = own.filter(F.col("at") == known.kept).select("q", F.col("distance").alias("own_reach"))
    closer = placed.join(last, "q", "left").withColumn("reach", F.least("reach", "own_reach")).drop("own_reach")
    found = cut_lineage(
        closer.mapInArrow(
            _visits(known, blocks), "q long, cell int, reach double, vector array<double>, blocks array<int>"
        )
    )
    # Queries of a block visit together.
    asking = np.bincount(blocks.first, counts)[blocks.first]
    part = F.pmod(F.xxhash64("q"), _by_cell(np.maximum(1, -(-asking // blocks.rows))))
    together = F.struct(_by_cell(blocks.first).alias("block"), part.cast("int").alias("part"))
    visits = found.select(
        "q", F.col("cell").alias("skip"), "reach", "vector", together.alias("vb"), F.explode("blocks").alias("rb")
    )
    return own, visits


def nearest_lists(left: DataFrame, index: MetricIndex, block_rows: int | None = None) -> DataFrame:
    """(vector, best): the nearest indexed rows of each distinct ``vector``, as many as the index was built for."""
    if not len(index.bounds.pivots):
        return left.sparkSession.createDataFrame([], f"vector array<double>, {_BEST}")
    # Copies ask once. Rows and queries meet again by their vectors.
    queries = cut_lineage(
        left.select("vector").distinct().select(F.monotonically_increasing_id().alias("q"), "vector")
    )
    own, visits = visited(queries, index, block_rows)
    far = _visited_blocks(visits, index, Blocks.of(index.bounds, block_rows))
    links = _best(own.drop("at").unionByName(far), index.bounds.kept)
    lists = links.groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("distance", "right_id"))).alias("best")
    )
    return queries.join(lists, "q").select("vector", "best")


def nearest_links(
    left: DataFrame,
    index: MetricIndex,
    *,
    k: int,
    skip_self: bool = False,
    block_rows: int | None = None,
    lists: DataFrame | None = None,
) -> DataFrame:
    """(id, right_id, distance): the k nearest indexed rows of each row, ties to the smaller id.

    ``left`` has ``id`` and ``vector``. With ``skip_self`` a row is no neighbour of its own id; the index must
    have been built for k + 1 neighbours then. Fewer indexed rows give fewer neighbours. ``lists`` are those of
    vectors that were searched before (see ``nearest_lists``); only others are searched.
    """
    if index.bounds.kept < k + skip_self:
        raise ValueError(f"the index was built for {index.bounds.kept} neighbours")
    if lists is None:
        answers = nearest_lists(left, index, block_rows)
    else:
        others = left.join(lists.select("vector"), "vector", "left_anti")
        answers = lists.unionByName(nearest_lists(others, index, block_rows))
    rows = left.select("id", "vector").join(answers, "vector")
    best = F.col("best")
    if skip_self:
        best = F.filter(best, lambda link: link["right_id"] != F.col("id"))
    return rows.select("id", F.inline(F.slice(best, 1, k))).select("id", "right_id", "distance")
