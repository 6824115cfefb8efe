"""Texts of similar wording: an n-gram Jaccard join by a MinHash LSH forest.

1. Sketch. A text's MinHash values are dealt to ``TREES`` prefix tries, ``DEPTH`` values each. Texts with the
   same set of shingles are copies; from here on a set counts once, however many copies it has.
2. Forest. Sets meet where their labels in a trie share a prefix. Whole labels come first; the prefix is
   shortened level by level until a pair at the threshold meets with the target recall,
   1 - (1 - s^k)^TREES. A crowded node is split into pairs of blocks, so that each task sees a bounded part
   and yet each two members meet.
3. Canopies. In a node, a member near the first one left (``TIGHT`` by their sketches) is done, and all that
   are loosely near (``LOOSE``) are tied to it: whatever reaches the threshold with a member that is done is
   loosely near as well. The ties of a node are a forest, not pairs; their components hold every link.
4. Verification. The members of a component are compared exactly, block by block, as products of 0/1
   matrices over the shingles they share. Links are counted where they are found and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.components import components
from netspark.llm.shingles import mixed, shingle_set
from netspark.llm.workers import column, free_name, prepared, runs
from netspark.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 24, 6
RECALL = 0.9999
#: Agreement of sketches, a byte per value. A pair at 0.8 of which one is at TIGHT to a third is at about 0.55
#: to it or more; LOOSE leaves room for the error of a sketch.
TIGHT, LOOSE = 0.75, 0.42
#: Sets of a block; a task compares two blocks.
NODE_BLOCK, VERIFY_BLOCK = 2000, 1000
#: Values of the MinHash table computed at once, and cells of a 0/1 matrix.
TABLE_VALUES, MATRIX_CELLS = 1 << 17, 1 << 22

SKETCH_SCHEMA = "row_key long, doc_id long, c1 long, c2 long, sketch binary, nodes array<long>"


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair of that similarity shares a node with the recall asked for."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def row_key() -> Column:
    """A key of a row; rows of equal doc_id and text share it."""
    return F.xxhash64("doc_id", "text")


def _factors(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, TABLE_VALUES // len(factors))
    for at in range(0, len(shingles), step):
        np.minimum(least, (shingles[at : at + step, None] * factors).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, words: int, trees: int, depth: int, prefix: int) -> DataFrame:
    """Digest of the set, sketch and trie nodes of each row; those of a text without words are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * depth)
        tree_seed = mixed(np.arange(1, trees + 1, dtype=np.uint64))
        for batch in batches:
            digests: list[tuple[int, int] | tuple[None, None]] = []
            marks: list[bytes | None] = []
            nodes: list[np.ndarray | None] = []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), words)
                if not len(own):
                    digests.append((None, None))
                    marks.append(None)
                    nodes.append(None)
                    continue
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                least = mixed(_minima(own, factors)).reshape(trees, depth)
                node = tree_seed.copy()
                for level in range(prefix):
                    node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + least[:, level])
                digests.append((int(whole[0]), int(whole[1])))
                marks.append(least.astype(np.uint8).tobytes())
                nodes.append(node.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_key"),
                    batch.column("doc_id"),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.array(nodes, pa.list_(pa.int64())),
                ],
                names=["row_key", "doc_id", "c1", "c2", "sketch", "nodes"],
            )

    keyed = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(run, SKETCH_SCHEMA)


def in_blocks(df: DataFrame, group: str, size: Column, limit: int, member: str) -> DataFrame:
    """Rows of ``df`` with the two blocks ``lo``, ``hi`` of each comparison they take part in, and their ``own``.

    A group of at most ``limit`` members is one block compared with itself.
    """
    blocks = F.ceil(size / limit).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    placed = df.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("*", other)
    return spread.select(
        *[c for c in placed.columns if c != "blocks"],
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
    )


def canopy_ties(marks: np.ndarray, tight: float, loose: float) -> np.ndarray:
    """For each member of a node, the first member of its component of loose canopies."""
    m, width = marks.shape
    root = np.arange(m)
    left = np.ones(m, bool)
    pivot = 0
    while pivot < m:
        agree = (marks == marks[pivot]).sum(axis=1)
        near = np.unique(root[agree >= loose * width])
        if len(near) > 1:
            root[np.isin(root, near)] = near[0]
        left[agree >= tight * width] = False
        left[pivot] = False
        rest = np.flatnonzero(left[pivot:])
        if not len(rest):
            break
        pivot += int(rest[0])
    return root


def _node_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found, bounds in runs(batches, ["node", "lo", "hi"]):
        cids = column(found, "cid")
        raw = found.column("sketch").combine_chunks()
        marks = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(cids), -1)
        sizes = np.diff(bounds)
        a, b = [], []
        twos = bounds[:-1][sizes == 2]
        if len(twos):
            agree = (marks[twos] == marks[twos + 1]).sum(axis=1)
            twos = twos[agree >= LOOSE * marks.shape[1]]
            a.append(cids[twos])
            b.append(cids[twos + 1])
        for k in np.flatnonzero(sizes > 2).tolist():
            part = slice(int(bounds[k]), int(bounds[k + 1]))
            root = canopy_ties(marks[part], TIGHT, LOOSE)
            tied = np.flatnonzero(root != np.arange(len(root)))
            a.append(cids[part][root[tied]])
            b.append(cids[part][tied])
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
            )


def overlaps(first: list[np.ndarray], second: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of shingle sets, of ``first`` with ``second`` or with themselves."""
    sets = first if second is None else first + second
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = counts[place] > 1  # a shingle of one set is in no intersection
    columns = (np.cumsum(counts > 1) - 1)[place[kept]]
    owner = owner[kept]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    width = int(columns[-1]) + 1 if len(columns) else 0
    n = len(first)
    total = np.zeros((n, n if second is None else len(second)), np.float32)
    step = max(1, MATRIX_CELLS // len(sets))
    for at in range(0, width, step):
        low, high = np.searchsorted(columns, [at, at + step])
        matrix = np.zeros((len(sets), min(step, width - at)), np.float32)
        matrix[owner[low:high], columns[low:high] - at] = 1
        total += matrix[:n] @ (matrix.T if second is None else matrix[n:].T)
    return total


def _verified(similarity: float):
    share = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, bounds in runs(batches, ["component", "lo", "hi"]):
            all_ids, all_own = column(found, "cid"), column(found, "own")
            los, his = column(found, "lo"), column(found, "hi")
            all_sets = found.column("shingles").combine_chunks()
            nodes, counts, roots = [], [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                # A set comes once, even if its row is repeated.
                cids, at = np.unique(all_ids[low:high], return_index=True)
                own = all_own[low:high][at]
                sets = [np.frombuffer(all_sets[low + k].as_py(), np.uint64) for k in at.tolist()]
                sizes = np.array([len(s) for s in sets], np.float64)
                if los[low] == his[low]:
                    one = two = np.arange(len(cids))
                    linked = overlaps(sets, None) >= share * (sizes[:, None] + sizes) - 1e-6
                    np.fill_diagonal(linked, False)
                    ends = [(one, linked.sum(axis=1))]
                else:
                    one, two = np.flatnonzero(own == los[low]), np.flatnonzero(own == his[low])
                    if not len(one) or not len(two):
                        continue
                    shared = overlaps([sets[k] for k in one], [sets[k] for k in two])
                    linked = shared >= share * (sizes[one][:, None] + sizes[two]) - 1e-6
                    ends = [(one, linked.sum(axis=1)), (two, linked.sum(axis=0))]
                root = _roots(len(cids), one, two, linked)
                for place, count in ends:
                    some = count > 0
                    nodes.append(cids[place[some]])
                    counts.append(count[some])
                    roots.append(cids[root[place[some]]])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(counts).astype(np.int64)),
                        pa.array(np.concatenate(roots)),
                    ],
                    names=["cid", "n_links", "root"],
                )

    return run


def _roots(count: int, one: np.ndarray, two: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component of links: a walk that visits each row once."""
    root = np.full(count, -1)
    row_of = np.full(count, -1)
    row_of[one] = np.arange(len(one))
    column_of = np.full(count, -1)
    column_of[two] = np.arange(len(two))
    for start in range(count):
        if root[start] >= 0:
            continue
        root[start] = start
        waiting = [start]
        while waiting:
            member = waiting.pop()
            near = np.zeros(count, bool)
            if row_of[member] >= 0:
                near[two[linked[row_of[member]]]] = True
            if column_of[member] >= 0:
                near[one[linked[:, column_of[member]]]] = True
            new = np.flatnonzero(near & (root < 0))
            root[new] = start
            waiting.extend(new.tolist())
    return root


def similar_texts(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): row_key, doc_id, copy_id, class_id, n_copies, n_links.

    Words are runs of word characters, lower-cased; a text of fewer than ``words`` words is one shingle.
    Rows with the same set of shingles are copies: ``copy_id`` is their smallest doc_id, ``n_copies`` their
    number. Two different sets are linked if their Jaccard similarity is at least ``similarity``; ``n_links``
    counts the sets that a row's set is linked with. ``class_id`` is the smallest doc_id that copies and links
    lead to, and ``group`` a number of that class. Texts that are null or without words are alike with
    nothing: a class of their own. Null doc_ids lose to others; repeated rows are copies. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    prefix = prefix_depth(similarity, trees, depth, recall)
    rows = cut_lineage(sketches(docs, words, trees, depth, prefix))
    classes = cut_lineage(
        rows.where("c1 IS NOT NULL")
        .groupBy("c1", "c2")
        .agg(
            F.count(F.lit(1)).alias("n_copies"),
            F.min("doc_id").alias("copy_id"),
            F.min("row_key").alias("example"),
            F.first("sketch").alias("sketch"),
            F.first("nodes").alias("nodes"),
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    members = classes.select("cid", F.explode("nodes").alias("node"))
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(shared, "node").join(classes.select("cid", "sketch"), "cid")
    met = in_blocks(met, "node", F.col("n"), NODE_BLOCK, "cid")
    ties = (
        met.select("node", "lo", "hi", "cid", "sketch")
        .repartition("node", "lo", "hi")
        .sortWithinPartitions("node", "lo", "hi")
        .mapInArrow(_node_ties, "a long, b long")
    )
    found = components(ties)

    sized = found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    examples = classes.select("cid", "example").join(
        sized.select(F.col("node").alias("cid"), F.col("root").alias("component"), "size"), "cid"
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("component"), batch.column("size"), pa.array(sets, pa.binary())],
                names=["cid", "component", "size", "shingles"],
            )

    texts = docs.select(row_key().alias("example"), "text").join(examples, "example")
    sets = texts.select("cid", "component", "size", "text").mapInArrow(
        shingled, "cid long, component long, size long, shingles binary"
    )
    compared = in_blocks(sets, "component", F.col("size"), VERIFY_BLOCK, "cid")
    links = cut_lineage(
        compared.select("component", "lo", "hi", "own", "cid", "shingles")
        .repartition("component", "lo", "hi")
        .sortWithinPartitions("component", "lo", "hi")
        .mapInArrow(_verified(similarity), "cid long, n_links long, root long")
    )
    linked = links.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    groups = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("c1", "c2", "cid", "n_copies", "copy_id")
        .join(linked, "cid", "left")
        .join(groups.select(F.col("node").alias("cid"), "root"), "cid", "left")
        .withColumn("group", F.coalesce("root", "cid"))
    )
    smallest = known.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    known = cut_lineage(
        known.join(smallest, "group").select(
            "c1", "c2", "group", "copy_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
        )
    )
    worded = rows.select("row_key", "doc_id", "c1", "c2").where("c1 IS NOT NULL").join(known, ["c1", "c2"])
    names = ["row_key", "doc_id", "copy_id", "class_id", "n_copies", "n_links", "group"]
    wordless = rows.where("c1 IS NULL").select(
        "row_key",
        "doc_id",
        F.col("doc_id").alias("copy_id"),
        F.col("doc_id").alias("class_id"),
        F.lit(1).cast("long").alias("n_copies"),
        F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("group"),
    )
    return worded.select(names).unionByName(wordless)


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without the copies and near copies of another: of each group the row with the
    smallest doc_id stays (null ids last), of repeated rows one. Texts without words all stay."""
    rows = similar_texts(docs, **options).select("row_key", "doc_id", "group")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key")
    grouped = rows.where("group IS NOT NULL")
    kept = grouped.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = cut_lineage(
        grouped.join(kept, "group")
        .groupBy("row_key")
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.col("first.row_key")).alias("kept"))
    )
    key = free_name(docs, "row_key")
    gone = judged.where("row_key <> kept").select(F.col("row_key").alias(key))
    keyed = docs.withColumn(key, row_key()).join(gone, key, "left_anti")
    repeated = judged.where("row_key = kept AND n > 1").select(F.col("row_key").alias(key))
    if not repeated.isEmpty():
        single = keyed.join(repeated, key, "left_anti")
        keyed = single.unionByName(keyed.join(repeated, key).dropDuplicates([key]))
    return keyed.select(*docs.columns)
