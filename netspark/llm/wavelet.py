"""Token ids of a corpus in wavelet matrices: one compressed file per shard with access, count and lookup.

A wavelet matrix keeps the ids of a shard as bit planes, from the highest bit down; after each plane the ids
are sorted stably by that bit. With the number of ones before each block of bits (rank directory) a token can
be read, occurrences of an id counted in a prefix, and its n-th occurrence found, all from the planes.

Documents are ordered by range partitions, each partition cuts its documents into shards of bounded size, and
a shard is one row of a Parquet file of its own, so that Spark writes and reads it wherever the folder lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.tokens import piece_ids
from netspark.llm.workers import prepared

BITS = 16
#: Tokens of a shard, but for a longer last document: 8 MB of planes.
SHARD_TOKENS = 1 << 22
#: Bits that one entry of the rank directory spans.
RANK_BLOCK = 2048
CHUNK = 1 << 16
#: Bytes of texts that are encoded together, or one longer text.
PART_BYTES = 4 << 20
MAGIC = b"WVM1"

SHARD_SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary"
DOC_SCHEMA = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Bit planes of unsigned 16-bit ids with rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.ranks, self.zeros = size, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        current = np.ascontiguousarray(ids, dtype=np.uint16)
        planes, ranks, zeros = [], [], []
        for level in range(BITS - 1, -1, -1):
            bits = (current & np.uint16(1 << level)) != 0
            packed = np.packbits(bits)
            planes.append(packed)
            ranks.append(_directory(packed))
            low = current.compress(~bits)
            zeros.append(len(low))
            current = np.concatenate((low, current.compress(bits)))
        return cls(len(ids), planes, ranks, zeros)

    def to_bytes(self) -> bytes:
        """Magic, size, zeros of each plane, then each plane's bits and rank directory."""
        head = MAGIC + np.array([self.size, *self.zeros], "<u8").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size, *zeros = (int(x) for x in np.frombuffer(data, "<u8", 1 + BITS, 4))
        at, width, entries = 4 + 8 * (1 + BITS), -(-size // 8), -(-size // RANK_BLOCK)
        planes, ranks = [], []
        for _ in range(BITS):
            planes.append(np.frombuffer(data, np.uint8, width, at))
            ranks.append(np.frombuffer(data, "<u4", entries, at + width))
            at += width + 4 * entries
        return cls(size, planes, ranks, zeros)

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, plane: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane."""
        if end == 0:
            return 0
        block = (end - 1) // RANK_BLOCK
        first, whole = block * RANK_BLOCK // 8, end >> 3
        bits = self.planes[plane]
        ones = int(self.ranks[plane][block]) + int(np.bitwise_count(bits[first:whole]).sum(dtype=np.int64))
        return ones + (int(bits[whole]) >> (8 - (end & 7))).bit_count() if end & 7 else ones

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for plane in range(BITS):
            bit = self._bit(plane, at)
            ones = self._ones(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for plane in range(BITS):
            low, high = self._ones(plane, begin), self._ones(plane, end)
            if token >> (BITS - 1 - plane) & 1:
                begin, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of an id from ``begin`` up to ``end``."""
        low, high = self._range(token, begin, self.size if end is None else end)
        return high - low

    def select(self, token: int, nth: int) -> int:
        """The place of the n-th occurrence (from 0) of an id."""
        low, high = self._range(token, 0, self.size)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for plane in range(BITS - 1, -1, -1):
            if token >> (BITS - 1 - plane) & 1:
                at = self._place(plane, at - self.zeros[plane], 1)
            else:
                at = self._place(plane, at, 0)
        return at

    def _place(self, plane: int, nth: int, bit: int) -> int:
        """The place of the n-th one or zero of a plane: the directory's block first, then the bits of it."""
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * RANK_BLOCK - ones
        block = int(np.searchsorted(before, nth, side="right")) - 1
        first = block * RANK_BLOCK // 8
        bits = np.unpackbits(self.planes[plane][first : first + RANK_BLOCK // 8])
        return block * RANK_BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids, by undoing the sorts from the lowest plane up."""
        current = np.zeros(self.size, np.uint16)
        for plane in range(BITS - 1, -1, -1):
            bits = np.unpackbits(self.planes[plane], count=self.size).view(bool)
            above, low, high = np.empty_like(current), 0, self.zeros[plane]
            current[high:] |= np.uint16(1 << (BITS - 1 - plane))
            for at in range(0, self.size, CHUNK):  # what is in use stays in the processor's cache
                part = bits[at : at + CHUNK]
                ones, none = np.flatnonzero(part), np.flatnonzero(~part)
                own = above[at : at + CHUNK]
                own[ones] = current[high : high + len(ones)]
                own[none] = current[low : low + len(none)]
                high, low = high + len(ones), low + len(none)
            current = above
        return current


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of ``RANK_BLOCK`` bits."""
    counts = np.bitwise_count(packed)
    width = RANK_BLOCK // 8
    padded = np.zeros(-(-len(counts) // width) * width, np.uint8)
    padded[: len(counts)] = counts
    sums = padded.reshape(-1, width).sum(axis=1, dtype=np.int64)
    return (np.cumsum(sums) - sums).astype(np.uint32)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def text_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, PART_BYTES of texts or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``text`` of all rows and write their ids in ascending ``doc_id`` order, a file per shard.

    Each document ends with ``end_id``; a null text has only that. Null ids come first; rows of one id are
    ordered by the hash of their text, then as they are stored. An empty table writes no shard. Other columns
    are ignored.
    """
    prepared(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, shard = piece_ids(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0
        for batch in batches:
            for texts in text_parts(batch):
                found, many = pieces.ids_of(texts.column("text"))
                ends = np.cumsum(many)
                found = np.insert(found, ends, np.uint16(end_id))
                ends, own, at = ends + np.arange(1, len(ends) + 1), texts.column("doc_id").to_pylist(), 0
                while at < len(own):  # up to the document that fills the shard, or all
                    gone = int(ends[at - 1]) if at else 0
                    stop = min(int(np.searchsorted(ends, gone + shard_tokens - total)) + 1, len(own))
                    doc_ids += own[at:stop]
                    ids.append(found[gone : ends[stop - 1]])
                    sizes += (many[at:stop] + 1).tolist()
                    total += int(ends[stop - 1]) - gone
                    at = stop
                    if total >= shard_tokens:
                        yield _shard(part, shard, doc_ids, sizes, ids)
                        shard, total, doc_ids, ids, sizes = shard + 1, 0, [], [], []
        if doc_ids:
            yield _shard(part, shard, doc_ids, sizes, ids)

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
        .repartitionByRange("doc_id", "h", "n")
        .sortWithinPartitions("doc_id", "h", "n")
        .select("doc_id", "text")
    )
    shards = ordered.mapInArrow(build, SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def _shard(part: int, shard: int, doc_ids: list, sizes: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(np.concatenate(ids)).to_bytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([shard], pa.int32()),
            pa.array([sum(sizes)], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([matrix], pa.binary()),
        ],
        names=["part", "shard", "n_tokens", "doc_ids", "doc_tokens", "matrix"],
    )


def read_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row per document from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; ``docs`` only lends its session.
    """
    spark = prepared(docs.sparkSession)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids = WaveletMatrix.from_bytes(row["matrix"]).ids().astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(ends - sizes, ends)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A shard is some MB, so a few travel at a time.
    found = shards.select("part", "shard", "doc_ids", "doc_tokens", "matrix").mapInArrow(decode, DOC_SCHEMA)
    order = Window.orderBy("part", "shard")  # a row per shard
    first = shards.select(
        "part", "shard", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("first")
    )
    return found.join(first, ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
