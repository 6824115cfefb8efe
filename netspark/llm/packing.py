"""Order-preserving packing of documents into training sequences by dynamic programming.

The ids of the documents, one after the other, form a stream; windows of at most ``length`` ids are cut from
it. Cuts lie behind documents (free), behind sentences or, inside very long sentences, at fixed places, the
latter two for a penalty. Over the possible cuts P_0 < P_1 < ... the least cost of a packing that ends at P_j is

    f(j) = penalty(j) + min over i with P_j - P_i <= length of f(i) + padding(P_j - P_i)

with padding(n) = length - n. f(i) + P_i is all that depends on i, so a monotone queue over the sliding range
gives each minimum in constant time. Every scan partition is packed by itself, in the stored order of its rows: no
shuffle, and one padded tail for each partition.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from netspark.llm.tokens import piece_ids
from netspark.llm.workers import prepared

LENGTH = 2048
#: What a cut costs, in ids of padding: behind a sentence, and inside one.
SENTENCE_PENALTY, INNER_PENALTY = 2, 8
#: A sentence longer than this has possible cuts each so many ids.
INNER_STEP = 24
#: Ids that are packed at once; the last window goes on into the next part.
PART_IDS = 1 << 19

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether its token consists of full stops, question and exclamation marks."""

    vocabulary = piece_ids(tokenizer).tokenizer.get_vocab()
    ends = np.zeros(1 << 16, bool)
    for token, i in vocabulary.items():
        text = token.removesuffix("</w>")
        ends[i] = bool(text) and not text.strip(".!?")
    return ends


def possible_cuts(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, from 0 to its end, and what a cut there costs."""
    total = len(ids)
    places = np.union1d(np.flatnonzero(ends[ids]) + 1, doc_ends)
    places = np.union1d(places, np.array([0, total]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > INNER_STEP)
    inner = [np.arange(places[k] + INNER_STEP, places[k + 1], INNER_STEP) for k in wide]
    costs = np.where(np.isin(places, doc_ends), 0, SENTENCE_PENALTY)
    if inner:
        added = np.concatenate(inner)
        places, costs = np.concatenate((places, added)), np.concatenate((costs, np.full(len(added), INNER_PENALTY)))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    costs[0] = costs[-1] = 0
    return places, costs


def best_windows(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Places of the cuts of the cheapest packing, first and last place included."""
    n = len(places)
    where, price = places.tolist(), costs.tolist()
    came = [0] * n
    keys = [0] * n  # f + place
    queue: deque[int] = deque([0])
    for j in range(1, n):
        place = where[j]
        least = place - length
        while where[queue[0]] < least:
            queue.popleft()
        source = queue[0]
        came[j] = source
        key = keys[j] = keys[source] + length + price[j]
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [where[k] for k in reversed(cuts)]


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = True
) -> DataFrame:
    """A row per piece of a document in its sequence.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (ids of the sequence before the piece) and, with ``with_ids``, the ids themselves
    (little-endian unsigned 16 bit). Each document ends with ``end_id``; null and empty texts have only that.
    Rows keep their stored order; null and repeated doc_ids are packed row by row; other columns are ignored.
    An empty table gives no rows.
    A sequence is padded to ``length`` by its reader.
    """
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ends = piece_ids(tokenizer), sentence_ends(tokenizer)
        end = np.array([end_id], "<u2")
        packer = Packer(TaskContext.get().partitionId() << 32, ends, length, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, np.concatenate((pieces.ids(text.as_py()), end)))
                if packer.waiting >= PART_IDS:
                    yield from packer.packed(last=False)
        if packer.waiting:
            yield from packer.packed(last=True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA + ", ids binary" * with_ids)


class Packer:
    """Packs a stream of documents part by part."""

    def __init__(self, first_sequence: int, ends: np.ndarray, length: int, with_ids: bool):
        self.sequence, self.ends, self.length, self.with_ids = first_sequence, ends, length, with_ids
        self.waiting = 0
        #: doc_id, ids of the whole document, ids of it that are packed already, ids that wait
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append((doc_id, len(ids), 0, ids))
        self.waiting += len(ids)

    def packed(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Pieces of the windows of what waits; unless it is the last part, the last window waits on."""
        stream = np.concatenate([p[3] for p in self.parts])
        doc_ends = np.cumsum([len(p[3]) for p in self.parts])
        cuts = best_windows(*possible_cuts(stream, self.ends, doc_ends), self.length)
        if not last:
            cuts = cuts[:-1]
        if len(cuts) < 2:
            return
        yield self._rows(stream, doc_ends, cuts)
        done = cuts[-1]
        k = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.parts[k:]
        if rest:
            doc_id, tokens, before, ids = rest[0]
            gone = done - int(doc_ends[k] - len(ids))
            rest[0] = (doc_id, tokens, before + gone, ids[gone:].copy())
        self.parts, self.waiting = rest, len(stream) - done
        self.sequence += len(cuts) - 1

    def _rows(self, stream: np.ndarray, doc_ends: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
        windows = np.array(cuts)
        inside = doc_ends[doc_ends < windows[-1]]
        edges = np.union1d(windows, inside)
        begins, stops = edges[:-1], edges[1:]
        window = np.searchsorted(windows, begins, side="right") - 1
        owner = np.searchsorted(doc_ends, begins, side="right")
        doc_begins = doc_ends - np.array([len(p[3]) for p in self.parts])
        before = np.array([p[2] for p in self.parts])
        tokens = np.array([p[1] for p in self.parts])
        wide = stream.astype("<u4")
        spans = list(zip(begins.tolist(), stops.tolist()))
        columns = {
            "doc_id": pa.array([self.parts[k][0] for k in owner.tolist()], pa.int64()),
            "start": pa.array(before[owner] + begins - doc_begins[owner], pa.int64()),
            "length": pa.array(stops - begins, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(wide[a:b].data) for a, b in spans], pa.int64()),
            "doc_tokens": pa.array(tokens[owner], pa.int64()),
            "sequence_id": pa.array(self.sequence + window, pa.int64()),
            "offset": pa.array(begins - windows[window], pa.int64()),
        }
        if self.with_ids:
            data = stream.astype("<u2")
            columns["ids"] = pa.array([data[a:b].tobytes() for a, b in spans], pa.binary())
        return pa.RecordBatch.from_pydict(columns)
