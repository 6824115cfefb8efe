"""Passages that repeat across documents, by content-defined chunks.

A gear hash rolls over the bytes of a text; its value over the last 16 bytes rates every start of a word. A
chunk begins at words rated highest among their ``SPREAD`` neighbours on both sides, so chunks depend on what
is near and find themselves again behind an insertion. Chunks are known by a 128-bit digest; each has the
document with the smallest id that holds it, and is a repeat in all others. Runs of repeated chunks that can
be a passage of ``MIN_WORDS`` words are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.shingles import mixed
from netspark.llm.workers import free_name, prepared
from netspark.session import cut_lineage

#: Bytes that a rating looks back, a power of two.
GEAR_BYTES = 16
#: Words on both sides that a chunk's first word outrates: chunks have 7 words on average, 4 at least.
SPREAD = 3
#: A stretch without such a word is cut each so many words.
MAX_WORDS = 16
#: A passage of this many words is found wherever it repeats: the chunks inside it, the two at its edges and
#: EDGE_WORDS have that many words or more together, and those inside it RUN_WORDS or more.
MIN_WORDS, RUN_WORDS = 50, 15
#: Words at both ends of a passage whose rating still depends on what is outside.
EDGE_WORDS = 2 * SPREAD + GEAR_BYTES // 2 + 1
#: First byte of characters that are words by themselves: CJK, and all beyond the basic plane.
WIDE_LEAD = 0xE3

GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WIDE = np.arange(256) >= WIDE_LEAD

CHUNK_SCHEMA = "d1 long, d2 long, rank long, row_key long, place long"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 16 bytes, shifted by their distance."""
    total = GEAR[data]
    width = 1
    while width < GEAR_BYTES:
        longer = total.copy()
        longer[width:] += total[:-width] << np.uint32(width)
        total = longer
        width *= 2
    return total


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words begin: behind white space, and at every wide character."""
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1] | _WIDE[data[1:]]
    return np.flatnonzero(starts)


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a chunk; the first word does."""
    n = len(starts)
    rating = gear_hashes(data)[np.maximum(starts - 1, 0)]
    best = np.ones(n, bool)
    for k in range(1, SPREAD + 1):
        best[k:] &= rating[k:] > rating[:-k]
        best[:-k] &= rating[:-k] >= rating[k:]
    best[:1] = True
    cuts = np.flatnonzero(best)
    gaps = np.diff(np.append(cuts, n))
    for at, gap in zip(cuts[gaps > MAX_WORDS].tolist(), gaps[gaps > MAX_WORDS].tolist()):
        best[np.arange(at, at + gap, MAX_WORDS)] = True
    return np.flatnonzero(best)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests: list[bytes] = []
        places: list[np.ndarray] = []
        counts = []
        for text in batch.column("text"):
            raw = text.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            data = np.frombuffer(raw, np.uint8)
            starts = word_starts(data)
            if not len(starts):
                counts.append(0)
                continue
            firsts = chunk_starts(data, starts)
            begins = starts[firsts].tolist()
            ends = [*begins[1:], len(raw)]
            digests += [xxhash.xxh3_128_digest(raw[a:b].rstrip()) for a, b in zip(begins, ends)]
            words = np.diff(np.append(firsts, len(starts)))
            around = np.concatenate(([0], words, [0]))
            # first word, words, words of the chunks before and behind: in one number
            places.append((firsts << 24) | (words << 16) | (around[:-2] << 8) | around[2:])
            counts.append(len(firsts))
        if not digests:
            continue
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(both[:, 0]),
                pa.array(both[:, 1]),
                pa.array(np.repeat(batch.column("rank").to_numpy(), counts)),
                pa.array(np.repeat(batch.column("row_key").to_numpy(), counts)),
                pa.array(np.concatenate(places)),
            ],
            names=["d1", "d2", "rank", "row_key", "place"],
        )


def row_key() -> Column:
    """A key of a row; rows of equal doc_id and text share it."""
    return F.xxhash64("doc_id", "text")


def _rank() -> Column:
    """The doc_id; without one, a number of the text beyond all usual ids."""
    beyond = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(F.col("doc_id").cast("long"), beyond)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """A row per repeated passage: row_key, doc_id, first_word, n_words, most_words, kept_in.

    Words are runs between white space; ``first_word`` counts from 0. The passage is made of whole chunks;
    with what it may cover besides at its edges it has ``most_words``, at least ``min_words``.
    The document with the smallest id that holds a chunk keeps it (``kept_in``, for the first chunk; null if
    that document has no id). Rows of one doc_id are one document, whose own repeats are left alone; rows
    without an id come last. Texts that are null or without words hold no chunk. Other columns are ignored.
    """
    prepared(docs.sparkSession)
    keyed = docs.select(row_key().alias("row_key"), _rank().alias("rank"), "text")
    chunks = keyed.mapInArrow(_chunked, CHUNK_SCHEMA)
    # Only smallest and largest rank are kept of each digest, summed before the shuffle.
    known = chunks.groupBy("d1", "d2").agg(F.min("rank").alias("kept"), F.max("rank").alias("last"))
    known = known.where("kept <> last").select("d1", "d2", "kept")
    again = chunks.join(known.hint("shuffle_hash"), ["d1", "d2"]).where("rank <> kept")
    spread = again.select(
        "row_key",
        "rank",
        "kept",
        F.shiftright("place", 24).alias("first_word"),
        F.shiftright("place", 16).bitwiseAND(F.lit(255)).alias("words"),
        F.shiftright("place", 8).bitwiseAND(F.lit(255)).alias("words_before"),
        F.col("place").bitwiseAND(F.lit(255)).alias("words_behind"),
    )
    if_repeated = spread.groupBy("row_key", "rank", "first_word").agg(
        *[F.min(c).alias(c) for c in ("kept", "words", "words_before", "words_behind")]
    )
    along = Window.partitionBy("row_key").orderBy("first_word").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("first_word") - F.coalesce(F.sum("words").over(along), F.lit(0))
    passages = (
        if_repeated.withColumn("run", run)
        .groupBy("row_key", "rank", "run")
        .agg(
            F.min("first_word").alias("first_word"),
            F.sum("words").alias("n_words"),
            F.min_by("words_before", "first_word").alias("words_before"),
            F.max_by("words_behind", "first_word").alias("words_behind"),
            F.min_by("kept", "first_word").alias("kept"),
        )
        .withColumn("most_words", F.col("n_words") + F.col("words_before") + F.col("words_behind") + EDGE_WORDS)
        .where((F.col("n_words") >= run_words) & (F.col("most_words") >= min_words))
    )
    known_id = lambda c: F.when(F.col(c) < (1 << 62), F.col(c))
    return passages.select(
        "row_key",
        known_id("rank").alias("doc_id"),
        "first_word",
        "n_words",
        "most_words",
        known_id("kept").alias("kept_in"),
    )


def without_passages(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text`` and ``n_chars`` (if any) counted anew.

    A row of which no word is left goes; rows that had no word from the start stay. Other columns are kept.
    """
    passages = repeated_passages(docs, **options)
    key, spans_of = free_name(docs, "row_key"), free_name(docs, "cuts")
    cuts = cut_lineage(
        passages.groupBy(F.col("row_key").alias(key)).agg(
            F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(spans_of)
        )
    )
    joined = docs.withColumn(key, row_key()).join(cuts.hint("merge"), key, "left")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(spans_of).to_pylist()
            texts = batch.column("text").to_pylist()
            keep = []
            for k, own in enumerate(spans):
                if own:
                    texts[k] = _without(texts[k], own)
                keep.append(not own or bool(texts[k]))
            place = batch.schema.get_field_index("text")
            changed = batch.set_column(place, "text", pa.array(texts, batch.schema.field("text").type))
            if "n_chars" in names:
                place = batch.schema.get_field_index("n_chars")
                old = batch.column("n_chars").to_pylist()
                sizes = [len(t) if own else n for t, own, n in zip(texts, spans, old)]
                changed = changed.set_column(place, "n_chars", pa.array(sizes, batch.schema.field("n_chars").type))
            yield changed.select(names).filter(pa.array(keep, pa.bool_()))

    return joined.select(*names, spans_of).mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[dict]) -> str:
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    starts = np.append(word_starts(data), len(raw))
    left, at = [], 0
    for span in spans:
        begin, end = span["first_word"], span["first_word"] + span["n_words"]
        left.append(raw[at : starts[begin]])
        at = int(starts[end])
    left.append(raw[at:])
    return b"".join(left).decode("utf-8").strip()
