"""SentencePiece ids by a score-ordered agenda of adjacent symbol pairs, checked against the library.

A merge-type vocabulary is applied to a text as the library does it: the text starts as one symbol per
character; an agenda holds every pair of neighbours that is a piece, best score first, leftmost among equals;
the first pair is merged, its symbol forms new pairs with its neighbours, and entries whose symbols have changed
since are skipped. A symbol that is no piece becomes its bytes.

Merges never cross a place that no piece spans, so a text falls into segments that are encoded alone: before
blanks, and around characters that stand in no longer piece (digits, say). Where these places are is read off
the vocabulary. Frequent segments are remembered.

Each Arrow batch is checked against the library: the segments that were encoded for it, put in a row between
line feeds, are encoded by the library as well, so that every remembered segment has been compared once;
so is one whole text of the batch, and all texts are decoded by the library. A difference ends the task with an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm.workers import free_name, prepared, worker_state

#: How the library writes a blank.
BLANK = "▁"
#: Letters that segments may end behind, if the vocabulary allows it.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
#: A segment of so few characters has its agenda in a list, a longer one in a heap.
FEW_SYMBOLS = 40
NO_PIECE = 1 << 31
#: Segments remembered in each of two generations (about 0.2 kB each); longer ones are encoded each time.
CACHE_SEGMENTS, CACHE_CHARS = 250_000, 64
#: Characters that the library encodes in one call when it checks a batch.
CHECK_CHARS = 4_000_000


class PieceVocabulary:
    """Pieces of a model file and how they apply to texts."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.end_id = lib.eos_id()
        if self.end_id < 0:
            raise ValueError("the model has no end id")
        self.ids: dict[str, int] = {}
        self.surfaces: list[str] = []
        self.byte_values: dict[int, int] = {}
        byte_ids = [-1] * 256
        scores: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if lib.is_byte(i):
                value = int(piece[1:-1], 16)
                byte_ids[value], self.byte_values[i] = i, value
            special = lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)
            self.surfaces.append("" if special else piece.replace(BLANK, " "))
            if not special:
                self.ids[piece], scores[piece] = i, lib.get_score(i)
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte pieces to fall back on")
        if lib.normalize(" a  ﬁ① ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}ﬁ①{BLANK}":
            raise ValueError("only models that leave texts as they are, with a blank put before them, are supported")
        self.byte_ids = byte_ids
        self.decimals = list(map(str, range(n)))
        places = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: By piece: 0 for the best score; equal scores have equal ranks.
        self.ranks = {piece: places[score] for piece, score in scores.items()}
        # Where ids and scores go the same way, an id says its rank. Pieces of equal score (rows of blanks) are
        # left out; segments that may need them are merged as strings.
        self.pairs: dict[int, int] = {}
        self.characters: dict[str, int] = {}
        ordered = [self.ranks[p] for p in sorted(self.ids, key=self.ids.get)]
        often = {r for r, n in Counter(ordered).items() if n > 1}
        distinct = [r for r in ordered if r not in often]
        equal = {p for p in self.ids if self.ranks[p] in often}
        if n <= 1 << 15 and distinct == sorted(distinct) and all(set(p) == {BLANK} for p in equal):
            for piece, known in self.ids.items():
                if len(piece) == 1:
                    self.characters[" " if piece == BLANK else piece] = known
                elif self.ranks[piece] not in often:
                    for cut in range(1, len(piece)):
                        left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                        if left is not None and right is not None:
                            self.pairs[left << 15 | right] = known
        #: No piece has a line feed beside another character.
        self.apart = not any("\n" in p and len(p) > 1 for p in self.ids) and not any(
            BLANK in p.lstrip(BLANK) for p in self.ids
        )
        self.segment = re.compile(_segment_pattern(p for p in self.ids if len(p) > 1))

    def merged(self, symbols: list[str]) -> list[str]:
        """The pieces that the agenda makes of a row of symbols; ends of the row are ends of the text."""
        return self._merged_few(symbols) if len(symbols) <= FEW_SYMBOLS else self._merged_many(symbols)

    def _merged_few(self, symbols: list[str]) -> list[str]:
        """The agenda as a list, one entry between each two symbols: the first best one is next."""
        rank = self.ranks.get
        agenda = [rank(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NO_PIECE:
                break
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + symbols[at], NO_PIECE)
            if at < len(agenda):
                agenda[at] = rank(symbols[at] + symbols[at + 1], NO_PIECE)
        return symbols

    def _merged_ids(self, ids: list[int]) -> list[int]:
        """The same for a segment of known characters as ids, where a lower id is a better score."""
        pair = self.pairs.get
        agenda = [pair(a << 15 | b, NO_PIECE) for a, b in zip(ids, ids[1:])]
        while agenda:
            best = min(agenda)
            if best == NO_PIECE:
                break
            at = agenda.index(best)
            ids[at] = best
            del ids[at + 1], agenda[at]
            if at:
                agenda[at - 1] = pair(ids[at - 1] << 15 | best, NO_PIECE)
            if at < len(agenda):
                agenda[at] = pair(best << 15 | ids[at + 1], NO_PIECE)
        return ids

    def _merged_many(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols; entries of symbols that changed are skipped."""
        rank = self.ranks.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for left in range(n - 1):
            pair = symbols[left] + symbols[left + 1]
            if pair in self.ranks:
                agenda.append((self.ranks[pair], left, left + 1, len(pair)))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            for one, other in ((before[left], left), (left, after[left])):
                if one >= 0 and other >= 0:
                    pair = symbols[one] + symbols[other]
                    found = rank(pair, NO_PIECE)
                    if found != NO_PIECE:
                        heapq.heappush(agenda, (found, one, other, len(pair)))
        return [s for s in symbols if s]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of a segment in which blanks are blanks."""
        if len(segment) <= FEW_SYMBOLS and not segment.startswith("  "):
            known = list(map(self.characters.get, segment))
            if None not in known:
                return self._merged_ids(known)
        out: list[int] = []
        for piece in self.merged(list(segment.replace(" ", BLANK))):
            known = self.ids.get(piece)
            out += [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are nothing, runs of byte ids are UTF-8, the blank put before goes."""
        surfaces, byte_values = self.surfaces, self.byte_values
        if byte_values.keys().isdisjoint(ids):
            text = "".join([surfaces[i] for i in ids])
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                value = byte_values.get(i)
                if value is not None:
                    run.append(value)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(surfaces[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text.removeprefix(" ")


def _segment_pattern(pieces: Iterator[str]) -> str:
    """A pattern whose matches cover a text and between which no piece of several characters can lie."""
    bare = [(p, p.lstrip(BLANK)) for p in pieces]
    if any(BLANK in rest for _, rest in bare):
        return r"(?s).+"  # pieces reach across words: the text is one segment
    used = set("".join(p for p, _ in bare))
    alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in used and chr(c) != " ")
    single = f"|[{alone}]" if alone else ""
    kinds = [[c in LETTERS for c in rest] for _, rest in bare]
    if all(all(k) or not any(k) for k in kinds):  # no piece mixes letters and other characters
        letters = re.escape(LETTERS)
        return rf" +(?:[{letters}]+|[^ {letters}{alone}]*)|[{letters}]+|[^ {letters}{alone}]+{single}"
    return rf" +[^ {alone}]*|[^ {alone}]+{single}"


class SegmentIds(dict):
    """Ids of segments. When the newer generation is full it becomes the older one, so that segments in use
    stay; a missing one comes from the older generation or is encoded."""

    def __init__(self, vocabulary: PieceVocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[int, ...]] = {}
        #: Segments encoded since the last check.
        self.fresh: list[str] = []

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.older.get(segment)
        if ids is None:
            ids = tuple(self.vocabulary.segment_ids(segment))
            self.fresh.append(segment)
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def ids(self, text: str | None) -> list[int]:
        """Ids of a whole text with the end id; a null text is an empty one."""
        found: list[int] = []
        if text:
            whole = " " + text.replace(BLANK, " ")
            found = list(chain.from_iterable(map(self.__getitem__, self.vocabulary.segment.findall(whole))))
        found.append(self.vocabulary.end_id)
        return found


def segment_ids(model: str) -> SegmentIds:
    return worker_state(f"segments:{model}", lambda: SegmentIds(PieceVocabulary(model)))


def check_segments(cache: SegmentIds) -> None:
    """Compare the segments encoded since the last check with the library's ids."""
    vocabulary, fresh = cache.vocabulary, cache.fresh
    cache.fresh = []
    lead, feed = vocabulary.library.encode("\n"), vocabulary.segment_ids("\n")
    at = 0
    while at < len(fresh):
        # No piece reaches over a line feed, so segments stay apart in a row of them.
        row, expected, chars = [], list(lead), 0
        while at < len(fresh) and (chars == 0 or chars + len(fresh[at]) <= CHECK_CHARS):
            segment = fresh[at]
            row += "\n", segment
            expected += feed if chars else ()
            expected += cache[segment] if segment in cache else vocabulary.segment_ids(segment)
            chars += len(segment)
            at += 1
        if vocabulary.library.encode("".join(row)) != expected:
            raise RuntimeError("ids differ from those of the sentencepiece library")


def check_texts(cache: SegmentIds, texts: list[str], ids: list[list[int]]) -> None:
    """Compare the ids of whole texts with the library's."""
    if cache.vocabulary.library.encode(texts, add_bos=False, add_eos=True, num_threads=1) != ids:
        raise RuntimeError("ids differ from those of the sentencepiece library")


def check_decoded(cache: SegmentIds, ids: list[list[int]], decoded: list[str]) -> None:
    """Compare decoded texts with the library's."""
    if cache.vocabulary.library.decode(ids, num_threads=1) != decoded:
        raise RuntimeError("decoded texts differ from those of the sentencepiece library")


def check_batch(cache: SegmentIds, texts: list[str], ids: list[list[int]], decoded: list[str], number: int = 0) -> None:
    """Compare a batch with the library's own ids and texts; ``number`` chooses the text that is compared whole."""
    if cache.vocabulary.apart:
        check_segments(cache)
        whole = number % len(texts) if texts else 0
        check_texts(cache, texts[whole : whole + 1], ids[whole : whole + 1])
    else:
        cache.fresh.clear()
        check_texts(cache, texts, ids)
    check_decoded(cache, ids, decoded)


def encoded(docs: DataFrame, model: str, text: str = "text", output: str = "ids", check: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text`` (array<int>, with the end id) in a new column, and the text that they
    decode to in ``<output>_text``; a taken name gets underscores before it.

    Null and empty texts have the end id only and decode to an empty text. Texts are encoded whole however long;
    rows are independent, so repeats and ties stay, and an empty table gives an empty one.
    """
    return _mapped(docs, model, text, output, check, digests=False)


def digests(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256 and decoded_sha256 of its ids and decoded text.

    Digests are lowercase hex of SHA-256, of the decimal ids joined by blanks and of the decoded text in UTF-8.
    Same cases as in ``encoded``.
    """
    return _mapped(docs, model, text, "", check, digests=True)


def _mapped(docs: DataFrame, model: str, text: str, output: str, check: bool, digests: bool) -> DataFrame:
    prepared(docs.sparkSession)
    if digests:
        kept = docs.drop(text)
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        types = [T.LongType(), T.StringType(), T.StringType()]
    else:
        kept = docs
        names, types = [output, f"{output}_text"], [T.ArrayType(T.IntegerType()), T.StringType()]
    for k, name in enumerate(names):
        names[k] = free_name(kept, name)
    inner = free_name(docs, "_piece_text")
    carried = kept.columns
    source = docs.select(*carried, F.col(text).cast("string").alias(inner))
    schema = T.StructType(kept.schema.fields)
    for name, kind in zip(names, types):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = segment_ids(model)
        decode, names_of = cache.vocabulary.decode, cache.vocabulary.decimals.__getitem__
        for number, batch in enumerate(batches):
            texts = [t or "" for t in batch.column(inner).to_pylist()]
            ids = [cache.ids(t) for t in texts]
            decoded = [decode(i) for i in ids]
            if check:
                check_batch(cache, texts, ids, decoded, number)
            if digests:
                made = [
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(names_of, i)).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ]
            else:
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            old = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*old, *made], names=[*carried, *names])

    return source.mapInArrow(run, schema)
