"""Benchmark items in documents, found through templates: also with other numbers, names and units.

A text becomes a template: numbers, units behind numbers, and names (capitalised words inside a sentence, runs
of them as one) are typed placeholders, all other words their lower-case form without punctuation around them.
Windows of a document's template meet the items' windows in a hash join; a bitmap of fixed size lets only
windows into it that some item may have. Windows of one document and item on one diagonal are an alignment;
it counts if its slots are consistent: the same value of the item always became the same value of the
document, and different ones different ones. Where they are not, the alignment is split at the conflict, and
its consistent spans count if they are long enough by themselves. Windows of the words as they are written
(numbers, names and bare signs too) meet in the same join, for exact copies of items that are short or nearly
all placeholders.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.llm.shingles import mixed, windows
from netspark.llm.workers import free_name, prepared, runs, worker_state
from netspark.session import cut_lineage

#: Words and placeholders of a window; shorter items are windows of their own length, down to LEAST_WINDOW.
WINDOW, LEAST_WINDOW = 8, 5
#: Words, not placeholders, that a window must have.
LEAST_WORDS = 3
#: Words and placeholders of an item that must be covered, or the whole item if it is shorter.
COVERED = 13
#: Bits of the bitmap: 2 MB whatever the benchmark's size; a full one only lets more windows into the join.
BITMAP_BITS = 1 << 24
#: Tokens that a worker remembers.
CACHE_TOKENS = 300_000
#: Bytes of texts whose tokens are looked up together, or one longer text.
PART_BYTES = 4 << 20
#: Sets literal windows apart from those of templates.
LITERAL = 1 << 32

# Common units of measure and money.
UNITS = set(
    "mm cm m km in ft mi mile miles yard yards inch inches feet foot mg g kg t lb lbs oz gram grams kilogram "
    "kilograms ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre "
    "kilometres percent % $ usd eur gbp dollar dollars euro euros pound pounds cent cents mph kmh w kw mw v a hz "
    "j kj cal kcal degree degrees".split()
)

WORD, NUMBER, NAME, UNIT, NUMBER_UNIT, BREAK = range(6)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: What most edges are made of, and what tokens with an end of a sentence end in.
_SIGNS = string.punctuation + string.whitespace
_ENDS = (".", "!", "?", ":", '"', "'", ")", "]", "}")
_NUMBER = re.compile(r"[\d][\d.,:/-]*")
_NUMBER_UNIT = re.compile(r"([\d][\d.,:/-]*)([^\W\d_]+)")
_PLACEHOLDERS = mixed(np.array([0, 101, 102, 103, 104, 0], np.uint64))


class Tokens(dict):
    """A number for each token as it is written; by number: kind, hashes in lower case
    and as written, flags (end of sentence, unit, capitalised, blank)."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.columns = tuple(np.zeros(0, kind) for kind in (np.int8, np.uint64, np.int8, np.uint64))
        self.added: list[tuple[int, int, int, int]] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        if token.isalpha() and token.islower():  # most are plain words
            low = token.lower()
            own = written = xxhash.xxh3_64_intdigest(token.encode())
            if low != token:
                own = xxhash.xxh3_64_intdigest(low.encode())
            self.added.append((WORD, own, (low in UNITS) << 1, written))
            return number
        core = token.strip(_SIGNS)
        if core and not (core[0].isalnum() and core[-1].isalnum()):
            core = _EDGES.sub("", core)
        low = core.lower()
        ends = token.endswith(_ENDS) and token.rstrip("\"')]}").endswith((".", "!", "?", ":")) or token == "\n"
        unit = low in UNITS or not core and token.strip() in UNITS
        proper = core[:1].isupper() and (len(core) == 1 or not core.isupper())
        if not core:
            kind = UNIT if unit else BREAK
        elif not core[0].isdecimal():
            kind = WORD
        elif _NUMBER.fullmatch(core):
            kind = NUMBER
        elif (match := _NUMBER_UNIT.fullmatch(core)) and match[2].lower() in UNITS:
            kind = NUMBER_UNIT
        else:
            kind = WORD
        own = xxhash.xxh3_64_intdigest((low or token).encode("utf-8", "surrogatepass"))
        written = own if core == low else xxhash.xxh3_64_intdigest(core.encode("utf-8", "surrogatepass"))
        blank = not core and not token.strip()
        self.added.append((kind, own, ends | unit << 1 | proper << 2 | blank << 3, written))
        return number

    def look_up(self, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kind, hash, flags and hash as written of each token; different ones are looked up once."""
        if len(self) > CACHE_TOKENS:
            self.reset()
        coded = tokens.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        if self.added:
            self.columns = tuple(
                np.concatenate((known, np.array(more, known.dtype))) for known, more in zip(self.columns, zip(*self.added))
            )
            self.added = []
        at = own[coded.indices.to_numpy()]
        return tuple(known[at] for known in self.columns)


def looked_up(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Kind, hash, flags and hash as written of each token of texts, and the place of its text."""
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
    tokens = split.flatten().cast(pa.string())
    if not len(tokens):
        return (*(np.zeros(0, kind) for kind in (np.int8, np.uint64, np.int8, np.uint64)), np.zeros(0, np.int64))
    text_of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    return *worker_state("template tokens", Tokens).look_up(tokens), text_of


def canonical(
    kind: np.ndarray, value: np.ndarray, flags: np.ndarray, text_of: np.ndarray, inside: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, slot values (0 for words), slot kinds (0 for words) and first tokens of texts, which
    ``text_of`` tells apart; ``inside``: as one would be in the middle of a sentence, where a capitalised first
    word is a name."""
    ends = (flags & 1).astype(bool)
    solid = np.flatnonzero(kind != BREAK)
    if not len(solid):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8), solid
    gone = np.cumsum(ends)
    # Begins a sentence: only breaks lie between it and an end, or the beginning.
    opens = np.ones(len(solid), bool)
    opens[1:] = gone[solid[1:] - 1] > np.where(solid[:-1] > 0, gone[solid[:-1] - 1], 0)
    same = np.zeros(len(solid), bool)  # stands in the text of the one before it
    same[1:] = text_of[solid[1:]] == text_of[solid[:-1]]
    opens[~same] = not inside
    kind, value, flags = kind[solid], value[solid], flags[solid]
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == NUMBER) & same[1:]
    kind[after_number & ((flags >> 1) & 1).astype(bool) & ((kind == WORD) | (kind == UNIT))] = UNIT
    kind[(kind == UNIT) & ~after_number] = WORD
    kind[(kind == WORD) & ((flags >> 2) & 1).astype(bool) & ~opens] = NAME
    # A run of names is one slot; its value is made of all of them.
    names = kind == NAME
    if names.any():
        again = np.zeros(len(kind), bool)
        again[1:] = names[1:] & names[:-1] & same[1:]
        first = np.flatnonzero(~again)
        joined = np.add.reduceat(np.where(names, mixed(value), np.uint64(0)), first)
        kind = kind[first]
        value = np.where(kind == NAME, joined, value[first])
        solid = solid[first]
    slots = kind != WORD
    return np.where(slots, _PLACEHOLDERS[kind], value), np.where(slots, value, np.uint64(0)), kind, solid


def literal(written: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens but blank ones, also of numbers, names and bare signs, and their places."""
    own = np.flatnonzero(flags & 8 == 0)
    return written[own], own


def literal_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    return windows(hashes, width) ^ np.uint64(width | LITERAL)


def document_windows(
    texts: pa.Array, widths: list[int], literal_widths: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Per width: the windows' hashes, texts, places in their texts and among all tokens, and the tokens' slot values.

    Windows of the template have enough words; literal ones are all there are, and have no slots. None lies
    across two texts. Null texts have none.
    """
    kind, value, flags, written, text_of = looked_up(texts)
    hashes, values, kinds, solid = canonical(kind, value, flags, text_of)
    words = np.concatenate(([0], np.cumsum(kinds == WORD)))
    own = text_of[solid]
    for width in widths:
        enough = _inside(own, width)
        enough = enough[words[enough + width] - words[enough] >= LEAST_WORDS]
        found = windows(hashes, width)[enough] ^ np.uint64(width)
        yield width, found, own[enough], enough - np.searchsorted(own, own[enough]), enough, values
    hashes, solid = literal(written, flags)
    own = text_of[solid]
    for width in literal_widths:
        every = _inside(own, width)
        found = literal_windows(hashes, width)[every]
        yield width, found, own[every], every - np.searchsorted(own, own[every]), every, None


def _inside(text_of: np.ndarray, width: int) -> np.ndarray:
    """Where windows begin that lie in one text."""
    n = max(len(text_of) - width + 1, 0)
    return np.flatnonzero(text_of[:n] == text_of[width - 1 : width - 1 + n])


def _slots(values: np.ndarray | None, at: int, width: int) -> tuple[list[int], list[int]]:
    if values is None:
        return [], []
    inside = np.flatnonzero(values[at : at + width])
    return inside.tolist(), values[at : at + width][inside].view(np.int64).tolist()


_WINDOW_FIELDS = "hash long, place int, width int, slots array<int>, slot_values array<long>"
_SPAN_FIELDS = "row_key long, item_key long, n_item int, first int, last int, changed int, enough int"
_KINDS = {"key": pa.int64(), "hash": pa.int64(), "slots": pa.list_(pa.int32()), "slot_values": pa.list_(pa.int64())}


def item_windows_of(text: str | None) -> tuple[int, list[tuple]]:
    """Size of an item, and its windows: hash, place, width, slots, values, first and last place covered, literal.

    A first word that is a name inside a sentence gives another first window; where it joins a name behind it,
    the places count as if the joined name stood in the second one. Literal windows count tokens as they are
    written; ``literal`` is the number of those that the item has, 0 in windows of the template. What they cover
    are words and placeholders that they touch.
    """
    if not text:
        return 0, []
    kind, value, flags, written, one = looked_up(pa.array([text], pa.string()))
    variants = [canonical(kind, value, flags, one), canonical(kind, value, flags, one, inside=True)]
    size = len(variants[0][0])
    found = []
    for inside, variant in enumerate(variants):
        hashes, values, kinds, _ = variant
        width = min(WINDOW, len(hashes))
        if width < LEAST_WINDOW or (inside and np.array_equal(kinds, variants[0][2])):
            continue
        shift = size - len(hashes)
        words = np.concatenate(([0], np.cumsum(kinds == WORD)))
        for at, h in enumerate((windows(hashes, width) ^ np.uint64(width)).view(np.int64).tolist()[: 1 if inside else None]):
            if words[at + width] - words[at] >= LEAST_WORDS:
                first = at if inside else at + shift
                found.append((h, at + shift, width, *_slots(values, at, width), first, at + shift + width - 1, 0))
    hashes, own = literal(written, flags)
    touched = np.maximum(np.searchsorted(variants[0][3], own, "right") - 1, 0).tolist()
    width = min(WINDOW, len(hashes))
    if width:
        for at, h in enumerate(literal_windows(hashes, width).view(np.int64).tolist()):
            found.append((h, at, width, [], [], touched[at], touched[at + width - 1], len(hashes)))
    return max(size, min(1, len(hashes))), found


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the windows of each item."""
    names = ("key", "hash", "place", "width", "slots", "slot_values", "first", "last", "literal", "size")
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in names}
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            size, found = item_windows_of(text.as_py())
            for window in found:
                for name, value in zip(names, (key, *window, size)):
                    rows[name].append(value)
        if rows["key"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, _KINDS.get(k, pa.int32())) for k, v in rows.items()})


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Some texts at a time, PART_BYTES of them or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _window_rows(widths: list[int], literal_widths: list[int], bitmap):
    """Rows of the windows of each document that a bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("key", "hash", "place", "width", "slots", "slot_values")}
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for part in _parts(batch.column("text")):
                for width, hashes, text, places, at, values in document_windows(part, widths, literal_widths):
                    slot = hashes >> np.uint64(40)
                    hit = bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                    some = np.flatnonzero(hit)
                    own = (keys[text[some]], hashes[some].view(np.int64), places[some], at[some])
                    for key, h, place, begin in zip(*(x.tolist() for x in own)):
                        for name, value in zip(rows, (key, h, place, width, *_slots(values, begin, width))):
                            rows[name].append(value)
                keys = keys[len(part) :]
            if rows["key"]:
                yield pa.RecordBatch.from_pydict({k: pa.array(v, _KINDS.get(k, pa.int32())) for k, v in rows.items()})

    return run


def consistent_spans(
    places: list[int], pairs: dict[int, tuple[int, int]]
) -> Iterator[tuple[int, int, bool]]:
    """First and last of the longest spans of neighbouring ``places`` whose slots are consistent, and if one changed.

    ``pairs``: by place, the slot's value in the item and in the document. Spans overlap where a conflict lies
    between two slots; an alignment without conflicts is one span for each stretch without a gap.
    """
    there: dict[int, list[int]] = {}  # a value of the item: what it became, and how often in the span
    back: dict[int, int] = {}
    changed = 0
    low = 0

    for high, place in enumerate(places):
        if high and place != places[high - 1] + 1:
            yield places[low], places[high - 1], changed > 0
            low, changed = high, 0
            there.clear()
            back.clear()
        if place not in pairs:
            continue
        old, new = pairs[place]
        told = False
        while (old in there and there[old][0] != new) or back.get(new, old) != old:
            if not told:
                yield places[low], places[high - 1], changed > 0
                told = True
            gone = pairs.get(places[low])
            low += 1
            if gone is not None:
                changed -= gone[0] != gone[1]
                there[gone[0]][1] -= 1
                if not there[gone[0]][1]:
                    del there[gone[0]], back[gone[1]]
        there.setdefault(old, [new, 0])[1] += 1
        back[new] = old
        changed += old != new
    if places:
        yield places[low], places[-1], changed > 0


def _alignments(covered: int):
    """Spans of the item that each diagonal covers: all of a consistent one, of others the long consistent spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row_key", "item_key", "n_item", "first", "last", "changed", "enough")
        for found, bounds in runs(batches, ["row_key", "item_key", "literal", "diagonal"]):
            rows: dict[str, list] = {k: [] for k in names}
            data = found.to_pydict()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                places: set[int] = set()
                begins: dict[int, int] = {}  # what literal windows that begin or end at a place cover
                ends: dict[int, int] = {}
                own_size = data["literal"][low]
                pairs: dict[int, tuple[int, int]] = {}
                for k in range(low, high):
                    at = data["item_place"][k]
                    if own_size:
                        begins[at], ends[at + data["width"][k] - 1] = data["first"][k], data["last"][k]
                    places.update(range(at if own_size else data["first"][k], at + data["width"][k]))
                    for slot, old, new in zip(data["slots"][k], data["item_values"][k], data["doc_values"][k]):
                        if old == new or at + slot not in pairs:
                            pairs[at + slot] = old, new
                forth, back = {}, {}
                sound = all(
                    forth.setdefault(old, new) == new and back.setdefault(new, old) == old for old, new in pairs.values()
                )
                spans = list(consistent_spans(sorted(places), pairs))
                need = min(covered, own_size or data["n_item"][low])
                long = [last - first + 1 >= need for first, last, _ in spans]
                if own_size:
                    spans = [(begins[first], ends[last], False) for first, last, _ in spans]
                elif sound:
                    changed = any(span[2] for span in spans)
                    spans = [(first, last, changed) for first, last, _ in spans]
                for (first, last, changed), enough in zip(spans, long):
                    if not enough and (own_size or not sound):
                        continue
                    row = (data["row_key"][low], data["item_key"][low], data["n_item"][low])
                    own = (*row, first, last, int(changed), int(enough))
                    for name, value in zip(names, own):
                        rows[name].append(value)
            if rows["row_key"]:
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(rows.values(), kinds)], names=list(names)
                )

    return run


def row_key() -> Column:
    """A key of a row; rows of equal doc_id and text share it."""
    return F.xxhash64("doc_id", "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: int = COVERED) -> DataFrame:
    """A row per document and item found in it: row_key, doc_id, item_id, n_covered, n_item, share, verbatim.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. Found means that consistent alignments, and consistent
    spans of that length in others, cover at least ``covered`` words and placeholders of the item, or all of a
    shorter one, or that as many words of it, or all, follow each other as they are written. Of items below
    LEAST_WINDOW words and placeholders, and where nearly all are placeholders, only such exact copies are
    found; an item of one word is found wherever that word stands.
    ``verbatim``: every slot covered kept its value. Null and empty texts have no windows. Items with null or
    repeated ids are told apart by their text; repeated rows of documents are one. Other columns are
    ignored. The order of the result is open.
    """
    spark = prepared(docs.sparkSession)
    fields = f"key long, {_WINDOW_FIELDS}"
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("item_id", "text").alias("key")
    ).dropDuplicates(["key"])
    item_windows = cut_lineage(items.select("key", "text").mapInArrow(_item_rows, f"{fields}, first int, last int, literal int, size int"))
    # At most the bits of the bitmap come here, and the widths up to WINDOW.
    bit = F.shiftrightunsigned("hash", 40)
    bits = np.zeros(BITMAP_BITS, bool)
    bits[[row.bit for row in item_windows.select(bit.alias("bit")).distinct().toLocalIterator()]] = True
    sizes = item_windows.select("width", (F.col("literal") > 0).alias("literal")).distinct().collect()
    widths, literal_widths = (sorted(row.width for row in sizes if row.literal == kind) for kind in (False, True))
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())

    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    doc_windows = keyed.select("key", "text").mapInArrow(_window_rows(widths, literal_widths, bitmap), fields)
    seen = doc_windows.select(
        F.col("key").alias("row_key"), "hash", "width", F.col("place").alias("doc_place"), "slots",
        F.col("slot_values").alias("doc_values"),
    ).distinct()
    known = item_windows.select(
        F.col("key").alias("item_key"), "hash", "width", F.col("place").alias("item_place"), "slots",
        F.col("slot_values").alias("item_values"), "first", "last", "literal",
        F.col("size").alias("n_item"),
    )
    met = cut_lineage(
        seen.join(known, ["hash", "width", "slots"]).withColumn("diagonal", F.col("doc_place") - F.col("item_place"))
    )
    diagonal = ["row_key", "item_key", "literal", "diagonal"]
    spans = (
        met.select(*diagonal, "item_place", "first", "last", "width", "slots", "item_values", "doc_values", "n_item")
        .repartition(*diagonal)
        .sortWithinPartitions(*diagonal, "item_place")
        .mapInArrow(_alignments(covered), _SPAN_FIELDS)
    )
    found = (
        spans.withColumn("at", F.explode(F.sequence("first", "last")))
        .groupBy("row_key", "item_key", "n_item", "at")
        .agg(F.min("changed").alias("changed"), F.max("enough").alias("enough"))
        .groupBy("row_key", "item_key", "n_item")
        .agg(
            F.count(F.lit(1)).alias("n_covered"),
            F.max("changed").alias("changed"),
            F.max("enough").alias("enough"),
        )
        .where((F.col("n_covered") >= F.least(F.lit(covered), F.col("n_item"))) | (F.col("enough") > 0))
    )
    names = items.select(F.col("key").alias("item_key"), "item_id")
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
    return (
        found.join(names, "item_key")
        .join(rows.distinct(), "row_key")
        .select(
            "row_key",
            "doc_id",
            "item_id",
            "n_covered",
            F.col("n_item").cast("long").alias("n_item"),
            (F.col("n_covered") / F.col("n_item")).alias("share"),
            (F.col("changed") == 0).alias("verbatim"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    key = free_name(docs, "row_key")
    found = cut_lineage(contaminated(docs, benchmark, **options).select(F.col("row_key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(found, key, "left_anti").select(*docs.columns)
