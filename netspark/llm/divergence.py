"""How the words of sources differ within a language, counted over fixed-width digests.

Texts are read twice, and counted where they are read, in bounded blocks per task. The first reading counts the
documents of each term by (lang, digest), with the smallest and the largest string of each digest: where they
differ, terms share a digest and are told apart by their strings from there on. Few terms are in enough documents
to be kept. The second reading counts kept terms per source and shuffles digests and counts alone; a bitmap of
fixed size holds back most of the others, and a join decides. Strings come back for the rows that are put out.

All values are integers:

    p = 1 + floor(1000000000 * (count + 1) / (N + V))      q likewise
    f = floor((p - q) * (p - q) / q)

For two sources f is summed over all kept terms of their language. With p0 for a count of 0,

    sum f(p, q) = V f(p0, q0) + sum over the first's terms of f(p, q0) - f(p0, q0)
                + sum over the second's terms of f(p0, q) - f(p0, q0)
                + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

so only the last sum looks at two sources of a term; tasks add it up by pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm.workers import column, prepared, runs
from netspark.session import cut_lineage

UNIT = 1_000_000_000
#: Terms of texts, or bytes of texts, that a task counts together; an Arrow batch is not divided.
TASK_TERMS, TASK_BYTES = 4_000_000, 64 << 20
#: Rows of an Arrow batch, and bytes of terms at which it ends sooner.
OUT_ROWS, OUT_BYTES = 20_000, 16 << 20
#: 64-bit words of the bitmaps of digests (2 MB).
BITMAP_WORDS = 1 << 18
#: Pairs of sources of common terms that are held at once.
PAIR_BLOCK = 1 << 18

#: ASCII bytes that are no letters separate terms; A-Z become a-z; bytes of other characters stay.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

DOC_SCHEMA = "lang string, digest long, term string, docs long"
COUNT_SCHEMA = "lang string, digest long, split string, counts array<struct<source:string,n:long>>"
PAIR_SCHEMA = "lang string, source string, item string, value long"


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, and how many each text has."""
    low = pa.array([t.translate(TERM_BYTES) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).view(pa.string())
    split = pc.ascii_split_whitespace(low)
    found = split.flatten()
    solid = pc.greater(pc.binary_length(found), 0)  # a blank at an edge leaves an empty string
    ends = np.concatenate(([0], np.cumsum(solid.to_numpy(zero_copy_only=False))))
    sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
    return found.filter(solid), np.diff(ends[sizes])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]]:
    """Some texts at a time: their rows, their different terms, and the row and the term of each occurrence."""
    rows: list[pa.RecordBatch] = []
    terms: list[pa.Array] = []
    sizes: list[np.ndarray] = []

    def block() -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]:
        coded = pa.concat_arrays(terms).dictionary_encode()
        many = np.concatenate(sizes)
        return pa.Table.from_batches(rows), coded.dictionary, np.repeat(np.arange(len(many)), many), _indices(coded)

    for batch in batches:
        found, many = _terms(batch.column("text"))
        rows.append(batch.drop_columns("text"))
        terms.append(found)
        sizes.append(many)
        if sum(map(len, terms)) > TASK_TERMS or sum(t.nbytes for t in terms) > TASK_BYTES:
            yield block()
            rows, terms, sizes = [], [], []
    if rows:
        yield block()


def _coded(rows: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    """Different strings of a column, and the number of each row's."""
    coded = rows[name].combine_chunks().cast(pa.string()).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, _indices(coded)


def _digests(terms: pa.Array, bits: int) -> np.ndarray:
    found = terms.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return (digests & np.uint64((1 << bits) - 1)).view(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each stands there."""
    values = np.sort(values)
    begin = np.flatnonzero(np.diff(values, prepend=-1))  # no value is negative
    return values[begin], np.diff(begin, append=len(values))


def _sent(whole: pa.RecordBatch, strings: str) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: OUT_ROWS, fewer where their ``strings`` are long."""
    ends = np.cumsum(pc.binary_length(whole.column(strings)).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + OUT_BYTES, "right"))
        stop = max(at + 1, min(stop, at + OUT_ROWS))
        yield whole.slice(at, stop - at)
        at = stop


def _document_counts(bits: int):
    """Documents of each term, by lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, terms, row, term in _counted(batches):
            names, lang = _coded(rows, "lang")
            width = max(len(terms), 1)
            row, term = np.divmod(_distinct(row * width + term)[0], width)
            found, docs = _distinct(lang[row] * width + term)
            lang, term = np.divmod(found, width)
            yield from _sent(
                pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(lang)),
                        pa.array(_digests(terms, bits)[term]),
                        terms.take(pa.array(term)),
                        pa.array(docs),
                    ],
                    names=["lang", "digest", "term", "docs"],
                ),
                "term",
            )

    return run


def _source_counts(bits: int, kept: np.ndarray, shared: np.ndarray | None):
    """Occurrences of terms whose digest may be kept, by lang: a row for each term with its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, terms, row, term in _counted(batches):
            names, lang = _coded(rows, "lang")
            sources, source = _coded(rows, "source")
            digests = _digests(terms, bits)
            some = np.flatnonzero(_in_bitmap(kept, digests)[term])
            row, term = row[some], term[some]
            width = max(len(terms), 1)
            places, counts = _distinct((lang[row] * width + term) * len(sources) + source[row])
            owner, source = np.divmod(places, len(sources))
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            lang, term = np.divmod(owner[begin], width)
            splits = pa.array([""]).take(pa.array(np.zeros(len(term), np.int64)))
            if shared is not None:
                splits = pc.if_else(pa.array(_in_bitmap(shared, digests)[term]), terms.take(pa.array(term)), splits)
            pairs = pa.StructArray.from_arrays([sources.take(pa.array(source)), pa.array(counts)], names=["source", "n"])
            yield from _sent(
                pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(lang)),
                        pa.array(digests[term]),
                        splits,
                        pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)).astype(np.int32)), pairs),
                    ],
                    names=["lang", "digest", "split", "counts"],
                ),
                "split",
            )

    return run


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for each ``digest`` by its lowest bits; as large as ``BITMAP_WORDS`` however many there are."""
    word = F.pmod(F.shiftright("digest", 6), F.lit(BITMAP_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("digest", F.lit(64)).cast("int"))
    words = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _in_bitmap(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return (bitmap[(digests >> 6) % len(bitmap)] >> (digests & 63)) & 1 == 1


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)) in longs, the division in two steps of its digits."""
    ones, below = count + 1, total + kept
    high = UNIT // 10_000
    rest = ones % below
    first = _div(rest * high, below)
    second = _div((rest * high) % below * 10_000, below)
    return _div(ones, below) * UNIT + first * 10_000 + second + 1


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def kept_terms(docs: DataFrame, min_docs: int, bits: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """Terms in at least ``min_docs`` documents of their lang, and the digests that terms share.

    The first has lang, digest, split, term; ``split`` is empty, or the term where terms share a digest. The
    second has lang, digest; None if there are none.
    """
    counted = docs.select("lang", "text").mapInArrow(_document_counts(bits), DOC_SCHEMA)
    by_digest = (
        counted.repartition("lang", "digest")
        .groupBy("lang", "digest")
        .agg(F.sum("docs").alias("docs"), F.min("term").alias("low"), F.max("term").alias("high"))
        .where(F.col("docs") >= min_docs)
    )
    found = cut_lineage(by_digest)
    alone = found.where(F.col("low") == F.col("high")).select(
        "lang", "digest", F.lit("").alias("split"), F.col("low").alias("term")
    )
    shared = found.where(F.col("low") != F.col("high")).select("lang", "digest")
    if shared.isEmpty():
        return alone, None
    by_term = counted.join(shared, ["lang", "digest"]).groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs"))
    apart = by_term.where(F.col("docs") >= min_docs).select("lang", "digest", F.col("term").alias("split"), "term")
    return cut_lineage(alone.unionByName(apart)), shared


def term_counts(docs: DataFrame, kept: DataFrame, shared: DataFrame | None, bits: int = 64) -> DataFrame:
    """Occurrences n of kept terms per (lang, source), and lang_n in the whole lang."""
    maps = (_bitmap(kept), None if shared is None else _bitmap(shared))
    counted = docs.mapInArrow(_source_counts(bits, *maps), COUNT_SCHEMA)
    known = kept.select("lang", "digest", F.col("split").alias("kept_split"))
    # Merged at every size, so that one shuffle by digest serves the join, the sums and the window.
    met = counted.join(known.hint("merge"), ["lang", "digest"]).where(
        (F.col("kept_split") == "") | (F.col("kept_split") == F.col("split"))
    )
    term = ["lang", "digest", "kept_split"]
    summed = met.select(*term, F.inline("counts")).groupBy(*term, "source").agg(F.sum("n").alias("n"))
    return summed.withColumn("lang_n", F.sum("n").over(Window.partitionBy(*term))).select(
        "lang", "source", "digest", F.col("kept_split").alias("split"), "n", "lang_n"
    )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What common terms add for each pair of sources; rows come sorted by digest, lang and split."""
    groups: dict[tuple[str, str], int] = {}
    keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
    for table, _ in runs(batches, ["digest"]):
        (langs, lang), (sources, source) = (_coded(table, c) for c in ("lang", "source"))
        met, own = np.unique(lang * len(sources) + source, return_inverse=True)
        names = [(langs[k].as_py(), sources[j].as_py()) for k, j in zip(*(x.tolist() for x in np.divmod(met, len(sources))))]
        code = np.array([groups.setdefault(g, len(groups)) for g in names], np.int64)[own]
        places = (column(table, c) for c in ("digest", "p", "p0"))
        digest, p, p0 = (v.astype(np.int64) for v in places)
        _, split = _coded(table, "split")
        new = (np.diff(digest) != 0) | (np.diff(lang) != 0) | (np.diff(split) != 0)
        begin = np.concatenate(([0], np.flatnonzero(new) + 1))
        size = np.diff(np.append(begin, len(digest)))
        partners, first = np.repeat(size, size), np.repeat(begin, size)
        ends = np.cumsum(partners)
        row = 0
        while row < len(digest):
            # Rows whose partners fill a block; one row has as many partners as there are sources.
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIR_BLOCK, "right")))
            many = partners[row:stop]
            a = np.repeat(np.arange(row, stop), many)
            b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[row:stop], many)
            a, b = a[a != b], b[a != b]
            add = _spread(p[a], p[b]) - _spread(p[a], p0[b]) - _spread(p0[a], p[b]) + _spread(p0[a], p0[b])
            keys, values = _added(
                np.concatenate((keys, code[a] << 32 | code[b])), np.concatenate((values, add))
            )
            if len(keys) > PAIR_BLOCK:
                yield _pairs(groups, keys, values)
                keys, values = keys[:0], values[:0]
            row = stop
    if len(keys):
        yield _pairs(groups, keys, values)


def _indices(encoded: pa.Array) -> np.ndarray:
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begin = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
    return keys[begin], np.add.reduceat(values, begin)


def _pairs(groups: dict[tuple[str, str], int], keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    names = list(groups)
    own, other = (keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[k][0] for k in own], pa.string()),
            pa.array([names[k][1] for k in own], pa.string()),
            pa.array([names[k][1] for k in other], pa.string()),
            pa.array(values),
        ],
        names=["lang", "source", "item", "value"],
    )


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, bits: int = 64) -> DataFrame:
    """Divergence of each source from the others of its lang, and its most over-used terms.

    Columns lang, source, part, item, value, rank. Part ``pair``: every other source of the lang as item, value
    f summed over the terms that the lang keeps (in at least ``min_docs`` of its documents). Part ``term``: the
    group's own terms with a larger share than in the whole lang, the ``top`` largest f. Ranks go by value
    descending, then by item in UTF-8 order.

    A null lang, source or text is an empty one. A group without terms takes part in pairs; a lang without kept
    terms has pairs of value 0, one with one source has none. Each row is a document, so repeats count. Texts are
    counted whole. An empty table gives no rows; columns but lang, source and text are ignored. ``bits`` is the
    width of digests, smaller in tests to make terms share them.
    """
    prepared(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept, shared = kept_terms(docs, min_docs, bits)
    counts = cut_lineage(term_counts(docs, kept, shared, bits))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept"])
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    # A lang without kept terms has no shares at all.
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = cut_lineage(groups.select("lang", "source", "total", "lang_total", "kept", zero.alias("p0")))

    # Terms of equal counts have equal shares, so their number is all that most of what follows needs.
    equal = counts.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms"))
    p = share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    equal = cut_lineage(
        equal.join(groups, ["lang", "source"]).select("lang", "source", "n", "lang_n", "terms", "p0", p, q)
    )
    # A term of one source only is common to none.
    common = counts.where(F.col("n") < F.col("lang_n")).join(groups, ["lang", "source"])
    common = common.select("lang", "source", "digest", "split", p, "p0")
    return _pair_part(groups, common, equal).unionByName(_term_part(counts, equal, kept, top))


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank")
    )


def _pair_part(groups: DataFrame, common: DataFrame, equal: DataFrame) -> DataFrame:
    """All ordered pairs of sources of a lang, which is what is put out, and three sums for each."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    differ = F.col("source") != F.col("item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    base = groups.select("lang", "source", "kept", "p0").join(others, "lang").where(differ).select(
        "lang", "source", "item", F.coalesce(F.col("kept") * spread(p0, q0), F.lit(0)).alias("value")
    )
    own_shares = equal.groupBy("lang", "source", "p", "p0").agg(F.sum("terms").alias("terms"))
    met = own_shares.join(others, "lang").where(differ)
    own = met.select(
        "lang", "source", "item", (F.col("terms") * (spread(p, q0) - spread(p0, q0))).alias("value")
    )
    its = met.select(
        "lang",
        F.col("item").alias("source"),
        F.col("source").alias("item"),
        (F.col("terms") * (spread(q0, p) - spread(q0, p0))).alias("value"),
    )
    common = (
        common.repartition("lang", "digest", "split")
        .sortWithinPartitions("digest", "lang", "split")
        .mapInArrow(_common, PAIR_SCHEMA)
    )
    summed = (
        base.unionByName(own).unionByName(its).unionByName(common)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    return _ranked(summed, "pair")


def _term_part(counts: DataFrame, equal: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """The largest values by digest first; strings join what can still be among them and settle the ties."""
    group = ["lang", "source"]
    over = F.col("p") > F.col("q")
    value = spread(F.col("p"), F.col("q")).alias("value")
    valued = equal.where(over).select(*group, "n", "lang_n", value, "terms")
    values = valued.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    larger = Window.partitionBy(*group).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    # The smallest value that begins among the first.
    last = (
        values.withColumn("before", F.coalesce(F.sum("terms").over(larger), F.lit(0)))
        .where(F.col("before") < top)
        .groupBy(*group)
        .agg(F.min("value").alias("last"))
    )
    first = cut_lineage(valued.join(last, group).where(F.col("value") >= F.col("last")).drop("terms", "last"))
    # Counts tell the rows; the least of a group leave most out before rows meet.
    least = first.groupBy(*group).agg(F.min("n").alias("least"), F.max("lang_n").alias("most"))
    able = counts.join(cut_lineage(least), group).where((F.col("n") >= F.col("least")) & (F.col("lang_n") <= F.col("most")))
    near = able.join(first, [*group, "n", "lang_n"]).select(*group, "digest", "split", "value")
    named = near.join(kept, ["lang", "digest", "split"]).withColumnRenamed("term", "item")
    return _ranked(named, "term").where(F.col("rank") <= top)
