"""Term vectors of descriptions and the most similar known threat."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.operators import ordering
from netspark.session import cut_lineage

# Words of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Default English stop words; a caller may pass another list.
STOP_WORDS = (
    "about above after again against all also although always am among an and any are as at be "
    "because been before behind being below between both but by can cannot could did do does "
    "done down during each either else enough even every except few first for from further get "
    "give go had has have he hence her here hers him his how however if in into is it its itself "
    "last least less many may me might more most much must my myself neither never next no nor "
    "not nothing now of off often on once one only or other others our out over own per perhaps "
    "rather same she should since so some still such than that the their them then there these "
    "they this those through thus to together too under until up upon us very was we well were "
    "what when where which while who whom why will with within without would yet you your"
).split()

MAX_TERMS = 1000
SIMILARITY_THRESHOLD = 0.7
#: Postings of a term that go to every task, and how many of the others one join key may have.
CHAMPIONS, SALT_ROWS = 64, 10_000
#: Sums that a task holds at a time.
MAX_CELLS = 2_000_000
#: Digits of a score that are kept, so equal rows tie; bounds leave room for rounding.
DIGITS, MARGIN = 12, 1e-9


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )


def term_statistics(
    corpus: DataFrame, *, id_column: str, text_column: str, stop_words: list[str] | None = None
) -> DataFrame:
    """Per term: documents that have it and total occurrences.

    A row counts its own words and, beside them, its different ones, so only terms are
    shuffled. Rows of one id are one document: where ids repeat, their words are counted
    per (document, term) first.
    """
    stop = STOP_WORDS if stop_words is None else stop_words
    rows = corpus.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text"))
    repeated = cut_lineage(
        rows.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_doc")
    )
    single = ordering.null_safe_join(rows, repeated, ["_doc"], "left_anti")
    words = tokens(F.col("_text"))
    counted = (
        single.select(words.alias("_all"))
        .select(F.posexplode(F.array("_all", F.array_distinct("_all"))).alias("df", "_words"))
        .select(F.explode("_words").alias("term"), F.col("df").cast("long").alias("df"))
        .filter(~F.col("term").isin(*stop))
        .select("term", "df", (F.lit(1) - F.col("df")).alias("cf"))
    )
    merged = (
        ordering.null_safe_join(rows, repeated, ["_doc"], "left_semi")
        .select("_doc", F.explode(words).alias("term"))
        .filter(~F.col("term").isin(*stop))
        .groupBy("_doc", "term")
        .agg(F.count(F.lit(1)).alias("cf"))
        .select("term", F.lit(1).cast("long").alias("df"), "cf")
    )
    return counted.unionByName(merged).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass(frozen=True)
class TermModel:
    """Vocabulary and smooth inverse document frequencies; at most ``max_terms`` entries."""

    terms: list[str]
    idf: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.terms, self.idf))
        return spark.createDataFrame(rows, "term string, idf double")

    def transform(self, df: DataFrame, text_column: str, output: str) -> DataFrame:
        """Add the L2-normalised tf-idf row as a sparse vector; no shuffle.

        Stop words are not in the vocabulary, so they need no filter here.
        """
        if not self.terms:
            return df
        counter = CountVectorizerModel.from_vocabulary(self.terms, "_tokens", "_counts")
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weights"
        )
        scale = Normalizer(p=2.0, inputCol="_weights", outputCol=output)
        counted = counter.transform(
            df.withColumn("_tokens", tokens(F.col(text_column)))
        )
        return scale.transform(weigh.transform(counted)).drop("_tokens", "_counts", "_weights")


def fit_terms(
    corpus: DataFrame,
    *,
    id_column: str,
    text_column: str,
    max_terms: int = MAX_TERMS,
    stop_words: list[str] | None = None,
) -> TermModel:
    """The most frequent terms with idf = ln((1 + n) / (1 + df)) + 1."""
    n = corpus.count()
    top = (
        term_statistics(
            corpus, id_column=id_column, text_column=text_column, stop_words=stop_words
        )
        .orderBy(F.desc("cf"), "term")
        .limit(max_terms)
        .select("term", (F.log(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
        .orderBy("term")
    )
    rows = top.collect()  # bounded by max_terms
    return TermModel([r.term for r in rows], [r.idf for r in rows])


def sparse_rows(model: TermModel, df: DataFrame, text_column: str) -> DataFrame:
    """``df`` with ``terms`` (places in the vocabulary, ascending) and ``weights`` of those that occur."""
    unit = model.transform(df, text_column, "_unit")
    if not model.terms:
        return unit.select(
            *df.columns,
            F.array().cast("array<int>").alias("terms"),
            F.array().cast("array<double>").alias("weights"),
        )
    sparse = F.unwrap_udt("_unit")
    return unit.select(*df.columns, sparse["indices"].alias("terms"), sparse["values"].alias("weights"))


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per occurring term."""
    cells = F.transform(
        "terms", lambda term, i: F.struct(term.alias("term"), F.get("weights", i).alias("weight"))
    )
    return rows.select(*keys, F.inline(cells))


def weights_long(model: TermModel, df: DataFrame, *, id_column: str, text_column: str) -> DataFrame:
    """(id, term, weight) for the terms that occur."""
    names = df.sparkSession.createDataFrame(list(enumerate(model.terms)), "term int, name string")
    cells = _long(sparse_rows(model, df.select(id_column, text_column), text_column), id_column)
    return cells.join(names, "term").select(id_column, F.col("name").alias("term"), "weight")


@dataclass(frozen=True)
class TermIndex:
    """Inverted index of threats.

    The strongest postings of each term (at most ``champions`` of them, so their number is bounded by the
    vocabulary) go to the tasks; of the others they know the largest weight per term. The others stay a table,
    those of frequent terms dealt over salts.
    """

    ids: np.ndarray  # of threats among the strongest postings, ascending
    offsets: np.ndarray  # by term, where its postings begin
    places: np.ndarray  # of a posting's threat in ``ids``
    weights: np.ndarray
    others: np.ndarray  # by term, the largest weight that is left
    rest: DataFrame | None  # right_id, term, salt
    salts: DataFrame | None  # term, salt: every salt of each term in ``rest``
    rows: DataFrame  # right_id, terms, weights
    first_id: int | None

    @staticmethod
    def build(
        model: TermModel,
        threats: DataFrame,
        *,
        id_column: str,
        text_column: str,
        champions: int = CHAMPIONS,
        salt_rows: int = SALT_ROWS,
    ) -> TermIndex:
        named = threats.select(F.col(id_column).cast("long").alias("right_id"), F.col(text_column).alias("_text"))
        rows = cut_lineage(sparse_rows(model, named, "_text").drop("_text").filter("right_id IS NOT NULL"))
        postings = _long(rows, "right_id")
        strongest = Window.partitionBy("term").orderBy(F.desc("weight"), "right_id")
        top = (
            postings.withColumn("at", F.row_number().over(strongest))
            .filter(F.col("at") <= champions + 1)
            .orderBy("term", "at")
            .toArrow()  # bounded by the vocabulary and ``champions``
        )
        term, at, right_id, weight = (top[c].to_numpy() for c in ("term", "at", "right_id", "weight"))
        kept = at <= champions
        ids, places = np.unique(right_id[kept], return_inverse=True)
        size = max(len(model.terms), 1)
        offsets = np.searchsorted(term[kept], np.arange(size + 1))
        others = np.zeros(size)
        others[term[~kept]] = weight[~kept]
        rest = salts = None
        if not kept.all():
            cuts = list(zip(term[~kept].tolist(), weight[~kept].tolist(), right_id[~kept].tolist()))
            cut = threats.sparkSession.createDataFrame(cuts, "term int, cut double, cut_id long")
            # Counted without a window: a term of very many threats is no hot group.
            counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cut), "term")
            dealt = F.ceil(F.col("n") / salt_rows)
            sized = cut_lineage(counts.select("term", "cut", "cut_id", dealt.cast("int").alias("dealt")))
            weaker = (F.col("weight") < F.col("cut")) | (
                (F.col("weight") == F.col("cut")) & (F.col("right_id") >= F.col("cut_id"))
            )
            rest = (
                postings.join(F.broadcast(sized), "term")
                .filter(weaker)
                .select("right_id", "term", F.pmod(F.xxhash64("right_id"), "dealt").cast("int").alias("salt"))
            )
            salts = sized.select("term", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)).alias("salt"))
        first = rows.agg(F.min("right_id")).first()[0]
        return TermIndex(ids, offsets, places, weight[kept], others, rest, salts, rows, first)


_SEARCHED = (
    "row long, right_id long, score double, settled boolean, candidates array<long>, probes array<int>"
)


def _search(index: TermIndex):
    """Per row the best threat by the strongest postings, and what else could still beat it."""
    ids, offsets, places, weights, others = (
        index.ids, index.offsets, index.places, index.weights, index.others
    )
    width = max(len(ids), 1)

    def block(rows, terms, values, n):
        """Products of ``n`` rows with the strongest postings, added up by row and threat."""
        many = offsets[terms + 1] - offsets[terms]
        cell = np.repeat(np.arange(len(terms)), many)
        posting = np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[terms], many)
        to = rows[cell] * width + places[posting]
        return np.bincount(to, values[cell] * weights[posting], minlength=n * width).reshape(n, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, MAX_CELLS // width)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                yield searched(part)

    def searched(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        sizes = np.array([len(t) for t in part.column("terms")])
        rows = np.repeat(np.arange(n), sizes)
        terms = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        values = part.column("weights").flatten().to_numpy(zero_copy_only=False)
        known = block(rows, terms, values, n)
        rounded = np.round(known, DIGITS)
        best = rounded.argmax(axis=1)  # the smallest id of equals
        score = rounded[np.arange(n), best]
        bound = np.bincount(rows, values * others[terms], minlength=n)
        settled = bound == 0
        candidates: list[list[int] | None] = [None] * n
        probes: list[list[int] | None] = [None] * n
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(~settled):
            floor = score[k] - MARGIN
            near = known[k] + bound[k] >= floor
            candidates[k] = ids[near & (known[k] > 0)].tolist()
            own = slice(ends[k] - sizes[k], ends[k])
            reach = values[own] * others[terms[own]]
            order = np.argsort(reach, kind="stable")
            # Threats that share only skipped terms stay below the best one known.
            needed = order[(np.cumsum(reach[order]) >= floor) & (reach[order] > 0)]
            probes[k] = terms[own][needed].tolist()
        found = score > 0
        return pa.RecordBatch.from_arrays(
            [
                part.column("row"),
                pa.array(np.where(found, ids[best] if len(ids) else 0, 0), pa.int64(), mask=~found),
                pa.array(score),
                pa.array(settled),
                pa.array(candidates, pa.list_(pa.int64())),
                pa.array(probes, pa.list_(pa.int32())),
            ],
            names=["row", "right_id", "score", "settled", "candidates", "probes"],
        )

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dot products of pairs of sparse rows, a batch at a time."""
    for batch in batches:
        sides = []
        for terms, values in (("terms", "weights"), ("right_terms", "right_weights")):
            sizes = np.array([len(t) for t in batch.column(terms)], np.int64)
            flat = batch.column(terms).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            pair = np.repeat(np.arange(batch.num_rows), sizes)
            sides.append((pair << 32 | flat, pair, batch.column(values).flatten().to_numpy(zero_copy_only=False)))
        (left, pair, w), (right, _, v) = sides
        at = np.minimum(np.searchsorted(right, left), max(len(right) - 1, 0))
        same = right[at] == left if len(right) else np.zeros(len(left), bool)
        score = np.bincount(pair[same], w[same] * v[at[same]], minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("right_id"), pa.array(np.round(score, DIGITS))],
            names=["row", "right_id", "score"],
        )


def best_of_index(rows: DataFrame, index: TermIndex) -> DataFrame:
    """(row, right_id, score): the threat with the largest cosine for each sparse row (row, terms, weights).

    Equal scores (``DIGITS`` digits) go to the smaller id; a row that shares no term with any threat has no
    right_id. Exact: rows that the strongest postings cannot settle are compared with every threat whose bound
    reaches the best one known.
    """
    shared = rows.sparkSession.sparkContext.broadcast(
        (index.ids, index.offsets, index.places, index.weights, index.others)
    )

    def run(batches):
        arrays = shared.value
        return _search(TermIndex(*arrays, None, None, None, None))(batches)

    found = rows.mapInArrow(run, _SEARCHED)
    if index.rest is None:
        return found.select("row", "right_id", "score")
    found = cut_lineage(found)
    open_rows = found.filter(~F.col("settled"))
    probes = open_rows.select("row", F.explode("probes").alias("term")).join(index.salts, "term")
    pairs = (
        probes.join(index.rest, ["term", "salt"])
        .select("row", "right_id")
        .union(open_rows.select("row", F.explode("candidates").alias("right_id")))
        .distinct()
    )
    right = index.rows.select(
        "right_id", F.col("terms").alias("right_terms"), F.col("weights").alias("right_weights")
    )
    scored = (
        pairs.join(rows, "row")
        .join(right, "right_id")
        .select("row", "right_id", "terms", "weights", "right_terms", "right_weights")
        .mapInArrow(_products, "row long, right_id long, score double")
    )
    best = scored.groupBy("row").agg(
        F.max(F.struct("score", (-F.col("right_id")).alias("negative"))).alias("best")
    )
    exact = best.select("row", (-F.col("best.negative")).alias("exact_id"), F.col("best.score").alias("exact"))
    return found.join(exact, "row", "left").select(
        "row",
        F.coalesce("exact_id", "right_id").alias("right_id"),
        F.coalesce("exact", "score").alias("score"),
    )


def most_similar(
    alerts: DataFrame,
    threats: DataFrame,
    *,
    alert_id: str,
    alert_text: str,
    threat_id: str,
    threat_text: str,
    max_terms: int = MAX_TERMS,
    stop_words: list[str] | None = None,
    champions: int = CHAMPIONS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """(alert_id, threat_id, similarity): the best threat, the first one on ties.

    An alert that shares no term with any threat has similarity 0 with the first of them; without threats
    both are null.
    """
    model = fit_terms(
        threats,
        id_column=threat_id,
        text_column=threat_text,
        max_terms=max_terms,
        stop_words=stop_words,
    )
    index = TermIndex.build(
        model,
        threats,
        id_column=threat_id,
        text_column=threat_text,
        champions=champions,
        salt_rows=salt_rows,
    )
    named = alerts.select(F.col(alert_id), F.col(alert_text).alias("_text"))
    rows = sparse_rows(model, named, "_text").drop("_text")
    if index.first_id is None:
        nothing = F.lit(None)
        return rows.select(
            alert_id, nothing.cast("long").alias("threat_id"), nothing.cast("double").alias("similarity")
        )
    # Row numbers are stored before they are joined on.
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    best = best_of_index(rows.select("row", "terms", "weights"), index)
    return rows.select("row", alert_id).join(best, "row").select(
        alert_id,
        F.coalesce("right_id", F.lit(index.first_id)).alias("threat_id"),
        F.col("score").alias("similarity"),
    )


def threat_similarity(
    alerts: DataFrame,
    threats: DataFrame,
    *,
    alert_id: str,
    alert_text: str,
    threat_id: str = "item_id",
    threat_text: str = "description",
    threshold: float = SIMILARITY_THRESHOLD,
    **options,
) -> DataFrame:
    """Similarity for every alert; the threat's columns only where it exceeds the threshold."""
    best = most_similar(
        alerts,
        threats,
        alert_id=alert_id,
        alert_text=alert_text,
        threat_id=threat_id,
        threat_text=threat_text,
        **options,
    )
    known = threats.select(
        F.col(threat_id).alias("threat_id"),
        F.coalesce("type", F.lit("")).alias("threat_type"),
        F.coalesce("tags", F.lit("")).alias("threat_tags"),
        F.coalesce("severity", F.lit("medium")).alias("threat_severity"),
    )
    matched = F.col("similarity") > threshold
    above = best.withColumn("threat_id", F.when(matched, F.col("threat_id")))
    return above.join(known, "threat_id", "left").select(
        alert_id,
        F.col("similarity").alias("threat_similarity"),
        F.coalesce(matched, F.lit(False)).alias("threat_matched"),
        "threat_type",
        "threat_tags",
        "threat_severity",
        F.when(matched, F.col("similarity")).alias("threat_confidence"),
    )
