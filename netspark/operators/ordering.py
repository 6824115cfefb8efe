"""Order-dependent building blocks that stay even when one key holds most rows.

A window over a hot key would put all of its rows into one task. Here rows are
windowed per (key, bucket), where buckets follow the order; only one small row per
(key, bucket) is windowed over the whole key, to carry values across bucket edges.
Buckets are time slots; the rows of slots that are too full are cut into ranges of
equal size. Results are exact, and rows without a time come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.session import cut_lineage

DEFAULT_BUCKET_SECONDS = 60.0
#: Rows that one (key, bucket) group may hold in a window.
MAX_BUCKET_ROWS = 2_000_000
#: Rows (or distinct values) that one task may hold for an exact percentile.
EXACT_PERCENTILE_ROWS = 1_000_000


def time_bucket(order: str | Column, seconds: float = DEFAULT_BUCKET_SECONDS) -> Column:
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(float(seconds)))


def with_buckets(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: str,
    *,
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """Add ``_bucket``: within a key, every row of a bucket precedes those of later ones.

    A bucket is a time slot and a part of it. Group sizes are counted first, on the key and
    order columns alone. Only slots that are too full (a burst, or many rows at one instant)
    have more than one part: their rows are range partitioned by (keys, slot, value, tie)
    and written once, so that the range number is fixed data for everything that follows.
    Rows without a time are in the slot before all others.
    """
    slotted = df.withColumn("_slot", time_bucket(value, bucket_seconds))
    slot = [*keys, "_slot"]
    full = cut_lineage(
        slotted.groupBy(*slot).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_bucket_rows)
    )
    rows = full.agg(F.sum("_n").alias("n")).first().n
    if not rows:
        return _as_bucket(slotted, F.lit(0))
    crowded = null_safe_join(slotted, full.select(*slot), slot)
    ranged = crowded.repartitionByRange(-(-2 * rows // max_bucket_rows), *slot, value, tie)
    parts = cut_lineage(_as_bucket(ranged, F.spark_partition_id()))
    others = _as_bucket(null_safe_join(slotted, full.select(*slot), slot, "left_anti"), F.lit(0))
    return others.unionByName(parts)


def _as_bucket(df: DataFrame, part: Column) -> DataFrame:
    slot = F.col("_slot").cast("bigint").alias("slot")
    return df.withColumn("_bucket", F.struct(slot, part.cast("int").alias("part"))).drop("_slot")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the columns are those of ``left``."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    joined = left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how)
    return joined.drop(*[f"_on_{c}" for c in on])


def with_previous(
    df: DataFrame,
    key: str,
    value: str,
    output: str,
    *,
    tie: str = "packet_id",
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """Previous ``value`` of the same key in (value, tie) order; null for a null key."""
    bucketed = with_buckets(
        df, [key], value, tie, bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(value, tie)
    edges = (
        bucketed.filter(F.col(key).isNotNull())
        .groupBy(key, "_bucket")
        .agg(F.max(value).alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")))
        .drop("_last")
    )
    previous = F.coalesce(F.lag(value).over(inside), F.col("_before"))
    return (
        null_safe_join(bucketed, edges, [key, "_bucket"], "left")
        .withColumn(output, F.when(F.col(key).isNotNull(), previous))
        .drop("_bucket", "_before")
    )


def gaps(
    df: DataFrame,
    key: str,
    value: str,
    *,
    tie: str = "packet_id",
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """(key, gap) for every row with a key, in no order; null for a key's first row.

    For statistics only: gaps inside buckets and the gaps between buckets are simply
    put together, so no row has to be joined with its bucket's predecessor.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, value, tie)
    bucketed = with_buckets(
        rows, [key], value, tie, bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows
    )
    order = Window.partitionBy(key, "_bucket").orderBy(value, tie)
    inside = bucketed.select(
        key, F.row_number().over(order).alias("_n"), (F.col(value) - F.lag(value).over(order)).alias("gap")
    ).filter(F.col("_n") > 1)
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket"))
    between = (
        bucketed.groupBy(key, "_bucket")
        .agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
        .select(key, (F.col("_first") - before).alias("gap"))
    )
    return inside.drop("_n").unionByName(between)


def with_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    output: str,
    *,
    tie: str,
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """1-based position in (value, tie) order, per key or over everything without keys.

    Equal to ``row_number``: position inside the bucket plus the rows of all earlier buckets.
    """
    bucketed = with_buckets(
        df, keys, value, tie, bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows
    )
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value, tie)
    return (
        null_safe_join(bucketed, offsets, [*keys, "_bucket"])
        .withColumn(output, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def with_history(
    df: DataFrame,
    keys: list[str],
    value: str,
    payload: list[str],
    length: int,
    output: str,
    *,
    tie: str,
    chunk_rows: int = 4096,
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """The last ``length`` payload structs up to each row, oldest first.

    Rows are ranked, cut into equal chunks per key, and the last ``length - 1`` rows
    of a chunk are also given to the next one, so no task gets more than a chunk.
    """
    if chunk_rows < length:
        raise ValueError("a chunk must hold at least one whole sequence")
    ranked = with_rank(
        df,
        keys,
        value,
        "_rank",
        tie=tie,
        bucket_seconds=bucket_seconds,
        max_bucket_rows=max_bucket_rows,
    )
    position = F.col("_rank") - 1
    chunk = F.floor(position / chunk_rows)
    is_halo = (position % chunk_rows) >= chunk_rows - (length - 1)
    spread = ranked.withColumn(
        "_chunk",
        F.explode(F.when(is_halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))),
    )
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("_rank").rowsBetween(-(length - 1), 0)
    )
    history = F.collect_list(F.struct(*payload)).over(frame)
    return (
        spread.withColumn(output, history)
        .filter(chunk == F.col("_chunk"))
        .drop("_rank", "_chunk")
    )


def exact_quantiles(
    df: DataFrame,
    column: str | Column,
    quantiles: list[float],
    *,
    exact_rows: int = EXACT_PERCENTILE_ROWS,
) -> list[float | None]:
    """Linear-interpolation quantiles of one column; see ``exact_quantile_table``."""
    value = F.col(column) if isinstance(column, str) else column
    return exact_quantile_table(df, {"v": value}, quantiles, exact_rows=exact_rows)["v"]


def exact_column_quantiles(
    df: DataFrame, columns: list[str], quantile: float, *, exact_rows: int = EXACT_PERCENTILE_ROWS
) -> dict[str, float | None]:
    """The same quantile of several columns."""
    named = {c: F.col(c) for c in columns}
    table = exact_quantile_table(df, named, [quantile], exact_rows=exact_rows)
    return {c: found[0] for c, found in table.items()}


@dataclass
class _Sought:
    """A value sought by its 0-based rank among the ``rows`` values between two bounds, ends excluded."""

    column: str
    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column)
        test = v.isNotNull()
        if self.low is not None:
            test = test & (v > self.low)
        if self.high is not None:
            test = test & (v < self.high)
        return F.when(test, v)

    def narrow(self, low: float, high: float, counts: tuple[int, ...]) -> None:
        """``counts``: rows below, at, between, at and above the two bounds."""
        zones = [(self.low, low, None), (None, None, low), (low, high, None), (None, None, high), (high, self.high, None)]
        for (a, b, value), count in zip(zones, counts):
            if self.rank < count:
                self.low, self.high, self.value, self.rows = a, b, value, count
                return
            self.rank -= count


def exact_quantile_table(
    df: DataFrame,
    columns: dict[str, Column],
    quantiles: list[float],
    *,
    exact_rows: int = EXACT_PERCENTILE_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several columns, exact, with bounded memory in every task.

    For each column the order statistics around each quantile are sought, all of them together. A round
    brackets each by ``percentile_approx``, counts the rows at and between the brackets, and goes on
    inside, about a thousandth of the rows, until ``exact_rows`` are left, which ``percentile`` takes. The
    number of jobs depends on the logarithm of the rows and not on columns or quantiles. Nulls are left out.
    """
    names = {f"v{k}": name for k, name in enumerate(columns)}
    values = df.select(*[columns[name].cast("double").alias(v) for v, name in names.items()])
    totals = values.agg(*[F.count(v).alias(v) for v in names]).first().asDict()
    sought: dict[tuple[str, int], _Sought] = {}
    for v, total in totals.items():
        for q in quantiles if total else []:
            rank = int(q * (total - 1))
            for r in {rank, min(rank + 1, total - 1)}:
                sought[v, r] = _Sought(v, r, total)
    wide = [s for s in sought.values() if s.rows > exact_rows]
    if wide:
        values = cut_lineage(values)
    while wide:
        brackets = []
        for s in wide:
            share = s.rank / (s.rows - 1)
            ends = F.lit([max(0.0, share - 0.001), min(1.0, share + 0.001)]).cast("array<double>")
            brackets.append(F.percentile_approx(s.inside(), ends, F.lit(10_000)))
        bounds = values.agg(*[b.alias(f"b{k}") for k, b in enumerate(brackets)]).first()
        tests = []
        for s, (low, high) in zip(wide, bounds):
            v = s.inside()
            at_high = (v == high) if high > low else F.lit(False)
            tests += [v < low, v == low, (v > low) & (v < high), at_high, v > high]
        counts = values.agg(*[F.count_if(t).alias(f"c{k}") for k, t in enumerate(tests)]).first()
        for k, (s, (low, high)) in enumerate(zip(wide, bounds)):
            s.narrow(low, high, counts[5 * k : 5 * k + 5])
        wide = [s for s in wide if s.value is None and s.rows > exact_rows]
    few = [s for s in sought.values() if s.value is None]
    if few:
        shares = [F.lit(s.rank / (s.rows - 1) if s.rows > 1 else 0.0) for s in few]
        row = values.agg(*[F.percentile(s.inside(), p).alias(f"p{k}") for k, (s, p) in enumerate(zip(few, shares))])
        for s, value in zip(few, row.first()):
            s.value = float(value)
    table: dict[str, list[float | None]] = {}
    for v, name in names.items():
        table[name] = []
        for q in quantiles:
            if not totals[v]:
                table[name].append(None)
                continue
            position = q * (totals[v] - 1)
            low = sought[v, int(position)].value
            high = sought[v, min(int(position) + 1, totals[v] - 1)].value
            step = position - int(position)
            table[name].append(low + (high - low) * step if step else low)
    return table


def with_running_sums(
    df: DataFrame,
    keys: list[str],
    value: str,
    measures: list[str],
    *,
    tie: str,
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
) -> DataFrame:
    """Add ``<measure>_total``: running sum per key in (value, tie) order."""
    bucketed = with_buckets(
        df, keys, value, tie, bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in measures]
    )
    carried = sums.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_carry_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = {
        f"{m}_total": F.col(f"_carry_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        for m in measures
    }
    return (
        null_safe_join(bucketed, carried, [*keys, "_bucket"])
        .withColumns(totals)
        .drop("_bucket", *[f"_carry_{m}" for m in measures])
    )
