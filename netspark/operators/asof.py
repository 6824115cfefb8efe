"""Rows of one series next to those of another in time, for any two irregular series.

Both series are put in one order per key. Windows run per (key, bucket), with the nearest rows of other buckets
carried over their edges, so a key that holds most rows is spread over its buckets (see ``ordering``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.operators import ordering

DIRECTIONS = ("nearest", "backward", "forward")


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    left_time: str = "timestamp",
    right_time: str = "timestamp",
    keys: list[str] | None = None,
    direction: str = "nearest",
    tolerance: float | None = None,
    bucket_seconds: float = ordering.DEFAULT_BUCKET_SECONDS,
    max_bucket_rows: int = ordering.MAX_BUCKET_ROWS,
) -> DataFrame:
    """``left`` with ``match_id`` and ``match_time`` of the right row next to it among those of equal ``keys``.

    ``backward`` looks at right rows up to the left row's time, ``forward`` from it on, ``nearest`` both ways;
    of two equally near ones the earlier is taken, of several at one time the one with the smallest id. Both are
    null without such a row, beyond ``tolerance``, and where the time or a key is null. ``left_id`` must tell
    rows of one time apart.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    keys = keys or []
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    known = F.lit(True)
    for name in names:
        known = known & F.col(name).isNotNull()

    # Right rows of one time are one row, however many they are.
    point = F.struct(F.col("_t").alias("time"), F.col("_id").alias("id"))
    right_rows = (
        right.select(*keyed, F.col(right_time).cast("double").alias("_t"), F.col(right_id).alias("_id"))
        .filter(known & F.col("_t").isNotNull())
        .groupBy(*names, "_t")
        .agg(F.min("_id").alias("_id"))
        .select(*names, "_t", F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_own"), point.alias("_point"))
    )
    point_type = right_rows.schema["_point"].dataType
    left_rows = left.select(
        *keyed,
        F.col(left_time).cast("double").alias("_t"),
        F.lit(1).alias("_side"),
        F.col(left_id).alias("_own"),
        F.lit(None).cast(point_type).alias("_point"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    unknown = F.lit(None).cast(point_type)
    is_placed = known & F.col("_t").isNotNull()
    unplaced = left_rows.filter(~is_placed).select("_row", unknown.alias("_match"))

    both = right_rows.withColumn("_row", F.lit(None).cast(left_rows.schema["_row"].dataType)).unionByName(
        left_rows.filter(is_placed)
    )
    # At one time right rows come first, so they are found looking backward.
    both = both.withColumn("_tie", F.struct("_side", "_own"))
    bucketed = ordering.with_buckets(
        both, names, "_t", "_tie", bucket_seconds=bucket_seconds, max_bucket_rows=max_bucket_rows
    )
    group = [*names, "_bucket"]
    # What follows is what precedes in descending order: a frame that reaches to the end is read anew for each row.
    key = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    earlier_ends = (Window.unboundedPreceding, -1)
    ends = (
        bucketed.groupBy(*group)
        .agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
        .withColumns(
            {
                "_before": F.last("_last", True).over(key.orderBy("_bucket").rowsBetween(*earlier_ends)),
                "_after": F.last("_first", True).over(key.orderBy(F.desc("_bucket")).rowsBetween(*earlier_ends)),
            }
        )
        .drop("_first", "_last")
    )
    inside = Window.partitionBy(*group)
    order = ["_t", "_side", "_own"]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    seen = bucketed.withColumns(
        {
            "_previous": F.last("_point", True).over(inside.orderBy(*order).rowsBetween(*so_far)),
            "_next": F.last("_point", True).over(inside.orderBy(*map(F.desc, order)).rowsBetween(*so_far)),
        }
    ).filter(F.col("_side") == 1)
    placed = seen.join(ends, group, "left")
    earlier, later = F.coalesce("_previous", "_before"), F.coalesce("_next", "_after")
    since, until = F.col("_t") - earlier["time"], later["time"] - F.col("_t")
    match = {
        "backward": earlier,
        "forward": F.when(since == 0, earlier).otherwise(later),
        "nearest": F.when(later.isNull() | (since <= until), earlier).otherwise(later),
    }[direction]
    matched = placed.select("_row", F.col("_t"), match.alias("_match"))
    if tolerance is not None:
        near = F.abs(F.col("_match.time") - F.col("_t")) <= tolerance
        matched = matched.withColumn("_match", F.when(near, F.col("_match")))
    return matched.select("_row", "_match").unionByName(unplaced).select(
        "_row.*", F.col("_match.id").alias("match_id"), F.col("_match.time").alias("match_time")
    )
