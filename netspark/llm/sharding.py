"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Within each source the rows are ranked in a seeded shuffle; a row's fractional rank is its rank over the
size of its source. Sorted by fractional rank, the sources interleave in proportion, so any cut into equal
ranges gives every shard the same mixture. Ranks and positions come from counts per bucket plus a rank
within one bucket, so no task ever sorts a whole source, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket that a single task ranks, on average.
BUCKET_ROWS = 20_000
SHUFFLE_SEED = 42


def interleave(df: DataFrame, stratum: str, order: list[Column], shards: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """The rows of ``df`` with ``shard``, ``slot`` and ``fractional_rank``.

    Shard sizes differ by one row at most, and in every shard each stratum has its share of rows within two.
    ``slot`` counts from 0 in each shard. ``order`` identifies a row: its hash with the seed is the shuffle,
    and it breaks ties. A null stratum is a stratum of its own. Rows that are equal in all of ``order`` keep
    their own places, in any order among them. An empty table gives no rows. Columns of ``df`` are kept
    but for those named like the result's; names that begin with ``_il_`` are used inside.
    """
    kept = [c for c in df.columns if c.lower() not in ("fractional_rank", "shard", "slot")]
    base = df.select(*kept).withColumn("_il_hash", F.xxhash64(F.lit(seed), *order))
    total = base.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    # A bucket is a range of the hash, so that rank within bucket plus rows of lower buckets is the rank.
    part = F.floor((F.col("_il_hash").cast("double") / F.lit(2.0**64) + 0.5) * buckets)
    base = base.withColumn("_il_part", F.least(F.greatest(part, F.lit(0)), F.lit(buckets - 1)).cast("long"))
    counts = base.groupBy(F.col(stratum).alias("_il_s"), F.col("_il_part").alias("_il_p")).agg(
        F.count(F.lit(1)).alias("_il_n")
    )
    strata = Window.partitionBy("_il_s")
    counts = counts.select(
        "*",
        (F.sum("_il_n").over(strata.orderBy("_il_p")) - F.col("_il_n")).alias("_il_before"),
        F.sum("_il_n").over(strata).alias("_il_size"),
    )
    within = Window.partitionBy(stratum, "_il_part").orderBy("_il_hash", *order)
    ranked = base.withColumn("_il_rank", F.row_number().over(within)).join(
        counts, F.col(stratum).eqNullSafe(F.col("_il_s")) & (F.col("_il_part") == F.col("_il_p"))
    )
    rank = F.col("_il_before") + F.col("_il_rank")
    ranked = ranked.withColumn("fractional_rank", (rank - 0.5) / F.col("_il_size"))

    in_slice = F.least(F.floor(F.col("fractional_rank") * buckets), F.lit(buckets - 1)).cast("long")
    ranked = ranked.withColumn("_il_slice", in_slice)
    per_slice = ranked.groupBy(F.col("_il_slice").alias("_il_k")).agg(F.count(F.lit(1)).alias("_il_m"))
    below = Window.orderBy("_il_k")  # a row per slice
    per_slice = per_slice.select("_il_k", (F.sum("_il_m").over(below) - F.col("_il_m")).alias("_il_first"))
    place = Window.partitionBy("_il_slice").orderBy("fractional_rank", stratum, "_il_hash", *order)
    placed = ranked.withColumn("_il_row", F.row_number().over(place)).join(
        per_slice, F.col("_il_slice") == F.col("_il_k")
    )
    placed = placed.withColumn("_il_pos", F.col("_il_first") + F.col("_il_row") - 1)
    # The shard of position p is floor(p * shards / total), in integers; a shard begins where that steps up.
    placed = placed.withColumn("shard", F.expr(f"CAST(_il_pos * {shards} DIV {max(total, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return placed.withColumn("slot", F.col("_il_pos") - first).select(*kept, "fractional_rank", "shard", "slot")
