"""Traffic volume over time and protocol shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that are made from one row.
GAP_PIECE = 10_000


def traffic_volume(packets: DataFrame, *, seconds: float = 60) -> DataFrame:
    """Packets per bin; bins without packets between the first and last are 0."""
    levels = traffic_volume_levels(packets, levels=(seconds,))
    return levels.drop("level_seconds")


def traffic_volume_levels(
    packets: DataFrame, *, levels: tuple[float, ...] = (60, 300, 3600)
) -> DataFrame:
    """Several resolutions from one scan: counted at the finest, rolled up, gaps filled.

    Each later level must be a multiple of the first.
    """
    finest = packets.groupBy(F.floor(F.col("timestamp") / F.lit(float(levels[0]))).alias("fine")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = all(float(s).is_integer() for s in levels)
    slots = F.array(
        *[
            F.struct(
                F.lit(int(s) if whole else float(s)).alias("level_seconds"),
                F.floor(F.col("fine") / F.lit(round(s / levels[0]))).alias("_bin"),
            )
            for s in levels
        ]
    )
    counts = (
        finest.filter(F.col("fine").isNotNull())
        .select("n", F.inline(slots))
        .groupBy("level_seconds", "_bin")
        .agg(F.sum("n").alias("packet_count"))
    )
    return fill_bins(counts)


def fill_bins(counts: DataFrame) -> DataFrame:
    """Add the empty bins after each bin, up to the next one.

    The window sees one row per bin that has packets, never packets. A gap is cut into pieces of
    GAP_PIECE bins, and those are dealt out before their bins are made, so no row holds a whole gap.
    """
    following = Window.partitionBy("level_seconds").orderBy("_bin")
    until = F.coalesce(F.lead("_bin").over(following), F.col("_bin") + 1) - 1
    spans = counts.withColumn("_until", until)
    # Pieces of pieces: each array is short, also for a gap of many thousand million bins.
    outer = F.explode(F.sequence("_bin", "_until", F.lit(GAP_PIECE * GAP_PIECE)))
    coarse = spans.withColumn("_from", outer).withColumn(
        "_to", F.least("_until", F.col("_from") + GAP_PIECE * GAP_PIECE - 1)
    )
    pieces = coarse.withColumn("_piece", F.explode(F.sequence("_from", "_to", F.lit(GAP_PIECE))))
    dealt = pieces.repartition("level_seconds", "_piece")
    bins = F.explode(F.sequence("_piece", F.least("_to", F.col("_piece") + GAP_PIECE - 1)))
    return dealt.withColumn("_at", bins).select(
        "level_seconds",
        (F.col("_at") * F.col("level_seconds")).cast("double").alias("bin_start"),
        F.when(F.col("_at") == F.col("_bin"), F.col("packet_count")).otherwise(0).alias("packet_count"),
    )


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Packets and share per protocol, most common first."""
    counts = (
        packets.filter(F.col("protocol").isNotNull())
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("packets"))
    )
    total = counts.agg(F.sum("packets")).scalar()
    return counts.withColumn("share", F.col("packets") / total).orderBy(
        F.desc("packets"), "protocol"
    )


def nearest_bin(alerts: DataFrame, volume: DataFrame, *, seconds: float = 5) -> DataFrame:
    """Each distinct alert time with the count of the bin that starts nearest, the earlier on a tie.

    ``volume`` is a filled grid, so the bin is computed and looked up with an equality join.
    """
    step = F.lit(float(seconds))
    ends = volume.agg(F.struct(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi")))
    bounds = ends.scalar()
    times = alerts.select("timestamp").filter(F.col("timestamp").isNotNull()).distinct()
    near = F.ceil(F.col("timestamp") / step - F.lit(0.5)) * step
    located = times.withColumn(
        "bin_start", F.greatest(F.least(near.cast("double"), bounds["hi"]), bounds["lo"])
    )
    return located.join(volume, "bin_start").select("timestamp", "bin_start", "packet_count")


def layer_protocol_counts(layers: DataFrame) -> DataFrame:
    """Counts per capture layer and value, most common first.

    A present layer without a value counts as ``unknown``; the transport layer of a
    packet that has neither TCP nor UDP is not counted, nor the IP layer without IP.
    """
    unknown = F.lit("unknown")
    eth = F.coalesce("eth_type", unknown)
    top = F.coalesce("highest_layer", unknown)
    pairs = F.array_compact(
        F.array(
            F.struct(F.lit("ethernet").alias("layer"), eth.alias("value")),
            F.when(
                F.col("ip_proto").isNotNull(),
                F.struct(F.lit("ip").alias("layer"), F.col("ip_proto").alias("value")),
            ),
            F.when(
                F.col("transport").isNotNull(),
                F.struct(F.lit("transport").alias("layer"), F.col("transport").alias("value")),
            ),
            F.struct(F.lit("application").alias("layer"), top.alias("value")),
        )
    )
    return (
        layers.select(F.inline(pairs))
        .groupBy("layer", "value")
        .agg(F.count(F.lit(1)).alias("packets"))
        .orderBy("layer", F.desc("packets"), "value")
    )
