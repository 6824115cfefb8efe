"""Flow, port, protocol, timing and behaviour features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions import calendar, network
from netspark.operators import ordering
from netspark.session import cut_lineage

#: Protocol columns of the wide protocol distribution.
PROTOCOLS = ["DNS", "HTTP", "ICMP", "TCP", "UDP"]
FLOW_KEYS = ["flow", "time_window"]


def with_flow_keys(packets: DataFrame, *, window_seconds: float = 60) -> DataFrame:
    """Add ``flow`` and ``time_window``; every flow operator starts here."""
    return packets.withColumns(
        {
            "flow": calendar.flow_key(F.col("src_ip"), F.col("dst_ip")),
            "time_window": calendar.time_window(F.col("timestamp"), window_seconds),
        }
    )


def enrich_packets(packets: DataFrame) -> DataFrame:
    """Time flags and the same-/24 flag; rows without an address get null."""
    return packets.withColumns(calendar.time_features(F.col("timestamp"))).withColumn(
        "same_subnet", network.same_subnet(F.col("src_ip"), F.col("dst_ip"))
    )


def _length_stats(prefix: str = "length", value: str = "length") -> list[Column]:
    return [
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_std"),
        F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"),
        F.sum(value).alias(f"{prefix}_sum"),
    ]


def flow_features(
    packets: DataFrame,
    *,
    window_seconds: float = 60,
    approximate_distinct: bool = False,
    protocols: Iterable[str] = (),
) -> DataFrame:
    """Per (flow, window): length statistics, distinct counts and rates.

    One shuffle: everything is combined map-side, and distinct values are merged as sets.
    A set has at most 65,536 ports or one entry per protocol name, however many packets
    a hot flow has. ``protocols`` adds the columns of :func:`protocol_distribution` from
    the same scan.
    """
    protocols = list(protocols)
    if approximate_distinct:
        distinct = F.approx_count_distinct
    else:
        distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    seconds = F.lit(float(window_seconds))
    start = calendar.time_window(F.col("timestamp"), window_seconds)
    return (
        packets.dropna(subset=["src_ip", "dst_ip"])
        .groupBy("src_ip", "dst_ip", start.alias("time_window"))
        .agg(
            F.count("length").alias("length_count"),
            *_length_stats(),
            distinct("protocol").alias("protocol_nunique"),
            distinct("src_port").alias("src_port_nunique"),
            distinct("dst_port").alias("dst_port_nunique"),
            F.count("protocol").alias("_known"),
            *[F.count_if(F.col("protocol") == name).alias(name) for name in protocols],
        )
        .withColumns(
            {
                "packet_rate": F.col("length_count") / seconds,
                "byte_rate": F.col("length_sum").cast("double") / seconds,
                **{f"ratio_{n}": F.try_divide(F.col(n), F.col("_known")) for n in protocols},
            }
        )
        .select(
            calendar.flow_key(F.col("src_ip"), F.col("dst_ip")).alias("flow"),
            "*",
        )
        .drop("src_ip", "dst_ip", "_known")
    )


def protocol_distribution(
    packets: DataFrame, *, protocols: Iterable[str] = PROTOCOLS, window_seconds: float = 60
) -> DataFrame:
    """Wide form: one count and one ratio column per protocol, 0 when absent.

    The column list is a parameter, so the plan is a single aggregation without a
    job to discover values. Ratios are shares of all packets, whatever the list;
    :func:`protocol_distribution_long` covers an open vocabulary.
    """
    protocols = list(protocols)
    keyed = with_flow_keys(packets, window_seconds=window_seconds)
    counts = (
        keyed.filter(F.col("flow").isNotNull() & F.col("protocol").isNotNull())
        .groupBy(*FLOW_KEYS)
        .agg(
            F.count(F.lit(1)).alias("_total"),
            *[F.count_if(F.col("protocol") == name).alias(name) for name in protocols],
        )
    )
    ratios = {f"ratio_{name}": F.col(name) / F.col("_total") for name in protocols}
    return counts.withColumns(ratios).drop("_total")


def protocol_distribution_long(packets: DataFrame, *, window_seconds: float = 60) -> DataFrame:
    """Long form for an open protocol vocabulary."""
    keyed = with_flow_keys(packets, window_seconds=window_seconds)
    counts = (
        keyed.filter(F.col("flow").isNotNull() & F.col("protocol").isNotNull())
        .groupBy(*FLOW_KEYS, "protocol")
        .agg(F.count(F.lit(1)).alias("packets"))
    )
    totals = counts.groupBy(*FLOW_KEYS).agg(F.sum("packets").alias("_total"))
    return (
        counts.join(totals, FLOW_KEYS)
        .withColumn("ratio", F.col("packets") / F.col("_total"))
        .drop("_total")
    )


def port_entropy_by_flow(packets: DataFrame, *, window_seconds: float = 60) -> DataFrame:
    """Entropy (bits) of source ports plus that of destination ports, per (flow, window).

    Both port columns are unpivoted, counted per value and folded: H = log2(n) - sum(c*log2 c)/n,
    so the second level needs no total joined in and no group is ever collected.
    """
    keyed = with_flow_keys(packets, window_seconds=window_seconds).filter(
        F.col("flow").isNotNull()
    )
    ports = keyed.select(
        *FLOW_KEYS,
        F.posexplode(F.array("src_port", "dst_port")).alias("side", "port"),
    ).filter(F.col("port").isNotNull())
    per_value = ports.groupBy(*FLOW_KEYS, "side", "port").agg(F.count(F.lit(1)).alias("c"))
    per_side = per_value.groupBy(*FLOW_KEYS, "side").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s")
    )
    entropy = F.log2("n") - F.col("s") / F.col("n")
    return per_side.groupBy(*FLOW_KEYS).agg(F.sum(entropy).alias("port_entropy"))


def port_features(packets: DataFrame, *, window_seconds: float = 60) -> DataFrame:
    """Port class flags and the flow's port entropy on every packet."""
    keyed = with_flow_keys(packets, window_seconds=window_seconds)
    flagged = keyed.withColumns(
        {
            **network.port_classes("src_port", F.col("src_port")),
            **network.port_classes("dst_port", F.col("dst_port")),
        }
    )
    entropy = port_entropy_by_flow(packets, window_seconds=window_seconds)
    return flagged.join(entropy, FLOW_KEYS, "left")


def inter_arrival(packets: DataFrame, *, key: str = "src_ip", first: float | None = None):
    """Seconds since the key's previous packet; ``first`` replaces null on its first packet."""
    previous = ordering.with_previous(packets, key, "timestamp", "_prev")
    gap = F.col("timestamp") - F.col("_prev")
    if first is not None:
        gap = F.when(F.col(key).isNotNull(), F.coalesce(gap, F.lit(float(first))))
    return previous.withColumn("inter_arrival_time", gap).drop("_prev")


def _gap_stats(names: tuple[str, str, str, str]) -> list[Column]:
    mean, std, low, high = names
    return [
        F.avg("gap").alias(mean),
        F.stddev_samp("gap").alias(std),
        F.min("gap").alias(low),
        F.max("gap").alias(high),
    ]


def inter_arrival_stats(packets: DataFrame) -> DataFrame:
    """Per source: statistics of the gaps, first packet left out."""
    names = ("mean_inter_arrival", "std_inter_arrival", "min_inter_arrival", "max_inter_arrival")
    return ordering.gaps(packets, "src_ip", "timestamp").groupBy("src_ip").agg(*_gap_stats(names))


def inter_arrival_stats_flow(packets: DataFrame) -> DataFrame:
    """Per flow: statistics of the gaps, where the first packet counts as 0."""
    found = ordering.gaps(with_flow_keys(packets), "flow", "timestamp")
    filled = found.withColumn("gap", F.coalesce("gap", F.lit(0.0)))
    return filled.groupBy("flow").agg(*_gap_stats(("iat_mean", "iat_std", "iat_min", "iat_max")))


def packets_per_second_stats(packets: DataFrame) -> DataFrame:
    """Per flow: statistics of the packets in each second that has any."""
    keyed = with_flow_keys(packets).filter(F.col("flow").isNotNull())
    per_second = keyed.groupBy("flow", F.col("timestamp").cast("bigint").alias("second")).agg(
        F.count("length").alias("pps")
    )
    return per_second.groupBy("flow").agg(*_length_stats("pps", "pps"))


def packet_pattern_stats(packets: DataFrame, *, window_seconds: float = 60) -> DataFrame:
    """Per (flow, window): length statistics, size-class counts and shares; null becomes 0."""
    classes = network.size_classes(F.col("length"))
    keyed = with_flow_keys(packets, window_seconds=window_seconds)
    stats = (
        keyed.filter(F.col("flow").isNotNull())
        .groupBy(*FLOW_KEYS)
        .agg(
            *_length_stats(),
            F.count("length").alias("length_count"),
            *[F.count_if(flag).alias(f"{name}_sum") for name, flag in classes.items()],
        )
    )
    total = sum((F.col(f"{name}_sum") for name in classes), F.lit(0))
    shares = {
        f"ratio_{name.removeprefix('packet_size_')}": F.try_divide(F.col(f"{name}_sum"), total)
        for name in classes
    }
    stats = stats.withColumns(shares)
    numeric = [c for c in stats.columns if c not in FLOW_KEYS]
    return stats.fillna(0, subset=numeric)


def flow_thresholds(flows: DataFrame, *, quantile: float = 0.95) -> dict[str, float | None]:
    """The quantile of packet count and byte rate over all flows (two scalars)."""
    return ordering.exact_column_quantiles(flows, ["length_count", "byte_rate"], quantile)


def flow_behavior(flows: DataFrame, thresholds: dict[str, float | None] | None = None):
    """Variation, bytes per packet and unusual-volume flags on a flow table.

    Without given thresholds the flows are read twice, so they are written once; pass
    the thresholds of a stored table to keep everything lazy.
    """
    if thresholds is None:
        flows = cut_lineage(flows)
        thresholds = flow_thresholds(flows)
    limits = thresholds
    high = lambda name: F.col(name) > F.lit(limits[name]).cast("double")
    return flows.withColumns(
        {
            "packet_rate_cv": F.try_divide(F.col("length_std"), F.col("length_mean")),
            "byte_per_packet_mean": F.try_divide(
                F.col("length_sum").cast("double"), F.col("length_count")
            ),
            "high_packet_count": high("length_count"),
            "low_packet_count": F.col("length_count") == 1,
            "high_byte_rate": high("byte_rate"),
        }
    )


def port_scan_behavior(packets: DataFrame, *, ratio: float = 0.5) -> DataFrame:
    """Per source: distinct destination ports against packets.

    Packets are first counted per (source, port), so a hot source reaches the second
    level as at most 65,536 partial rows.
    """
    per_port = (
        packets.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip", "dst_port")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_port.groupBy("src_ip")
        .agg(F.count("dst_port").alias("unique_dst_ports"), F.sum("n").alias("packet_count"))
        .withColumn("port_scan_ratio", F.col("unique_dst_ports") / F.col("packet_count"))
        .withColumn("potential_scanner", F.col("port_scan_ratio") > ratio)
    )


def join_group_stats(packets: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group statistics to each packet (unique keys on the right side)."""
    return packets.join(stats, keys, "left")


def combine_feature_groups(
    groups: list[DataFrame], *, keys: list[str] | None = None
) -> DataFrame:
    """Full outer join of feature tables of one grain; numeric nulls become 0."""
    keys = keys or FLOW_KEYS
    combined = groups[0]
    for group in groups[1:]:
        combined = combined.join(group, keys, "full")
    numeric = [
        name
        for name, kind in combined.dtypes
        if name not in keys and kind in ("int", "bigint", "double", "float")
    ]
    return combined.fillna(0, subset=numeric)


def sliding_sequences(
    packets: DataFrame,
    features: list[str],
    *,
    length: int = 10,
    entity: str = "src_ip",
    chunk_rows: int = 4096,
) -> DataFrame:
    """All runs of ``length`` consecutive packets of one entity, as array<array<double>>.

    Each sequence is keyed by its last packet; shorter starts are left out.
    """
    vector = F.array(*[F.col(name).cast("double") for name in features])
    rows = packets.filter(F.col(entity).isNotNull()).select(
        "packet_id", entity, "timestamp", vector.alias("x")
    )
    history = ordering.with_history(
        rows, [entity], "timestamp", ["x"], length, "_h", tie="packet_id", chunk_rows=chunk_rows
    )
    return history.filter(F.size("_h") == length).select(
        "packet_id", entity, "timestamp", F.transform("_h", lambda item: item["x"]).alias("sequence")
    )
