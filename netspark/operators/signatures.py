"""Detectors of common attack patterns, per tumbling window.

Every detector counts per (group, value) before it counts values, so a group that
holds most of the traffic is already small when it is shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import network
from netspark.functions.calendar import time_window
from netspark.operators import ordering

# Shapes of the known patterns.
SYN, ACK = 2, 16
SCAN_LENGTHS = (40, 100)
FLOOD_LENGTH = 500
FLOOD_PORTS = [80, 443, 8080, 22, 53]
EXFILTRATION_LENGTH = 1200
EXFILTRATION_PORTS = [6667, 4444, 8443, 8080, 9001]
LOGIN_PORTS = [22, 3389, 5900, 23, 445]
BEACON_LENGTHS = (60, 200)
BEACON_GAPS = (30.0, 300.0)
TUNNEL_LENGTH = 300
DNS_PORT = 53


def _windowed(packets: DataFrame, seconds: float) -> DataFrame:
    return packets.withColumn("time_window", time_window(F.col("timestamp"), seconds))


def port_scans(packets: DataFrame, *, min_ports: int = 8, window_seconds: float = 60):
    """One source tries many ports of one target with small SYN packets."""
    probes = packets.filter(
        (F.col("protocol") == "TCP")
        & (F.col("tcp_flags") == SYN)
        & F.col("length").between(*SCAN_LENGTHS)
    ).dropna(subset=["src_ip", "dst_ip", "dst_port"])
    per_port = (
        _windowed(probes, window_seconds)
        .groupBy("src_ip", "dst_ip", "time_window", "dst_port")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_port.groupBy("src_ip", "dst_ip", "time_window")
        .agg(F.count(F.lit(1)).alias("ports"), F.sum("n").alias("packets"))
        .filter(F.col("ports") >= min_ports)
    )


def floods(
    packets: DataFrame,
    *,
    min_sources: int = 5,
    min_length: int = FLOOD_LENGTH,
    ports: list[int] | None = None,
    window_seconds: float = 60,
):
    """Many sources send large packets to one service."""
    large = packets.filter(
        F.col("dst_port").isin(ports or FLOOD_PORTS) & (F.col("length") >= min_length)
    ).dropna(subset=["src_ip", "dst_ip"])
    per_source = (
        _windowed(large, window_seconds)
        .groupBy("dst_ip", "dst_port", "time_window", "src_ip")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    )
    return (
        per_source.groupBy("dst_ip", "dst_port", "time_window")
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.sum("n").alias("packets"),
            F.sum("b").alias("bytes"),
        )
        .filter(F.col("sources") >= min_sources)
        .withColumn("packet_rate", F.col("packets") / F.lit(float(window_seconds)))
    )


def exfiltration(
    packets: DataFrame,
    *,
    min_bytes: int = 100_000,
    window_seconds: float = 3600,
    networks: list[str] | None = None,
):
    """Large outbound packets to unusual ports add up to much data."""
    outbound = packets.filter(
        F.col("dst_port").isin(EXFILTRATION_PORTS) & (F.col("length") >= EXFILTRATION_LENGTH)
    ).filter(network.direction(F.col("src_ip"), F.col("dst_ip"), networks) == "outbound")
    return (
        _windowed(outbound, window_seconds)
        .groupBy("src_ip", "dst_ip", "time_window")
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"))
        .filter(F.col("bytes") >= min_bytes)
    )


def brute_force(packets: DataFrame, *, min_hits: int = 8, window_seconds: float = 60):
    """Repeated hits of one source on one login service."""
    logins = packets.filter(F.col("dst_port").isin(LOGIN_PORTS)).dropna(
        subset=["src_ip", "dst_ip"]
    )
    return (
        _windowed(logins, window_seconds)
        .groupBy("src_ip", "dst_ip", "dst_port", "time_window")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter(F.col("hits") >= min_hits)
    )


def login_attempts(
    packets: DataFrame,
    *,
    syn: int = SYN,
    ack: int = ACK,
    fin: int = 1,
    min_attempts: int = 1,
    window_seconds: float = 60,
):
    """SYN, ACK and FIN in a row from one source port: complete short logins."""
    logins = _windowed(
        packets.filter(F.col("dst_port").isin(LOGIN_PORTS) & F.col("tcp_flags").isNotNull()),
        window_seconds,
    )
    keys = ["src_ip", "dst_ip", "dst_port", "src_port", "time_window"]
    rows = logins.select(*keys, "timestamp", "packet_id", "tcp_flags").dropna(subset=keys)
    ended = ordering.with_history(
        rows, keys, "timestamp", ["tcp_flags"], 3, "_last", tie="packet_id"
    ).filter(F.size("_last") == 3)
    flag = lambda i: F.col("_last")[i]["tcp_flags"]
    is_fin = flag(2).bitwiseAND(F.lit(fin)) == fin
    return (
        ended.filter((flag(0) == syn) & (flag(1) == ack) & is_fin)
        .groupBy("src_ip", "dst_ip", "dst_port", "time_window")
        .agg(F.count(F.lit(1)).alias("attempts"))
        .filter(F.col("attempts") >= min_attempts)
    )


def beaconing(
    packets: DataFrame,
    *,
    min_gaps: int = 3,
    min_share: float = 0.5,
    gaps: tuple[float, float] = BEACON_GAPS,
    networks: list[str] | None = None,
):
    """Small packets from inside to one outside address at regular, long gaps."""
    small = packets.filter(F.col("length").between(*BEACON_LENGTHS)).filter(
        network.direction(F.col("src_ip"), F.col("dst_ip"), networks) == "outbound"
    )
    pairs = small.withColumn("pair", F.struct("src_ip", "dst_ip"))
    found = ordering.gaps(pairs, "pair", "timestamp", bucket_seconds=3600)
    return (
        found.filter(F.col("gap").isNotNull())
        .groupBy("pair.src_ip", "pair.dst_ip")
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.count_if(F.col("gap").between(*gaps)).alias("gaps_in_band"),
            F.avg("gap").alias("gap_mean"),
            F.stddev_samp("gap").alias("gap_std"),
        )
        .withColumn("share_in_band", F.col("gaps_in_band") / F.col("gaps"))
        .withColumn("gap_cv", F.try_divide("gap_std", "gap_mean"))
        .filter((F.col("gaps") >= min_gaps) & (F.col("share_in_band") >= min_share))
    )


def dns_tunnels(packets: DataFrame, *, min_packets: int = 3, min_share: float = 0.3):
    """Sources whose DNS packets are unusually often large."""
    dns = packets.filter((F.col("protocol") == "DNS") & (F.col("dst_port") == DNS_PORT))
    return (
        dns.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).alias("dns_packets"),
            F.count_if(F.col("length") >= TUNNEL_LENGTH).alias("large_packets"),
        )
        .withColumn("large_share", F.col("large_packets") / F.col("dns_packets"))
        .filter((F.col("dns_packets") >= min_packets) & (F.col("large_share") >= min_share))
    )


def sequential_scans(packets: DataFrame, *, min_run: int = 3, window_seconds: float = 60):
    """Runs of consecutive ports tried on one target within a window.

    Ports are made distinct first, so a group has at most 65,536 rows.
    """
    ports = (
        _windowed(packets.dropna(subset=["src_ip", "dst_ip", "dst_port"]), window_seconds)
        .select("src_ip", "dst_ip", "time_window", "dst_port")
        .distinct()
    )
    rank = Window.partitionBy("src_ip", "dst_ip", "time_window").orderBy("dst_port")
    islands = ports.withColumn("_island", F.col("dst_port") - F.row_number().over(rank))
    return (
        islands.groupBy("src_ip", "dst_ip", "time_window", "_island")
        .agg(
            F.min("dst_port").alias("first_port"),
            F.max("dst_port").alias("last_port"),
            F.count(F.lit(1)).alias("run_length"),
        )
        .filter(F.col("run_length") >= min_run)
        .drop("_island")
    )
