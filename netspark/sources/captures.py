"""Captures to packets: headers decoded with array operations.

``dissect_captures`` takes whole captures as binary rows, which hold 2 GB at most; ``capture_source`` reads
files of any size by ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark import schemas
from netspark.functions.severity import lookup

# File signatures (byte order, fractions of a second per unit).
_CLASSIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
}
_SECTION = b"\x0a\x0d\x0d\x0a"
_ETHERNET, _VLAN, _IPV4, _TCP, _UDP = 1, 0x8100, 0x0800, 6, 17

# Names of well-known services, shown as the highest layer.
SERVICES = {20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 80: "HTTP",
            123: "NTP", 161: "SNMP", 443: "TLS", 445: "SMB", 3389: "RDP"}

ROWS_PER_BATCH = 50_000


def _classic_records(data: bytes) -> Iterator[tuple[float, int, int, int]]:
    """(time, start, captured, original) per record; a cut last record has captured < 0."""
    order, unit = _CLASSIC[data[:4]]
    head = struct.Struct(order + "IIII")
    at = 24
    while at + 16 <= len(data):
        seconds, fraction, captured, original = head.unpack_from(data, at)
        at += 16
        if at + captured > len(data):
            yield seconds + fraction * unit, at, -1, original
            return
        yield seconds + fraction * unit, at, captured, original
        at += captured
    if at < len(data):
        yield 0.0, at, -1, 0


def _resolution(options: bytes, order: str) -> float:
    """Seconds per time unit of an interface; microseconds unless option 9 says otherwise."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = options[at + 4]
            return 2.0 ** -(value & 0x7F) if value & 0x80 else 10.0**-value
        at += 4 + size + (-size % 4)
    return 1e-6


def _block_records(data: bytes) -> Iterator[tuple[float, int, int, int]]:
    """Records of a block-structured capture: enhanced and simple packet blocks."""
    order, units, at = "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == _SECTION:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            units = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            yield 0.0, at, -1, 0
            return
        if kind == 1:
            units.append(_resolution(data[at + 16 : at + size - 4], order))
        elif kind == 6:
            port, high, low, captured, original = struct.unpack_from(order + "5I", data, at + 8)
            unit = units[port] if port < len(units) else 1e-6
            fits = captured <= size - 32
            yield ((high << 32) + low) * unit, at + 28, captured if fits else -1, original
        elif kind == 3:
            (original,) = struct.unpack_from(order + "I", data, at + 8)
            yield 0.0, at + 12, min(original, size - 16), original
        at += size


def records(data: bytes) -> Iterator[tuple[float, int, int, int]]:
    if data[:4] in _CLASSIC:
        return _classic_records(data)
    if data[:4] == _SECTION:
        return _block_records(data)
    return iter([(0.0, 0, -1, 0)])


def _dissect(file: str, first: int, data: np.ndarray, found: list[tuple]) -> pd.DataFrame:
    """Header fields of many records at once."""
    time, start, captured, original = (np.array(column) for column in zip(*found))
    start = start.astype(np.int64)
    end = start + np.maximum(captured, 0)
    rows = len(found)

    def byte(position: np.ndarray) -> np.ndarray:
        return np.where(position < end, data[np.minimum(position, len(data) - 1)], 0).astype(np.int64)

    def word(position: np.ndarray) -> np.ndarray:
        return byte(position) * 256 + byte(position + 1)

    framed = captured >= 14
    ether = word(start + 12)
    tagged = framed & (ether == _VLAN)
    ether = np.where(tagged, word(start + 16), ether)
    ip = start + np.where(tagged, 18, 14)
    has_ip = framed & (ether == _IPV4) & (ip + 20 <= end) & (byte(ip) // 16 == 4)
    inner = ip + (byte(ip) % 16) * 4
    protocol = byte(ip + 9)
    whole = (word(ip + 6) % 0x2000) == 0  # later fragments carry no ports
    has_tcp = has_ip & whole & (protocol == _TCP) & (inner + 14 <= end)
    has_udp = has_ip & whole & (protocol == _UDP) & (inner + 8 <= end)
    has_ports = has_tcp | has_udp
    cut = (captured < 0) | ~framed | (framed & (ether == _IPV4) & ~has_ip) | (
        has_ip & whole & np.isin(protocol, (_TCP, _UDP)) & ~has_ports
    )

    def text(mask, values) -> pd.Series:
        return pd.Series(values, dtype=object).where(mask, None)

    def number(mask, values) -> pd.Series:
        return pd.Series(values).astype("Int64").where(pd.Series(mask))

    def address(position: np.ndarray) -> list[str]:
        parts = [byte(position + i) for i in range(4)]
        return [f"{a}.{b}.{c}.{d}" for a, b, c, d in zip(*parts)]

    return pd.DataFrame(
        {
            "file": file,
            "record": np.arange(first, first + rows),
            "timestamp": time.astype(float),
            "frame_length": original.astype(np.int64),
            "eth_type": text(framed, [f"0x{v:04x}" for v in ether]),
            "ip_proto": text(has_ip, [str(v) for v in protocol]),
            "src_ip": text(has_ip, address(ip + 12)),
            "dst_ip": text(has_ip, address(ip + 16)),
            "ttl": number(has_ip, byte(ip + 8)),
            "transport": text(has_ports, np.where(has_tcp, "TCP", "UDP")),
            "src_port": number(has_ports, word(inner)),
            "dst_port": number(has_ports, word(inner + 2)),
            "tcp_flags": number(has_tcp, byte(inner + 13)),
            "highest_layer": None,
            "malformed": cut,
        }
    )


def dissect_captures(files: DataFrame) -> DataFrame:
    """(path, content) rows to one row per record, layer columns null where absent."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                data = np.frombuffer(content, dtype=np.uint8)
                first, found = 0, []
                for record in records(content):
                    found.append(record)
                    if len(found) == ROWS_PER_BATCH:
                        yield _dissect(path, first, data, found)
                        first, found = first + len(found), []
                if found and len(data):
                    yield _dissect(path, first, data, found)

    return with_service(files.select("path", "content").mapInPandas(decode, schemas.DISSECTED))


def with_service(decoded: DataFrame) -> DataFrame:
    """Dissected records with the name of their highest layer."""
    service = F.coalesce(
        lookup(SERVICES, F.least("src_port", "dst_port")),
        F.col("transport"),
        F.when(F.col("ip_proto") == "1", "ICMP"),
        F.when(F.col("ip_proto").isNotNull(), "IP"),
        F.when(F.col("eth_type") == "0x0806", "ARP"),
    )
    return decoded.withColumn("highest_layer", service)


def to_packets(dissected: DataFrame) -> DataFrame:
    """Dissected records to packets; malformed records are left out (count them separately).

    Length defaults to 0, the protocol to UNKNOWN; addresses, ports and flags stay null
    where the layer is absent.
    """
    return dissected.filter(~F.col("malformed")).select(
        F.xxhash64("file", "record").alias("packet_id"),
        "timestamp",
        F.coalesce(F.col("frame_length").cast("int"), F.lit(0)).alias("length"),
        F.coalesce("transport", F.lit("UNKNOWN")).alias("protocol"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "ttl",
        "tcp_flags",
    )


def malformed_counts(dissected: DataFrame) -> DataFrame:
    """Records and malformed records per file."""
    return dissected.groupBy("file").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("malformed").alias("malformed")
    )
