"""Address, port and size columns of a packet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports that count as well known.
WELL_KNOWN_PORTS = [
    20, 21, 22, 23, 25, 53, 80, 123, 143, 161, 443, 445, 993, 995, 3306, 3389, 8080,
]

# Networks that count as inside.
INTERNAL_NETWORKS = ["192.168.1.0/24", "10.0.0.0/8", "172.16.0.0/12"]

_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
DOTTED_QUAD = rf"^{_OCTET}(\.{_OCTET}){{3}}$"

# Size class, lowest length, length it stays below.
SIZE_CLASSES = [
    ("tiny", None, 64),
    ("small", 64, 256),
    ("medium", 256, 1024),
    ("large", 1024, 1500),
    ("jumbo", 1500, None),
]


def subnet24(ip: Column) -> Column:
    """The first three octets."""
    return F.substring_index(ip, ".", 3)


def same_subnet(src: Column, dst: Column) -> Column:
    return subnet24(src) == subnet24(dst)


def _false_if_null(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def port_classes(prefix: str, port: Column) -> dict[str, Column]:
    """Well-known, registered and dynamic flags; a missing port is in no class."""
    return {
        f"{prefix}_well_known": _false_if_null(port.isin(WELL_KNOWN_PORTS)),
        f"{prefix}_registered": _false_if_null(port.between(1024, 49151)),
        f"{prefix}_dynamic": _false_if_null(port >= 49152),
    }


def size_classes(length: Column) -> dict[str, Column]:
    """One flag per size class."""
    flags = {}
    for name, low, high in SIZE_CLASSES:
        tests = []
        if low is not None:
            tests.append(length >= low)
        if high is not None:
            tests.append(length < high)
        flags[f"packet_size_{name}"] = _false_if_null(reduce(lambda a, b: a & b, tests))
    return flags


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to a number; null for anything else."""
    octets = F.split(ip, r"\.").cast("array<bigint>")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, octet: acc * 256 + octet)
    return F.when(ip.rlike(DOTTED_QUAD), number)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """Lowest and highest address of a network, as numbers."""
    base, bits = cidr.split("/")
    value = 0
    for part in base.split("."):
        value = value * 256 + int(part)
    size = 2 ** (32 - int(bits))
    low = value - value % size
    return low, low + size - 1


def in_networks(ip: Column, networks: list[str] | None = None) -> Column:
    """True when the address lies in one of the networks (a short, fixed list)."""
    bounds = [cidr_bounds(net) for net in (networks or INTERNAL_NETWORKS)]

    def inside(number: Column) -> Column:
        return reduce(lambda a, b: a | b, [number.between(low, high) for low, high in bounds])

    # The one-element array binds the number, so it is computed once for all networks.
    return F.exists(F.array(ipv4_to_long(ip)), inside)


def direction(src: Column, dst: Column, networks: list[str] | None = None) -> Column:
    """``internal``, ``outbound``, ``inbound`` or ``external``; null if an end is unknown.

    Looked up by position, so each membership test is evaluated once per row.
    """
    names = F.array(*[F.lit(n) for n in ("external", "inbound", "outbound", "internal")])
    src_in, dst_in = (in_networks(ip, networks).cast("int") for ip in (src, dst))
    return F.get(names, src_in * 2 + dst_in)
