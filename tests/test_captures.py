"""Hand-packed capture files."""

import os
import random
import struct

import pytest

from netspark.sources import capture_source, captures


def ipv4(protocol, payload, *, src=(10, 0, 0, 1), dst=(10, 0, 0, 2), ttl=64, offset=0, options=b""):
    words = 5 + len(options) // 4
    head = struct.pack(
        ">BBHHHBBH4B4B", 0x40 + words, 0, 4 * words + len(payload), 1, offset, ttl, protocol, 0, *src, *dst
    )
    return head + options + payload


def tcp(src, dst, flags):
    return struct.pack(">HHIIBBHHH", src, dst, 0, 0, 0x50, flags, 0, 0, 0)


def udp(src, dst):
    return struct.pack(">HHHH", src, dst, 8, 0)


def ethernet(kind, payload, vlan=False):
    tag = struct.pack(">HH", 0x8100, 7) if vlan else b""
    return b"\x01" * 12 + tag + struct.pack(">H", kind) + payload


FRAMES = [
    ethernet(0x0800, ipv4(6, tcp(51000, 443, 0x02))),
    ethernet(0x0800, ipv4(17, udp(5353, 53), ttl=128)),
    ethernet(0x0800, ipv4(1, b"\x08\x00\x00\x00", src=(192, 168, 1, 9))),
    ethernet(0x0806, b"\x00" * 28),
    ethernet(0x0800, ipv4(6, tcp(22, 40000, 0x18)), vlan=True),
    ethernet(0x0800, ipv4(6, tcp(1, 2, 0x10), options=b"\x01" * 8)),
    ethernet(0x0800, ipv4(17, b"\x00" * 16, offset=100)),
    ethernet(0x86DD, b"\x60" + b"\x00" * 40),
    ethernet(0x0800, ipv4(6, b"\x00\x50")),  # header cut off by the snap length
]


def classic(frames, order="<", nanoseconds=False, tail=b""):
    magic = 0xA1B23C4D if nanoseconds else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, frame in enumerate(frames):
        fraction = 250_000_000 if nanoseconds else 250_000
        out += struct.pack(order + "IIII", 1_700_000_000 + i, fraction, len(frame), len(frame) + 4) + frame
    return out + tail


def blocks(frames, order="<"):
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        size = 12 + len(body)
        return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)

    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    resolution = struct.pack(order + "HHBBBBHH", 9, 1, 9, 0, 0, 0, 0, 0)  # nanoseconds
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + resolution)
    out += block(5, b"\x00" * 8)  # a statistics block, skipped
    for i, frame in enumerate(frames):
        ticks = (1_700_000_000 + i) * 10**9 + 250_000_000
        head = struct.pack(order + "5I", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame) + 4)
        out += block(6, head + frame)
    return out


def read(spark, tmp_path, data):
    (tmp_path / "a.pcap").write_bytes(data)
    return capture_source.read_captures(spark, str(tmp_path))


FILES = {
    "little": classic(FRAMES),
    "big": classic(FRAMES, ">"),
    "nano": classic(FRAMES, nanoseconds=True),
    "blocks": blocks(FRAMES),
    "big blocks": blocks(FRAMES, ">"),
}


@pytest.mark.parametrize("name", FILES)
def test_layers(spark, tmp_path, name):
    rows = read(spark, tmp_path, FILES[name]).orderBy("record").collect()
    assert [round(r.timestamp, 6) for r in rows] == [1_700_000_000.25 + i for i in range(9)]
    assert [r.frame_length for r in rows] == [len(f) + 4 for f in FRAMES]
    assert [r.transport for r in rows] == ["TCP", "UDP", None, None, "TCP", "TCP", None, None, None]
    assert [r.highest_layer for r in rows][:5] == ["TLS", "DNS", "ICMP", "ARP", "SSH"]
    assert (rows[0].src_port, rows[0].dst_port, rows[0].tcp_flags) == (51000, 443, 2)
    assert (rows[1].src_port, rows[1].ttl, rows[1].tcp_flags) == (5353, 128, None)
    assert (rows[2].src_ip, rows[2].src_port, rows[2].ip_proto) == ("192.168.1.9", None, "1")
    assert (rows[3].eth_type, rows[3].src_ip) == ("0x0806", None)
    assert (rows[4].src_port, rows[4].tcp_flags) == (22, 24)
    assert (rows[5].src_port, rows[5].dst_port) == (1, 2)
    assert (rows[6].src_ip, rows[6].src_port) == ("10.0.0.1", None)  # a later fragment
    assert rows[7].eth_type == "0x86dd" and rows[7].src_ip is None
    assert [r.malformed for r in rows] == [False] * 8 + [True]


def test_packets_leave_out_malformed_records(spark, tmp_path):
    cut = struct.pack("<IIII", 1_700_000_100, 0, 60, 60) + b"\x00" * 10
    dissected = read(spark, tmp_path, classic(FRAMES, tail=cut))
    packets = captures.to_packets(dissected).collect()
    assert len(packets) == 8 and {p.protocol for p in packets} == {"TCP", "UDP", "UNKNOWN"}
    assert len({p.packet_id for p in packets}) == 8
    counts = captures.malformed_counts(dissected).first()
    assert (counts.records, counts.malformed) == (10, 2)


@pytest.mark.parametrize("data", [b"", b"not a capture", classic([])])
def test_no_packets(spark, tmp_path, data):
    assert captures.to_packets(read(spark, tmp_path, data)).count() == 0


def test_many_files_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(captures, "ROWS_PER_BATCH", 4)
    for i in range(5):
        (tmp_path / f"{i}.pcap").write_bytes(classic(FRAMES))
    rows = capture_source.read_captures(spark, str(tmp_path)).collect()
    files = {r.file for r in rows}
    assert len(rows) == 45 and len(files) == 5 and len({(r.file, r.record) for r in rows}) == 45


def many_frames(count, seed=1):
    """Frames of many sizes; some carry what looks like a few record headers."""
    draw = random.Random(seed)
    fake = b"".join(struct.pack("<IIII", 1_700_000_000, 7, 0, 0) for _ in range(5)) + b"\xff" * 20
    out = []
    for k in range(count):
        payload = fake if k % 7 == 0 else draw.randbytes(draw.randint(0, 400))
        out.append(ethernet(0x0800, ipv4(17, udp(k % 60_000, 53) + payload)))
    return out


@pytest.mark.parametrize("order, nanoseconds", [("<", False), (">", True)])
@pytest.mark.parametrize("range_bytes", [1_000, 7_777, 1 << 20])
def test_ranges_of_a_file_fit_together(spark, tmp_path, order, nanoseconds, range_bytes):
    frames = many_frames(400)
    (tmp_path / "a.pcap").write_bytes(classic(frames, order, nanoseconds, tail=b"\x01" * 9))
    (tmp_path / "b.pcap").write_bytes(blocks(frames[:50]))
    (tmp_path / ".hidden").write_bytes(b"x")
    found = capture_source.read_captures(spark, str(tmp_path), range_bytes=range_bytes)
    rows = found.orderBy("file", "record").collect()
    assert [r.src_port for r in rows if not r.malformed] == [*range(400), *range(50)]
    assert sum(r.malformed for r in rows) == 1  # the cut end
    assert capture_source.untiled(spark, str(tmp_path), range_bytes=range_bytes).count() == 0
    if range_bytes == 1_000:
        assert found.rdd.getNumPartitions() > 90


def test_a_hidden_chain_is_noticed(spark, tmp_path):
    """A frame with a whole capture inside can mislead a range; the sums show it."""
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 7, 20, 20) + b"\x00" * 20 for _ in range(60))
    (tmp_path / "a.pcap").write_bytes(classic([*FRAMES, inner, *FRAMES]))
    whole = capture_source.read_captures(spark, str(tmp_path))
    assert whole.count() == 19 and capture_source.untiled(spark, str(tmp_path)).count() == 0
    assert capture_source.untiled(spark, str(tmp_path), range_bytes=1_500).count() == 1


def test_columns_and_counts_of_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic(FRAMES))
    spark.dataSource.register(capture_source.CaptureSource)
    found = spark.read.format(capture_source.FORMAT).option("columns", "src_ip, timestamp").load(str(tmp_path))
    assert found.columns == ["src_ip", "timestamp"] and found.count() == 9


def test_arriving_captures(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drained():
        stream = capture_source.read_capture_stream(spark, str(folder), range_bytes=2_000)
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point"))
            .trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
        return sorted((r.file.rsplit("/", 1)[1], r.src_port) for r in spark.read.parquet(out).collect())

    (folder / "a.pcap").write_bytes(classic(many_frames(40)))
    assert drained() == [("a.pcap", k) for k in range(40)]
    (folder / "b.pcap").write_bytes(classic(many_frames(30)))
    os.utime(folder / "b.pcap", (2_000_000_000, 2_000_000_000))
    assert drained() == [("a.pcap", k) for k in range(40)] + [("b.pcap", k) for k in range(30)]
