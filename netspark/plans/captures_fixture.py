"""Packets to capture files, so that the capture reader can be run on the packet table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = np.array([0xA1B2C3D4], "<u4").tobytes() + np.array([2, 4], "<u2").tobytes() + np.array(
    [0, 0, 65535, 1], "<u4"
).tobytes()
_FRAME = 54


def _octets(addresses: pd.Series) -> np.ndarray:
    parts = addresses.fillna("0.0.0.0").str.split(".", expand=True)
    return parts.astype(np.uint8).to_numpy()


def _encode(packets: pd.DataFrame) -> bytes:
    """One classic capture: record header, Ethernet, IPv4 and a TCP or UDP header each."""
    packets = packets.sort_values("packet_id")
    rows = len(packets)
    record = np.zeros((rows, 16 + _FRAME), dtype=np.uint8)
    seconds = np.floor(packets["timestamp"].to_numpy())
    micros = np.round((packets["timestamp"].to_numpy() - seconds) * 1e6)
    head = np.stack(
        [seconds, micros, np.full(rows, _FRAME), packets["length"].to_numpy()], axis=1
    ).astype("<u4")
    record[:, :16] = head.view(np.uint8).reshape(rows, 16)
    frame = record[:, 16:]
    is_ip = packets["dst_ip"].notna().to_numpy()
    frame[:, 12] = 0x08
    frame[:, 13] = np.where(is_ip, 0x00, 0x06)
    kind = packets["protocol"].map({"TCP": 6, "HTTP": 6, "UDP": 17, "DNS": 17}).fillna(1)
    frame[:, 14] = 0x45
    frame[:, 22] = packets["ttl"].to_numpy()
    frame[:, 23] = kind.to_numpy()
    frame[:, 26:30] = _octets(packets["src_ip"])
    frame[:, 30:34] = _octets(packets["dst_ip"])
    for column, at in (("src_port", 34), ("dst_port", 36)):
        port = packets[column].to_numpy().astype(np.int64)
        frame[:, at], frame[:, at + 1] = port // 256, port % 256
    frame[:, 47] = packets["tcp_flags"].fillna(0).astype(np.uint8).to_numpy()
    frame[~is_ip, 14:] = 0
    return _HEADER + record.tobytes()


def encode_captures(packets: DataFrame, *, packets_per_file: int = 5_000) -> DataFrame:
    """(path, content), like a folder of capture files read as binary."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        name = f"capture-{int(part['_file'].iloc[0]):012d}.pcap"
        return pd.DataFrame({"path": [name], "content": [_encode(part)]})

    numbered = packets.withColumn("_file", F.floor(F.col("packet_id") / packets_per_file))
    return numbered.groupBy("_file").applyInPandas(build, "path string, content binary")


def write_captures(packets: DataFrame, folder: str, *, packets_per_file: int = 5_000) -> None:
    """Capture files in a folder that all executors reach; a repeated task writes the same files again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = "://" not in folder and not folder.startswith("file:")
        system, root = (pafs.LocalFileSystem(), folder) if local else pafs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with system.open_output_stream(f"{root}/{name}") as file:
                    file.write(content)
            yield batch[["path"]]

    encode_captures(packets, packets_per_file=packets_per_file).mapInPandas(write, "path string").count()
