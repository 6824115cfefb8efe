import pytest

from netspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def packets(spark):
    """Build a packet table from (id, time, src, dst) and optional columns."""
    from netspark import schemas

    defaults = {
        "length": 100,
        "protocol": "TCP",
        "src_port": 40000,
        "dst_port": 80,
        "ttl": 64,
        "tcp_flags": 16,
        "attack_type": "normal",
    }

    def build(rows):
        full = []
        for packet_id, time, src, dst, *rest in rows:
            values = {**defaults, **(rest[0] if rest else {})}
            values.update(packet_id=packet_id, timestamp=float(time), src_ip=src, dst_ip=dst)
            full.append(tuple(values[f.name] for f in schemas.PACKETS.fields))
        return spark.createDataFrame(full, schemas.PACKETS)

    return build
