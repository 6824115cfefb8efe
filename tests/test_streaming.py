"""Streams against the batch operators on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.operators import alerts as al
from netspark.operators import flows
from netspark.sources import readers
from netspark.streaming import live_gaps, streams


@pytest.fixture
def arrivals(spark, packets, tmp_path):
    """A folder and a function that adds one packet file to it."""
    folder = str(tmp_path / "in")

    def add(rows):
        packets(rows).coalesce(1).write.mode("append").option("header", True).csv(folder)

    return folder, add


def drain(spark, stream, write, tmp_path, name, **options):
    running = streams.write_batches(
        stream, write, str(tmp_path / f"{name}-checkpoint"), state_partitions=2, **options
    )
    running.awaitTermination()
    assert running.exception() is None
    return running


def test_flow_windows_equal_batch_and_drop_late_rows(spark, arrivals, packets, tmp_path):
    folder, add = arrivals
    first = [(i, 1000 + i * 7, "a", "b", {"length": 50 + i}) for i in range(40)]
    late = [(900, 1000, "a", "b", {"length": 1})]
    last = [(1000, 3000, "a", "b"), (1001, 3001, "x", None)]
    add(first)
    add(last)
    add(late)
    stream = readers.read_packet_stream(spark, folder, files_per_trigger=1)
    windows = streams.flow_windows(streams.with_event_time(stream))
    out = str(tmp_path / "out")
    drain(spark, windows, streams.to_folders(out), tmp_path, "flows")
    names = ["flow", "time_window", "length_count", "length_sum", "length_min", "src_port_nunique"]
    found = {tuple(r) for r in spark.read.parquet(out).select(*names).collect()}
    batch = flows.flow_features(packets(first + last)).filter("time_window + 60 <= 3001 - 120")
    assert found == {tuple(r) for r in batch.select(*names).collect()}
    assert len(found) >= 5


def live(spark, folder, tmp_path, **options):
    stream = readers.read_packet_stream(spark, folder, files_per_trigger=1)
    slots = live_gaps.gap_slots(stream, slot_seconds=10, delay="5 seconds")
    out = str(tmp_path / "slots")
    done = drain(spark, slots, streams.to_folders(out), tmp_path, "gaps", **options)
    return spark.read.parquet(out).drop("batch"), done


def test_live_gaps_equal_batch(spark, arrivals, packets, tmp_path):
    """Rows of a batch and of neighbouring batches come in any order within the delay."""
    folder, add = arrivals
    parts = [
        [(i, i * 0.5, "ab"[i % 2], "z") for i in reversed(range(30))],
        [(100 + i, 14 + i * 1.25, "a", "z") for i in range(10)],
        [(200, 50, "new", "z"), (201, 50, "a", "z"), (202, 50, "a", "z"), (203, 51, None, "z")],
        [(300, 999, None, "z")],
    ]
    for part in parts:
        add(part)
    slots, done = live(spark, folder, tmp_path)
    found = {r.src_ip: tuple(r)[1:] for r in live_gaps.statistics(slots).collect()}
    batch = flows.inter_arrival_stats(packets([row for part in parts for row in part]))
    expected = {r.src_ip: (*tuple(r)[1:], 0, 0) for r in batch.collect()}
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values), key
    # All slots are closed, so no state is left.
    assert done.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_live_gaps_count_late_and_undated_rows(spark, arrivals, packets, tmp_path):
    folder, add = arrivals
    add([(1, 0.0, "a", "z"), (2, 4.0, "a", "z"), (3, 1.0, "b", "z")])
    add([(4, 100.0, "a", "z")])
    undated = packets([(5, 0, "a", "z"), (6, 0, "c", "z")]).withColumn("timestamp", F.lit(None).cast("double"))
    undated.coalesce(1).write.mode("append").option("header", True).csv(folder)
    add([(7, 3.0, "a", "z"), (8, 5.0, "b", "z"), (9, 98.0, "a", "z")])
    add([(10, 500.0, None, "z")])
    slots, _ = live(spark, folder, tmp_path)
    rows = {r.src_ip: r for r in live_gaps.merged(slots).collect()}
    assert {k: (r.packets, r.n, r.first, r.last, r.low, r.high, r.late, r.undated) for k, r in rows.items()} == {
        "a": (4, 3, 0.0, 100.0, 2.0, 94.0, 1, 1),
        "b": (1, 0, 1.0, 1.0, None, None, 1, 0),
        "c": (0, 0, None, None, None, None, 0, 1),
    }
    # A source that was silent for too long starts anew.
    short = {r.src_ip: r for r in live_gaps.merged(slots, expire_seconds=50).collect()}
    assert (short["a"].n, short["a"].high) == (2, 4.0)


def test_untouched_slots_stay_as_they_are(spark, arrivals, tmp_path):
    folder, add = arrivals
    for second in range(4):
        add([(10 * second + i, second + 0.1 * i, source, "z") for i, source in enumerate("abcdefgh" if second == 0 else "a")])
    _, done = live(spark, folder, tmp_path)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in done.recentProgress if p["numInputRows"]]
    # A chunk of times, its count and a timer for each source that has rows.
    assert updated[0] >= 8 and max(updated[1:]) <= 4


def test_merged_summaries_merge_again(spark):
    def slot_rows(times):
        by_slot = {}
        for t in times:
            by_slot.setdefault(int(t // 10), []).append(t)
        return [
            {"src_ip": "a", "slot": k, **live_gaps.summary(np.array(v))} for k, v in sorted(by_slot.items())
        ]

    draw = np.random.default_rng(5)
    times = np.round(np.cumsum(draw.exponential(4, 60)), 3)
    rows = slot_rows(times)
    table = lambda some: spark.createDataFrame(some, live_gaps.SLOTS)
    early = live_gaps.merged(table(rows[:7]))
    twice = live_gaps.merged(early.unionByName(table(rows[7:]))).first()
    gaps = np.diff(times)
    assert (twice.n, twice.first, twice.last) == (59, times[0], times[-1])
    assert (twice.mean, twice.m2) == pytest.approx((gaps.mean(), ((gaps - gaps.mean()) ** 2).sum()))
    assert (twice.low, twice.high) == pytest.approx((gaps.min(), gaps.max()))


def test_replayed_batch_changes_nothing(spark, packets, tmp_path):
    path = str(tmp_path / "alerts")
    write = streams.alert_writer(path)
    detections = packets([(i, i, "a", "b", {"attack_type": "ddos"}) for i in range(120)]).withColumns(
        {"prediction": F.when(F.col("packet_id") % 2 == 0, -1).otherwise(1), "anomaly_score": F.lit(-0.9)}
    )
    write(detections, 3)
    write(detections, 3)
    alerts = spark.read.parquet(f"{path}/alerts")
    assert alerts.count() == 60
    assert spark.read.parquet(f"{path}/routes").groupBy("channel").count().orderBy("channel").collect() == [
        ("chat", 60),
        ("email", 60),
    ]
    batches = spark.read.json(f"{path}/outbound").orderBy("batch_id").collect()
    assert [b.batch_rows for b in batches] == [50, 10]


def test_restart_goes_on(spark, arrivals, tmp_path):
    folder, add = arrivals
    out = str(tmp_path / "totals")
    for day in range(2):
        add([(day * 10 + i, i, "a", "b") for i in range(10)])
        stream = readers.read_packet_stream(spark, folder).withColumn("prediction", F.lit(-1))
        done = drain(
            spark, streams.statistics(stream), streams.to_folders(out), tmp_path, "totals", mode="complete"
        )
    row = spark.read.parquet(streams.batch_folder(out, streams.last_batch(done))).first()
    assert (row.total_packets, row.total_alerts, row.anomaly_rate) == (20, 20, 100.0)


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with streams.stream_settings(spark, state_partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_alert_union_keeps_rows(packets):
    a, b = packets([(1, 1, "a", "b")]), packets([(2, 2, "a", "b")]).drop("ttl")
    assert al.union_traffic(a, b).orderBy("packet_id").select("ttl").collect() == [(64,), (None,)]


def test_scratch_tables_go_with_their_scope(spark):
    from netspark.session import cut_lineage, scratch_scope

    kept = cut_lineage(spark.range(3).toDF("x"))
    with scratch_scope(spark):
        gone = cut_lineage(spark.range(3).toDF("x"))
        assert gone.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()
