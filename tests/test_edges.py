"""Edge cases: nulls, boundaries, ties, empty input, skew."""

import json

import pytest
from pyspark.sql import functions as F

from netspark import schemas
from netspark.functions import calendar, network, payloads
from netspark.functions import severity as sev
from netspark.ml.features import dummy_columns, numeric_features
from netspark.operators import alerts as al
from netspark.operators import flows, intel, similarity, volume
from netspark.operators import signatures as sig
from netspark.sources import readers, sinks


def column(spark, value, expression, kind="double"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "score, severity",
    [(-0.81, "critical"), (-0.8, "high"), (-0.6, "medium"), (-0.4, "low"), (0.5, "low"), (-0.4001, "medium")],
)
def test_severity_bounds_are_strict(spark, score, severity):
    assert column(spark, score, sev.severity_from_score) == severity


@pytest.mark.parametrize(
    "length, name", [(63, "tiny"), (64, "small"), (256, "medium"), (1024, "large"), (1499, "large"), (1500, "jumbo")]
)
def test_size_classes(spark, length, name):
    df = spark.createDataFrame([(length,)], "v int")
    row = df.select(*[c.alias(n) for n, c in network.size_classes(F.col("v")).items()]).first()
    assert [n for n, flag in row.asDict().items() if flag] == [f"packet_size_{name}"]


@pytest.mark.parametrize(
    "ip, number",
    [("0.0.0.1", 1), ("10.0.0.0", 167772160), ("256.1.1.1", None), ("1.2.3", None), ("1.2.3.4.5", None),
     ("a.b.c.d", None), ("", None), (None, None), ("255.255.255.255", 2**32 - 1)],
)
def test_ipv4(spark, ip, number):
    assert column(spark, ip, network.ipv4_to_long, "string") == number


def test_direction_of_unknown_is_null(spark):
    df = spark.createDataFrame([("10.0.0.1", None), ("172.32.0.1", "172.31.255.255")], "a string, b string")
    assert [r.d for r in df.select(network.direction(F.col("a"), F.col("b")).alias("d")).collect()] == [
        None,
        "inbound",
    ]


def test_confidence_is_cut_not_rounded(spark):
    assert column(spark, 0.999, lambda c: sev.risk_display(c, F.lit("a,b"))) == "**Risk: 99%** - a, b"


def test_text_time(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01",), ("nonsense",)], "t string")
    assert [r.m for r in df.select(F.unix_micros(calendar.text_to_timestamp(F.col("t"))).alias("m")).collect()] == [
        1704067201000000,
        None,
    ]


def test_flow_with_one_packet(packets):
    row = flows.flow_features(packets([(1, 61, "a", "b"), (2, 62, "a", None)])).collect()
    assert [(r.flow, r.time_window, r.length_count, r.length_std) for r in row] == [("a->b", 60.0, 1, None)]


def test_flow_behavior_of_equal_flows(packets):
    rows = [(i, i * 60, "a", "b") for i in range(5)]
    found = flows.flow_behavior(flows.flow_features(packets(rows))).collect()
    assert all(not r.high_packet_count and r.low_packet_count and not r.high_byte_rate for r in found)


def test_empty_packets(spark):
    empty = spark.createDataFrame([], schemas.PACKETS)
    assert flows.flow_behavior(flows.flow_features(empty)).count() == 0
    assert volume.traffic_volume(empty).count() == 0
    assert volume.traffic_volume_levels(empty).count() == 0
    summary = {(r.section, r.key): r.value for r in al.alert_summary(
        empty.withColumns({"severity": F.lit("low"), "type": F.lit("x")})).collect()}
    assert summary[("total", "alerts")] == 0 and summary[("time_range", "start")] is None
    scored = empty.withColumns({"prediction": F.lit(1), "label": F.lit(1), "anomaly_score": F.lit(0.0)})
    assert al.capture_summary(scored).first().anomaly_percent == 0
    assert al.evaluation_metrics(scored).first().f1_score == 0


def test_duplicate_times_order_by_id(packets):
    rows = [(3, 5, "a", "b"), (1, 5, "a", "b"), (2, 5, "a", "b"), (4, 7, "a", "b")]
    found = {r.packet_id: r.inter_arrival_time for r in flows.inter_arrival(packets(rows)).collect()}
    assert found == {1: None, 2: 0.0, 3: 0.0, 4: 2.0}


def test_one_port_has_no_entropy(packets):
    rows = [(i, i, "a", "b") for i in range(4)]
    assert flows.port_entropy_by_flow(packets(rows)).first().port_entropy == 0.0


def test_volume_fills_gaps(packets):
    counts = volume.traffic_volume(packets([(1, 3, "a", "b"), (2, 21, "a", "b")]), seconds=5)
    assert [tuple(r) for r in counts.orderBy("bin_start").collect()] == [
        (0.0, 1), (5.0, 0), (10.0, 0), (15.0, 0), (20.0, 1)]


def test_nearest_bin_takes_the_earlier_on_a_tie(spark):
    grid = spark.createDataFrame([(0.0, 1), (5.0, 2), (10.0, 3)], "bin_start double, packet_count bigint")
    times = spark.createDataFrame([(2.5,), (2.6,), (99.0,), (-3.0,)], "timestamp double")
    found = {r.timestamp: r.bin_start for r in volume.nearest_bin(times, grid, seconds=5).collect()}
    assert found == {2.5: 0.0, 2.6: 5.0, 99.0: 10.0, -3.0: 0.0}


def test_layer_without_value_is_unknown(spark):
    df = spark.createDataFrame(
        [(None, None, None, None)], "eth_type string, ip_proto string, transport string, highest_layer string"
    )
    assert {(r.layer, r.value) for r in volume.layer_protocol_counts(df).collect()} == {
        ("ethernet", "unknown"), ("application", "unknown")}


def test_channels(spark):
    alerts = spark.createDataFrame(
        [(1, "CRITICAL"), (2, "medium"), (3, None), (4, "odd")], "alert_id bigint, severity string"
    )
    channels = [("email", True, "high"), ("chat", True, "low"), ("card", False, "low"), ("log", True, "odd")]
    routed = {(r.alert_id, r.channel) for r in al.route(alerts, channels).collect()}
    assert routed == {(1, "email"), (1, "chat"), (1, "log"), (2, "chat"), (2, "log"), (3, "chat"), (3, "log"), (4, "log")}
    assert al.route(alerts, []).count() == 0


def test_source_wins_equal_confidence(spark):
    threats = spark.createDataFrame(
        [(1, "s", "ip", 0.5, "low", "first", "x,y"), (2, "s", "ip", 0.5, "high", "second", "z"),
         (3, "d", "ip", 0.5, "high", "third", "z"), (4, "e", "ip", 0.9, None, None, None),
         (5, "d", "domain", 1.0, "low", "other type", "")],
        "item_id int, indicator string, type string, confidence double, severity string, description string, tags string",
    )
    alerts = spark.createDataFrame(
        [(1, "s", "d"), (2, "s", "e"), (3, None, "d"), (4, "q", None)], "alert_id int, src_ip string, dst_ip string"
    )
    found = {r.alert_id: r for r in intel.enrich_alerts(alerts, threats).collect()}
    assert found[1].threat_description == "first"
    assert (found[2].threat_confidence, found[2].threat_severity, found[2].threat_tags) == (0.9, "unknown", "")
    assert found[3].threat_description == "third"
    assert found[4].threat_intel_display is None and len(found) == 4


def test_rollup_takes_the_latest_document(spark):
    rows = [("1.1.1.1", "fraud", 1.0, '{"fraud_score": 90, "vpn": true}'),
            ("1.1.1.1", "fraud", 2.0, '{"fraud_score": 10, "country_code": "X"}'),
            ("1.1.1.1", "odd", 3.0, "{}"), ("2.2.2.2", "votes", 1.0, '{"data": {"attributes": {}}}')]
    feeds = spark.createDataFrame(rows, schemas.REPUTATION_FEED)
    listed = spark.createDataFrame([("3.3.3.3",)], "ip string")
    found = {r.ip: r for r in intel.reputation_rollup(feeds, listed).collect()}
    assert (found["1.1.1.1"].risk_score, found["1.1.1.1"].is_malicious) == (10.0, False)
    assert found["1.1.1.1"].location.country == "X" and found["1.1.1.1"].categories == []
    assert (found["2.2.2.2"].risk_score, found["3.3.3.3"].risk_score) == (0.0, 100.0)
    assert found["3.3.3.3"].categories == ["local_blocklist"]


def test_vocabulary_is_limited(spark):
    corpus = spark.createDataFrame([(1, "aa aa bb cc"), (2, "bb dd the")], "id bigint, text string")
    model = similarity.fit_terms(corpus, id_column="id", text_column="text", max_terms=2)
    assert model.terms == ["aa", "bb"]
    assert model.idf == pytest.approx([1.4054651, 1.0])


def test_traffic_around_counts_both_ends(packets, spark):
    table = packets([(i, i, "a", "b", {"length": 10}) for i in range(20)] + [(99, 5, "a", "c")])
    alerts = spark.createDataFrame(
        [(1, 5.0, "a", "b"), (2, 5.0, "a", "b"), (3, 0.0, "a", "b"), (4, 5.0, None, "b"), (5, None, "a", "b")],
        "alert_id bigint, timestamp double, src_ip string, dst_ip string",
    )
    for options in ({}, {"max_bucket_rows": 6}):
        found = al.traffic_around(alerts, table, around_seconds=2, **options).collect()
        assert {r.alert_id: (r.packets_around, r.bytes_around) for r in found} == {
            1: (5, 50), 2: (5, 50), 3: (3, 30), 4: (0, 0), 5: (0, 0)}


def test_long_port_run_and_logins(packets):
    rows = [(i, i, "a", "b", {"dst_port": 1000 + i}) for i in range(30)]
    rows += [(100 + i, 200 + i, "a", "b", {"dst_port": 22, "tcp_flags": f}) for i, f in enumerate([2, 16, 17, 2, 16, 1, 16])]
    table = packets(rows)
    run = sig.sequential_scans(table, min_run=5).first()
    assert (run.first_port, run.last_port, run.run_length) == (1000, 1029, 30)
    assert sig.login_attempts(table).first().attempts == 2


def test_numeric_fallback(spark):
    df = spark.createDataFrame([(1, 50), (2, 200), (3, None)], "packet_id bigint, length int")
    found = [tuple(r) for r in numeric_features(df).orderBy("packet_id").collect()]
    assert found == [(1, 50, 0.25), (2, 200, 1.0), (3, 0, 0.0)]


def test_dummies(spark):
    df = spark.createDataFrame([("TCP",), (None,), ("x",)], "p string")
    rows = df.select(*[c.alias(n) for n, c in dummy_columns("p", ["TCP", "UDP"]).items()]).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_readers(spark, tmp_path):
    text = tmp_path / "list.txt"
    text.write_text("# comment\n\n 1.2.3.4 \n1.2.3.4\n#x\n5.6.7.8\n")
    assert {r.ip for r in readers.read_blocklist(spark, str(text)).collect()} == {"1.2.3.4", "5.6.7.8"}
    assert readers.read_threat_db(spark, None).columns == schemas.THREAT_DB.names
    assert readers.read_threat_db(spark, str(tmp_path / "none")).count() == 0
    for day in ("20240101", "20240103", "20240102"):
        (tmp_path / f"{day}_packets.csv").write_text("packet_id,timestamp\n1,2.0\n")
    assert readers.latest_file(spark, str(tmp_path / "*.csv")).endswith("20240103_packets.csv")
    with pytest.raises(FileNotFoundError):
        readers.latest_run(spark, str(tmp_path / "*.csv"))


def test_labels_default_to_the_first_column(spark, tmp_path):
    spark.createDataFrame([(1, [0.5])], "id int, features array<double>").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(1, 7, 8)], "id int, quality int, other int").write.parquet(str(tmp_path / "y"))
    row = readers.read_features_labels(spark, str(tmp_path / "x"), str(tmp_path / "y")).first()
    assert row.label == 7
    assert readers.read_features_labels(spark, str(tmp_path / "x")).columns == ["id", "features"]


def test_empty_run_is_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_run(empty, str(tmp_path), "1") is None and not list(tmp_path.iterdir())


def test_documents_have_their_nested_fields(spark):
    alert = spark.createDataFrame(
        [(1.0, None, None, None, None, None)],
        "timestamp double, severity string, type string, src_ip string, dst_ip string, protocol string",
    )
    fields = {n: F.col(n) for n in alert.columns}
    details = F.struct("timestamp", "src_ip")
    document = json.loads(
        alert.select(F.to_json(payloads.common_schema_event(fields, details, now=5.0)).alias("j")).first().j
    )
    assert document["log"]["level"] == "medium" and document["event"]["severity"] == "3"
    assert document["network"]["source"]["ip"] == "unknown" and document["@timestamp"] == 1.0
    assert document["threat"]["indicator"] == {"timestamp": 1.0}


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_hot_source(spark, packets, partitions):
    """One source with most packets gives the same answer for any partition count."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, i / 8, "hot" if i % 3 else f"s{i % 5}", "d", {"dst_port": i % 40}) for i in range(900)]
        table = packets(rows)
        scan = {r.src_ip: (r.unique_dst_ports, r.packet_count) for r in flows.port_scan_behavior(table).collect()}
        assert scan["hot"][1] == 600 and sum(n for _, n in scan.values()) == 900
        gaps = {r.src_ip: r.mean_inter_arrival for r in flows.inter_arrival_stats(table).collect()}
        times = [t for _, t, s, *_ in rows if s == "hot"]
        assert gaps["hot"] == pytest.approx((times[-1] - times[0]) / (len(times) - 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
