"""Alerts: severity, building, filters, volume, summaries, evaluation."""

from pyspark.sql import functions as F

from netspark.functions import severity as sev
from netspark.operators import alerts as al
from netspark.operators import asof
from netspark.operators import volume
from netspark.plans.registry import query


def _alerts(inputs):
    """Alerts of all attack packets, from the detection table of the same scores."""
    return inputs.view("alerts")


@query("severity_from_score", oracle="SELECT alert_id, anomaly_score, severity FROM alerts")
def severity_from_score(inputs):
    return _alerts(inputs).select(
        "alert_id",
        "anomaly_score",
        sev.severity_from_score(F.col("anomaly_score")).alias("severity"),
    )


_RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"


@query(
    "severity_rank",
    oracle=f"""WITH a AS (SELECT alert_id, CASE WHEN alert_id % 9 = 0 THEN 'odd' ELSE severity END AS severity
                         FROM alerts)
      SELECT alert_id, severity, coalesce({_RANK}, 0) AS routing_rank, {_RANK} AS chart_rank FROM a""",
)
def severity_rank(inputs):
    odd = F.when(F.col("alert_id") % 9 == 0, "odd").otherwise(F.col("severity"))
    return (
        _alerts(inputs)
        .select("alert_id", odd.alias("severity"))
        .withColumns(
            {
                "routing_rank": sev.severity_rank(F.col("severity")),
                "chart_rank": sev.severity_rank(F.col("severity"), unknown=None),
            }
        )
    )


@query(
    "severity_siem_scale",
    oracle="""SELECT alert_id, CASE severity WHEN 'low' THEN 3 WHEN 'medium' THEN 5 WHEN 'high' THEN 8
                WHEN 'critical' THEN 10 ELSE 5 END AS level FROM alerts""",
)
def severity_siem_scale(inputs):
    return _alerts(inputs).select(
        "alert_id", sev.severity_ten_point(F.upper("severity")).alias("level")
    )


@query(
    "alert_type_title",
    oracle="""SELECT packet_id, CASE attack_type WHEN 'normal' THEN 'Anomalous Network Traffic'
      WHEN 'port_scan' THEN 'Port Scan Attack' WHEN 'ddos' THEN 'Ddos Attack'
      WHEN 'data_exfiltration' THEN 'Data Exfiltration Attack' WHEN 'brute_force' THEN 'Brute Force Attack'
      WHEN 'malware_c2' THEN 'Malware C2 Attack' ELSE 'Suspicious Dns Attack' END AS type FROM packets""",
)
def alert_type_title(inputs):
    return inputs.view("packets").select(
        "packet_id", sev.alert_type_title(F.col("attack_type")).alias("type")
    )


BUILT = """SELECT packet_id AS alert_id, timestamp,
  CASE attack_type WHEN 'normal' THEN 'Anomalous Network Traffic'
    WHEN 'port_scan' THEN 'Port Scan Attack' WHEN 'ddos' THEN 'Ddos Attack'
    WHEN 'data_exfiltration' THEN 'Data Exfiltration Attack' WHEN 'brute_force' THEN 'Brute Force Attack'
    WHEN 'malware_c2' THEN 'Malware C2 Attack' ELSE 'Suspicious Dns Attack' END AS type,
  CASE WHEN anomaly_score < -0.8e0 THEN 'critical' WHEN anomaly_score < -0.6e0 THEN 'high'
    WHEN anomaly_score < -0.4e0 THEN 'medium' ELSE 'low' END AS severity,
  d.src_ip, d.dst_ip, d.protocol, p.dst_port AS port, d.length AS packet_size, anomaly_score,
  concat('Unusual traffic pattern detected from ', coalesce(d.src_ip, 'unknown'), ' to ',
    coalesce(d.dst_ip, 'unknown'), ' using ', coalesce(d.protocol, 'unknown')) AS description
  FROM detections d JOIN (SELECT packet_id, dst_port FROM packets) p USING (packet_id) WHERE prediction = -1"""


@query("alert_build", oracle=BUILT, floats="anomaly_score")
def alert_build(inputs):
    ports = inputs.view("packets").select("packet_id", "dst_port")
    return al.build_alerts(inputs.view("detections").join(ports, "packet_id"))


@query(
    "alert_table_view",
    oracle="""SELECT alert_id, strftime(make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT)),
        '%Y-%m-%d %H:%M:%S') AS timestamp, severity, type, coalesce(src_ip, '') AS src_ip,
        coalesce(dst_ip, '') AS dst_ip, '' AS description, '' AS threat_intel_display FROM alerts""",
)
def alert_table_view(inputs):
    columns = ["alert_id", "timestamp", "severity", "type", "src_ip", "dst_ip"]
    return al.alert_table(_alerts(inputs).select(*columns)).orderBy(F.desc("timestamp"))


@query(
    "time_range_filter",
    oracle="SELECT * FROM alerts WHERE timestamp >= 1704067500 AND timestamp <= 1704068100",
)
def time_range_filter(inputs):
    return al.time_range(_alerts(inputs), start=1704067500, end=1704068100)


@query("anomaly_filter", oracle="SELECT * FROM detections WHERE prediction = -1")
def anomaly_filter(inputs):
    return al.anomalies(inputs.view("detections"))


@query(
    "channel_routing",
    oracle=f"""WITH a AS (SELECT alert_id, severity, {_RANK} AS r FROM alerts),
        c AS (SELECT channel, CASE threshold WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3
                ELSE 4 END AS t FROM channels WHERE enabled)
      SELECT alert_id, severity, channel FROM a JOIN c ON r >= t""",
)
def channel_routing(inputs):
    return al.route(_alerts(inputs).select("alert_id", "severity"))


@query(
    "nearest_bin_join",
    oracle="""WITH v AS (SELECT CAST(floor(timestamp / 5) * 5 AS DOUBLE) AS b, count(*) AS n
                       FROM packets GROUP BY ALL),
        g AS (SELECT CAST(x AS DOUBLE) AS bin_start FROM (SELECT unnest(generate_series(
                (SELECT CAST(min(b) AS BIGINT) FROM v), (SELECT CAST(max(b) AS BIGINT) FROM v), 5)) AS x)),
        f AS (SELECT bin_start, coalesce(n, 0) AS packet_count FROM g LEFT JOIN v ON b = bin_start),
        t AS (SELECT DISTINCT timestamp FROM alerts)
      SELECT timestamp, bin_start, packet_count FROM t JOIN f ON abs(timestamp - bin_start) <= 5
      QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY abs(timestamp - bin_start), bin_start) = 1""",
)
def nearest_bin_join(inputs):
    grid = volume.traffic_volume(inputs.view("packets"), seconds=5)
    return volume.nearest_bin(_alerts(inputs), grid, seconds=5)


@query(
    "nearest_in_time",
    oracle="""WITH a AS (SELECT packet_id, src_ip, timestamp FROM packets WHERE attack_type <> 'normal'),
        n AS (SELECT packet_id AS match_id, src_ip, timestamp AS match_time FROM packets
              WHERE attack_type = 'normal' AND timestamp IS NOT NULL),
        m AS (SELECT a.packet_id, match_id, match_time FROM a JOIN n ON a.src_ip = n.src_ip AND a.timestamp IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY a.packet_id
                ORDER BY abs(a.timestamp - match_time), match_time, match_id) = 1)
      SELECT a.*, match_id, match_time FROM a LEFT JOIN m USING (packet_id)""",
)
def nearest_in_time(inputs):
    """For each packet of an attack the normal packet of the same source that is nearest in time."""
    packets = inputs.view("packets").select("packet_id", "src_ip", "timestamp", "attack_type")
    attacks = packets.filter("attack_type <> 'normal'").drop("attack_type")
    normal = packets.filter("attack_type = 'normal'").drop("attack_type")
    return asof.nearest_in_time(attacks, normal, left_id="packet_id", right_id="packet_id", keys=["src_ip"])


def _volume_sql(step: int) -> str:
    return f"""SELECT CAST(g.x AS DOUBLE) AS bin_start, coalesce(n, 0) AS packet_count FROM
      (SELECT unnest(generate_series((SELECT CAST(floor(min(timestamp) / {step}) * {step} AS BIGINT) FROM packets),
         (SELECT CAST(floor(max(timestamp) / {step}) * {step} AS BIGINT) FROM packets), {step})) AS x) g
      LEFT JOIN (SELECT CAST(floor(timestamp / {step}) * {step} AS BIGINT) AS x, count(*) AS n
                 FROM packets GROUP BY ALL) c USING (x)"""


@query(
    "traffic_volume",
    oracle=" UNION ALL ".join(
        f"SELECT {s} AS level_seconds, * FROM ({_volume_sql(s)})" for s in (60, 300, 3600)
    ),
)
def traffic_volume(inputs):
    return volume.traffic_volume_levels(inputs.view("packets"))


@query("traffic_volume_5s", oracle=_volume_sql(5))
def traffic_volume_5s(inputs):
    return volume.traffic_volume(inputs.view("packets"), seconds=5)


@query(
    "traffic_volume_sparse",
    oracle=_volume_sql(5).replace("FROM packets", "FROM (SELECT * FROM alerts)"),
)
def traffic_volume_sparse(inputs):
    """The same on a table that leaves bins empty."""
    return volume.traffic_volume(_alerts(inputs), seconds=5)


@query(
    "layer_protocol_counts",
    oracle="""SELECT layer, value, count(*) AS packets FROM (
        SELECT 'ethernet' AS layer, coalesce(eth_type, 'unknown') AS value FROM packet_layers
        UNION ALL SELECT 'ip', ip_proto FROM packet_layers WHERE ip_proto IS NOT NULL
        UNION ALL SELECT 'transport', transport FROM packet_layers WHERE transport IS NOT NULL
        UNION ALL SELECT 'application', coalesce(highest_layer, 'unknown') FROM packet_layers) u
      GROUP BY layer, value""",
)
def layer_protocol_counts(inputs):
    return volume.layer_protocol_counts(inputs.view("packet_layers"))


@query(
    "protocol_counts",
    oracle="""SELECT protocol, count(*) AS packets, count(*) / sum(count(*)) OVER () AS share
              FROM packets GROUP BY protocol""",
    floats="share",
)
def protocol_counts(inputs):
    return volume.protocol_counts(inputs.view("packets"))


_SUMMARY = """SELECT 'total' AS section, 'alerts' AS key, CAST(count(*) AS DOUBLE) AS value FROM alerts
  UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY severity
  UNION ALL SELECT 'type', type, count(*) FROM alerts GROUP BY type
  UNION ALL SELECT * FROM (SELECT 'top_source', src_ip, count(*) AS n FROM alerts WHERE src_ip IS NOT NULL
     GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10)
  UNION ALL SELECT 'time_range', 'start', min(timestamp) FROM alerts
  UNION ALL SELECT 'time_range', 'end', max(timestamp) FROM alerts"""


@query("alert_summary", oracle=_SUMMARY)
def alert_summary(inputs):
    return al.alert_summary(_alerts(inputs))


@query(
    "capture_summary",
    oracle="""SELECT count(*) AS total, count(*) FILTER (WHERE prediction = -1) AS anomalies,
      coalesce(count(*) FILTER (WHERE prediction = -1) * 100.0e0 / nullif(count(*), 0), 0) AS anomaly_percent
      FROM detections""",
    floats="anomaly_percent",
)
def capture_summary(inputs):
    return al.capture_summary(inputs.view("detections"))


@query(
    "evaluation_metrics",
    oracle="""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n,
        count(*) FILTER (WHERE label > 0 AND prediction > 0) AS tp,
        count(*) FILTER (WHERE label <= 0 AND prediction > 0) AS fp,
        count(*) FILTER (WHERE label > 0 AND prediction <= 0) AS fn,
        count(*) FILTER (WHERE label <= 0 AND prediction <= 0) AS tn,
        avg(anomaly_score) AS mean_score, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score
        FROM detections)
      SELECT (tp + tn) / n AS accuracy, tp / CAST(tp + fp AS DOUBLE) AS precision,
        tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1_score,
        (fn + tn) / n AS anomaly_ratio, mean_score, min_score, max_score FROM c""",
    floats="accuracy precision recall f1_score anomaly_ratio mean_score min_score max_score",
)
def evaluation_metrics(inputs):
    return al.evaluation_metrics(inputs.view("detections"))


@query(
    "attack_distribution",
    oracle="SELECT attack_type, count(*) AS packets FROM packets GROUP BY attack_type",
)
def attack_distribution(inputs):
    return al.attack_distribution(inputs.view("packets"))


@query(
    "running_statistics",
    oracle="""WITH s AS (SELECT least((SELECT count(*) FROM packets), 10000) AS total_packets,
                least((SELECT count(*) FROM alerts), 1000) AS total_alerts)
      SELECT *, total_alerts * 100.0e0 / total_packets AS anomaly_rate FROM s""",
    floats="anomaly_rate",
)
def running_statistics(inputs):
    return al.running_statistics(inputs.view("packets"), _alerts(inputs))


@query(
    "running_statistics_all_time",
    oracle="""WITH s AS (SELECT (SELECT count(*) FROM packets) AS total_packets,
                (SELECT count(*) FROM alerts) AS total_alerts)
      SELECT *, total_alerts * 100.0e0 / total_packets AS anomaly_rate FROM s""",
    floats="anomaly_rate",
)
def running_statistics_all_time(inputs):
    return al.running_statistics(
        inputs.view("packets"), _alerts(inputs), keep_packets=None, keep_alerts=None
    )


@query(
    "score_histogram",
    oracle="""SELECT prediction, CASE WHEN anomaly_score < -1 THEN 0 WHEN anomaly_score >= 1 THEN 21
        ELSE CAST(floor((anomaly_score + 1) / 2 * 20) AS BIGINT) + 1 END AS bin, count(*) AS packets
      FROM detections GROUP BY ALL""",
)
def score_histogram(inputs):
    return al.score_histogram(inputs.view("detections"))


@query(
    "score_distribution",
    oracle="""WITH b AS (SELECT prediction, count(*) AS packets, quantile_cont(anomaly_score, 0.25) AS q1,
        quantile_cont(anomaly_score, 0.5) AS median, quantile_cont(anomaly_score, 0.75) AS q3
        FROM detections GROUP BY prediction)
      SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM b""",
    floats="q1 median q3 low_fence high_fence",
)
def score_distribution(inputs):
    return al.score_quartiles(inputs.view("detections"))


@query(
    "timeline_left_join",
    oracle="""SELECT p.packet_id, p.timestamp, d.prediction, d.anomaly_score FROM packets p
              LEFT JOIN (SELECT * FROM detections WHERE packet_id % 3 <> 0) d ON p.timestamp = d.timestamp""",
)
def timeline_left_join(inputs):
    results = inputs.view("detections").filter("packet_id % 3 <> 0")
    packets = inputs.view("packets").select("packet_id", "timestamp")
    return al.timeline(packets, results)


@query(
    "timeline_by_packet",
    oracle="""SELECT p.packet_id, p.timestamp, d.prediction, d.anomaly_score FROM packets p
              LEFT JOIN detections d ON p.packet_id = d.packet_id""",
)
def timeline_by_packet(inputs):
    packets = inputs.view("packets").select("packet_id", "timestamp")
    return al.timeline(packets, inputs.view("detections"), on="packet_id")


@query(
    "severity_timeline",
    oracle=f"SELECT alert_id, timestamp, anomaly_score, severity, {_RANK} AS numeric_severity FROM alerts",
)
def severity_timeline(inputs):
    return al.severity_bubbles(_alerts(inputs))


@query(
    "alert_detail",
    oracle="""WITH w AS (SELECT alert_id, timestamp AS alert_time, severity, type, src_ip, dst_ip
        FROM alerts ORDER BY anomaly_score, alert_id LIMIT 10)
      SELECT p.src_ip, p.dst_ip, packet_id, p.timestamp, length, protocol, alert_id, alert_time, severity, type
      FROM packets p JOIN w ON p.src_ip = w.src_ip AND p.dst_ip = w.dst_ip
        AND abs(p.timestamp - alert_time) <= 5""",
)
def alert_detail(inputs):
    return al.alert_detail(_alerts(inputs), inputs.view("packets"))


_UNTIMED = """SELECT alert_id, CASE WHEN alert_id % 7 = 0 THEN NULL ELSE timestamp END AS timestamp,
  CASE WHEN alert_id % 11 = 0 THEN NULL ELSE src_ip END AS src_ip, dst_ip FROM alerts"""


@query(
    "alert_traffic_around",
    oracle=f"""SELECT alert_id, count(p.packet_id) AS packets_around,
        CAST(coalesce(sum(p.length), 0) AS BIGINT) AS bytes_around
      FROM ({_UNTIMED}) a LEFT JOIN packets p ON a.src_ip = p.src_ip AND a.dst_ip = p.dst_ip
        AND p.timestamp BETWEEN a.timestamp - 5 AND a.timestamp + 5 GROUP BY alert_id""",
)
def alert_traffic_around(inputs):
    """Some alerts have no time, and some no address."""
    return al.traffic_around(inputs.sql(_UNTIMED), inputs.view("packets"))


@query(
    "retain_last_n",
    oracle="""SELECT alert_id, timestamp, type, severity FROM alerts
              ORDER BY timestamp DESC, alert_id DESC LIMIT 1000""",
)
def retain_last_n(inputs):
    return al.newest(_alerts(inputs).select("alert_id", "timestamp", "type", "severity"), 1000)


@query(
    "top_sources",
    oracle="""SELECT src_ip, count(*) AS alerts FROM alerts WHERE src_ip IS NOT NULL GROUP BY src_ip
              ORDER BY alerts DESC, src_ip LIMIT 10""",
)
def top_sources(inputs):
    return al.top_sources(_alerts(inputs))


@query(
    "top_anomalies",
    oracle="SELECT * FROM detections WHERE prediction = -1 ORDER BY anomaly_score, packet_id LIMIT 5",
)
def top_anomalies(inputs):
    return al.top_anomalies(inputs.view("detections"))


@query(
    "newest_alerts",
    oracle="SELECT * FROM alerts ORDER BY timestamp DESC, alert_id DESC LIMIT 10",
)
def newest_alerts(inputs):
    return al.newest(_alerts(inputs), 10)


@query(
    "union_traffic",
    oracle="""SELECT packet_id, src_ip, length, attack_type FROM packets WHERE attack_type <> 'normal'
              UNION ALL SELECT packet_id, src_ip, length, NULL FROM packets WHERE attack_type = 'normal'""",
)
def union_traffic(inputs):
    packets = inputs.view("packets")
    attacks = packets.filter("attack_type <> 'normal'").select(
        "packet_id", "src_ip", "length", "attack_type"
    )
    normal = packets.filter("attack_type = 'normal'").select("packet_id", "src_ip", "length")
    return al.union_traffic(attacks, normal)
