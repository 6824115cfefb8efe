"""The network tables as views over the driver's parquet tables.

Each definition is plain SQL that Spark and the oracle engine both run unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from netspark.session import configure

VIEWS: dict[str, str] = {
    "packets": """
SELECT event_id AS packet_id,
  1704067200.0e0 + event_id * 0.25e0 AS timestamp,
  CAST(CASE WHEN event_id % 89 = 0 THEN 9999
       ELSE 40 + CAST(floor(value * 100 + 0.5e0) AS BIGINT) % 1560 END AS INT) AS length,
  CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'HTTP' WHEN 'error' THEN 'UDP'
       WHEN 'signup' THEN 'DNS' ELSE 'ICMP' END AS protocol,
  CASE WHEN event_id % 4 = 3 THEN concat('10.0.0.', CAST(event_id % 5 + 1 AS VARCHAR(10)))
       ELSE concat('192.168.1.', CAST(user_id % 12 + 1 AS VARCHAR(10))) END AS src_ip,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN event_id % 10 = 0 THEN concat('192.168.1.', CAST(user_id % 7 + 20 AS VARCHAR(10)))
       WHEN event_id % 4 = 3 THEN concat('192.168.1.', CAST(user_id % 12 + 1 AS VARCHAR(10)))
       ELSE concat('10.0.0.', CAST(event_id % 5 + 1 AS VARCHAR(10))) END AS dst_ip,
  CAST(1024 + (event_id * 7919) % 64512 AS INT) AS src_port,
  CAST(CASE event_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 31337
       ELSE 1024 + (user_id * 37) % 4000 END AS INT) AS dst_port,
  CAST(CASE event_id % 3 WHEN 0 THEN 32 WHEN 1 THEN 64 ELSE 128 END AS INT) AS ttl,
  CAST(CASE WHEN event_type IN ('click', 'view')
       THEN CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 18 END END AS INT) AS tcp_flags,
  CASE WHEN event_type <> 'error' THEN 'normal'
       ELSE CASE event_id % 6 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'ddos' WHEN 2 THEN 'data_exfiltration'
            WHEN 3 THEN 'brute_force' WHEN 4 THEN 'malware_c2' ELSE 'suspicious_dns' END END AS attack_type
FROM events
""",
    "flows": """
SELECT flow, time_window,
  count(length) AS length_count, avg(length) AS length_mean, stddev_samp(length) AS length_std,
  min(length) AS length_min, max(length) AS length_max, CAST(sum(length) AS BIGINT) AS length_sum,
  count(DISTINCT protocol) AS protocol_nunique, count(DISTINCT src_port) AS src_port_nunique,
  count(DISTINCT dst_port) AS dst_port_nunique,
  count(length) / 60.0e0 AS packet_rate, CAST(sum(length) AS DOUBLE) / 60.0e0 AS byte_rate
FROM (SELECT *, concat_flow AS flow FROM (
        SELECT *, CASE WHEN src_ip IS NOT NULL AND dst_ip IS NOT NULL
                       THEN concat(src_ip, '->', dst_ip) END AS concat_flow,
               CAST(floor(timestamp / 60) * 60 AS DOUBLE) AS time_window FROM packets) q) f
WHERE flow IS NOT NULL GROUP BY flow, time_window
""",
    "detections": """
SELECT packet_id, timestamp, src_ip, dst_ip, protocol, length, attack_type, anomaly_score,
  CASE WHEN anomaly_score < -0.3e0 THEN -1 ELSE 1 END AS prediction,
  CASE WHEN attack_type = 'normal' THEN 1 ELSE -1 END AS label
FROM (SELECT *, CASE WHEN attack_type = 'normal' AND packet_id % 20 <> 0 THEN 0.5e0
        ELSE CAST(-(packet_id % 101) AS DOUBLE) / 100.0e0 END AS anomaly_score FROM packets) d
""",
    "alerts": """
SELECT packet_id AS alert_id, timestamp,
  CASE attack_type WHEN 'port_scan' THEN 'Port Scan Attack' WHEN 'ddos' THEN 'Ddos Attack'
    WHEN 'data_exfiltration' THEN 'Data Exfiltration Attack' WHEN 'brute_force' THEN 'Brute Force Attack'
    WHEN 'malware_c2' THEN 'Malware C2 Attack' ELSE 'Suspicious Dns Attack' END AS type,
  CASE WHEN anomaly_score < -0.8e0 THEN 'critical' WHEN anomaly_score < -0.6e0 THEN 'high'
    WHEN anomaly_score < -0.4e0 THEN 'medium' ELSE 'low' END AS severity,
  src_ip, dst_ip, protocol, dst_port AS port, length AS packet_size, anomaly_score
FROM (SELECT *, CAST(-(packet_id % 101) AS DOUBLE) / 100.0e0 AS anomaly_score
      FROM packets WHERE attack_type <> 'normal') a
""",
    "threat_db": """
SELECT item_id, concat('10.0.0.', CAST(item_id % 8 + 1 AS VARCHAR(10))) AS indicator, 'ip' AS type,
  CAST(50 + (item_id * 10) % 50 AS DOUBLE) / 100.0e0 AS confidence,
  CASE item_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  text AS description,
  concat('tag', CAST(item_id % 3 AS VARCHAR(10)), ',grp', CAST(item_id % 5 AS VARCHAR(10))) AS tags,
  1704067200.0e0 - item_id * 3600.0e0 AS last_seen, 'fixture' AS source
FROM benchmark
""",
    "blocklist": """
SELECT DISTINCT src_ip AS ip FROM packets WHERE src_ip LIKE '%.1' OR src_ip LIKE '%.3'
""",
    "reputation_feeds": """
SELECT ip, provider, collected_at, CASE provider
  WHEN 'fraud' THEN concat('{"fraud_score": ', CAST(o * 37 % 101 AS VARCHAR(10)), ', "proxy": ',
     CASE WHEN o % 2 = 0 THEN 'true' ELSE 'false' END, ', "tor": ',
     CASE WHEN o % 3 = 0 THEN 'true' ELSE 'false' END, ', "vpn": ',
     CASE WHEN o % 5 = 0 THEN 'true' ELSE 'false' END, ', "bot_status": ',
     CASE WHEN o % 7 = 0 THEN 'true' ELSE 'false' END, ', "is_crawler": ',
     CASE WHEN o % 4 = 1 THEN 'true' ELSE 'false' END, ', "recent_abuse": ',
     CASE WHEN o % 6 = 1 THEN 'true' ELSE 'false' END, ', "country_code": "C', CAST(o % 3 AS VARCHAR(10)), '"}')
  WHEN 'votes' THEN concat('{"data": {"attributes": {"last_analysis_stats": {"malicious": ',
     CAST(o * 5 % 40 AS VARCHAR(10)), ', "suspicious": ', CAST(o % 7 AS VARCHAR(10)),
     ', "harmless": 20}, "categories": {"a": "',
     CASE o % 3 WHEN 0 THEN 'Malware Site' WHEN 1 THEN 'Spam' ELSE 'Known Bad Host' END,
     '", "b": "Phishing"}, "last_analysis_date": ', CAST(1700000000 + o AS VARCHAR(10)), ', "country": "C',
     CAST(o % 4 AS VARCHAR(10)), '"}}}')
  ELSE concat('{"data": {"abuseConfidenceScore": ', CAST(o * 13 % 101 AS VARCHAR(10)),
     ', "countryCode": "C', CAST(o % 5 AS VARCHAR(10)), '", "isp": "isp', CAST(o % 2 AS VARCHAR(10)),
     '", "reports": [{"categories": [14, 99]}, {"categories": [', CAST(o % 23 + 1 AS VARCHAR(10)), ']}]}}')
  END AS body
FROM (SELECT ip, o, provider, 1704067200.0e0 - o * 9000.0e0 AS collected_at
      FROM (SELECT ip, CAST(split_part(ip, '.', 4) AS INT) AS o
            FROM (SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets) u WHERE ip IS NOT NULL) i
      CROSS JOIN (SELECT 'fraud' AS provider UNION ALL SELECT 'votes' UNION ALL SELECT 'abuse') p) r
""",
    "channels": """
SELECT 'email' AS channel, TRUE AS enabled, 'high' AS threshold
UNION ALL SELECT 'chat', TRUE, 'medium' UNION ALL SELECT 'card', FALSE, 'high'
""",
    "edges": """
SELECT src_ip AS src, dst_ip AS dst, count(*) AS weight FROM packets
WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip
""",
    "packet_layers": """
SELECT packet_id, CASE WHEN dst_ip IS NULL THEN '0x0806' ELSE '0x0800' END AS eth_type,
  CASE WHEN dst_ip IS NULL THEN NULL WHEN protocol IN ('TCP', 'HTTP') THEN '6'
       WHEN protocol IN ('UDP', 'DNS') THEN '17' ELSE '1' END AS ip_proto,
  CASE WHEN protocol IN ('TCP', 'HTTP') THEN 'TCP' WHEN protocol IN ('UDP', 'DNS') THEN 'UDP' END AS transport,
  protocol AS highest_layer
FROM packets
""",
    "signature_packets": """
SELECT packet_id, attack_type,
  CASE WHEN attack_type = 'malware_c2' THEN 1704067200.0e0 + packet_id * 2.0e0 ELSE timestamp END AS timestamp,
  CASE WHEN attack_type IN ('data_exfiltration', 'malware_c2', 'suspicious_dns')
         THEN concat('192.168.1.', CAST(packet_id % 2 + 50 AS VARCHAR(10)))
       WHEN attack_type IN ('port_scan', 'brute_force') THEN '203.0.113.5'
       WHEN attack_type = 'ddos' THEN concat('198.51.100.', CAST(packet_id % 200 + 1 AS VARCHAR(10)))
       ELSE src_ip END AS src_ip,
  CASE WHEN attack_type IN ('port_scan', 'brute_force', 'ddos') THEN '10.0.0.9'
       WHEN attack_type IN ('data_exfiltration', 'malware_c2') THEN '203.0.113.7'
       WHEN attack_type = 'suspicious_dns' THEN '8.8.8.8' ELSE dst_ip END AS dst_ip,
  src_port,
  CAST(CASE attack_type WHEN 'port_scan' THEN 20 + CAST(floor(packet_id / 6.0e0) AS BIGINT) % 900
       WHEN 'ddos' THEN 443 WHEN 'data_exfiltration' THEN 4444 WHEN 'brute_force' THEN 22
       WHEN 'malware_c2' THEN 31337 WHEN 'suspicious_dns' THEN 53 ELSE dst_port END AS INT) AS dst_port,
  CASE attack_type WHEN 'normal' THEN protocol WHEN 'brute_force' THEN 'SSH' WHEN 'suspicious_dns' THEN 'DNS'
       ELSE 'TCP' END AS protocol,
  CAST(CASE attack_type WHEN 'port_scan' THEN 40 + packet_id % 60 WHEN 'ddos' THEN 1000 + packet_id % 500
       WHEN 'data_exfiltration' THEN 1200 + packet_id % 300 WHEN 'brute_force' THEN 100 + packet_id % 400
       WHEN 'malware_c2' THEN 60 + packet_id % 140 WHEN 'suspicious_dns' THEN 300 + packet_id % 200
       ELSE length END AS INT) AS length,
  CAST(CASE attack_type WHEN 'normal' THEN tcp_flags WHEN 'port_scan' THEN 2 WHEN 'ddos' THEN 2
       WHEN 'suspicious_dns' THEN NULL ELSE 16 END AS INT) AS tcp_flags
FROM packets
""",
}


#: Clock of the calendar operators, per engine: the events' own time stamps.
CALENDAR_SPARK = """
SELECT event_id AS packet_id, CAST(ts AS STRING) AS text_time,
  unix_micros(CAST(ts AS TIMESTAMP)) / 1000000.0e0 AS timestamp FROM events
"""
CALENDAR_ORACLE = """
SELECT event_id AS packet_id, epoch_us(ts) / 1000000.0e0 AS timestamp FROM events
"""

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) is not None


def _needed(sql: str) -> list[str]:
    """Views a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in order and _mentions(text, name):
                visit(body)
                order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Prefix a statement with the views that it reads."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _needed(sql))
    if not views:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if head is None:
        return f"WITH {views} {sql}"
    recursive = "RECURSIVE " if head.group(1) else ""
    return f"WITH {recursive}{views}, {sql[head.end():]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables as a DataFrame."""
    return run(spark, sf_dir, f"SELECT * FROM {name}")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL in Spark over the parquet files of ``sf_dir``."""
    configure(spark)
    text = with_views(sql)
    for name in TABLES:
        if _mentions(text, name) and name not in VIEWS:
            path = f"{sf_dir.rstrip('/')}/{name}.parquet"
            text = re.sub(
                rf"\b(FROM|JOIN)\s+{name}\b", rf"\g<1> parquet.`{path}` AS {name}", text
            )
    return spark.sql(text)
