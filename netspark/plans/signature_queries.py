"""Attack signature detectors, and their agreement with the labels."""

from pyspark.sql import functions as F

from netspark.operators import alerts as al
from netspark.operators import signatures as sig
from netspark.plans.registry import query

_W = "CAST(floor(timestamp / {0}) * {0} AS DOUBLE) AS time_window"
_W60 = _W.format(60)
_INSIDE = "({0} LIKE '192.168.1.%' OR {0} LIKE '10.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
_OUTBOUND = f"{_INSIDE.format('src_ip')} AND NOT {_INSIDE.format('dst_ip')}"


def _packets(inputs):
    return inputs.view("signature_packets")


_SCAN = f"""SELECT src_ip, dst_ip, {_W60}, count(DISTINCT dst_port) AS ports, count(*) AS packets
  FROM signature_packets WHERE protocol = 'TCP' AND tcp_flags = 2 AND length BETWEEN 40 AND 100
    AND src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY ALL HAVING count(DISTINCT dst_port) >= 8"""


@query("detect_port_scan", oracle=_SCAN)
def detect_port_scan(inputs):
    return sig.port_scans(_packets(inputs))


@query(
    "detect_ddos",
    oracle=f"""SELECT dst_ip, dst_port, {_W60}, count(DISTINCT src_ip) AS sources, count(*) AS packets,
        CAST(sum(length) AS BIGINT) AS bytes, count(*) / 60.0e0 AS packet_rate
      FROM signature_packets WHERE dst_port IN (80, 443, 8080, 22, 53) AND length >= 500
        AND src_ip IS NOT NULL AND dst_ip IS NOT NULL
      GROUP BY ALL HAVING count(DISTINCT src_ip) >= 5""",
    floats="packet_rate",
)
def detect_ddos(inputs):
    return sig.floods(_packets(inputs))


@query(
    "detect_exfiltration",
    oracle=f"""SELECT src_ip, dst_ip, {_W.format(3600)}, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes
      FROM signature_packets WHERE dst_port IN (6667, 4444, 8443, 8080, 9001) AND length >= 1200
        AND {_OUTBOUND} GROUP BY ALL HAVING sum(length) >= 100000""",
)
def detect_exfiltration(inputs):
    return sig.exfiltration(_packets(inputs))


@query(
    "detect_brute_force",
    oracle=f"""SELECT src_ip, dst_ip, dst_port, {_W60}, count(*) AS hits FROM signature_packets
      WHERE dst_port IN (22, 3389, 5900, 23, 445) AND src_ip IS NOT NULL AND dst_ip IS NOT NULL
      GROUP BY ALL HAVING count(*) >= 8""",
)
def detect_brute_force(inputs):
    return sig.brute_force(_packets(inputs))


@query(
    "detect_login_attempts",
    oracle=f"""WITH l AS (SELECT src_ip, dst_ip, dst_port, {_W60}, tcp_flags,
        lead(tcp_flags, 1) OVER w AS f2, lead(tcp_flags, 2) OVER w AS f3 FROM (
          SELECT packet_id, timestamp, src_ip, dst_ip, dst_port, 40000 AS src_port,
            CASE packet_id // 6 % 3 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 17 END AS tcp_flags,
            CAST(floor(timestamp / 60) * 60 AS DOUBLE) AS tw FROM signature_packets) s
        WHERE dst_port IN (22, 3389, 5900, 23, 445)
        WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, src_port, tw ORDER BY timestamp, packet_id))
      SELECT src_ip, dst_ip, dst_port, time_window, count(*) AS attempts FROM l
      WHERE tcp_flags = 2 AND f2 = 16 AND f3 % 2 = 1 GROUP BY ALL""",
)
def detect_login_attempts(inputs):
    turn = F.floor(F.col("packet_id") / 6) % 3
    flags = F.when(turn == 0, 2).when(turn == 1, 16).otherwise(17)
    shaped = _packets(inputs).withColumns({"src_port": F.lit(40000), "tcp_flags": flags})
    return sig.login_attempts(shaped)


@query(
    "detect_beaconing",
    oracle=f"""WITH g AS (SELECT src_ip, dst_ip, timestamp - lag(timestamp) OVER (PARTITION BY src_ip, dst_ip
          ORDER BY timestamp, packet_id) AS gap FROM signature_packets
          WHERE length BETWEEN 60 AND 200 AND {_OUTBOUND}),
        s AS (SELECT src_ip, dst_ip, count(gap) AS gaps,
          count(*) FILTER (WHERE gap BETWEEN 30 AND 300) AS gaps_in_band, avg(gap) AS gap_mean,
          stddev_samp(gap) AS gap_std FROM g WHERE gap IS NOT NULL GROUP BY ALL)
      SELECT *, gaps_in_band / CAST(gaps AS DOUBLE) AS share_in_band, gap_std / nullif(gap_mean, 0) AS gap_cv
      FROM s WHERE gaps >= 3 AND gaps_in_band / CAST(gaps AS DOUBLE) >= 0.5""",
    floats="gap_mean gap_std share_in_band gap_cv",
)
def detect_beaconing(inputs):
    return sig.beaconing(_packets(inputs))


@query(
    "detect_dns_tunnel",
    oracle="""WITH s AS (SELECT src_ip, count(*) AS dns_packets,
        count(*) FILTER (WHERE length >= 300) AS large_packets FROM signature_packets
        WHERE protocol = 'DNS' AND dst_port = 53 AND src_ip IS NOT NULL GROUP BY src_ip)
      SELECT *, large_packets / CAST(dns_packets AS DOUBLE) AS large_share FROM s
      WHERE dns_packets >= 3 AND large_packets / CAST(dns_packets AS DOUBLE) >= 0.3""",
    floats="large_share",
)
def detect_dns_tunnel(inputs):
    return sig.dns_tunnels(_packets(inputs))


@query(
    "detect_sequential_scan",
    oracle=f"""WITH p AS (SELECT DISTINCT src_ip, dst_ip, {_W60}, dst_port FROM signature_packets
          WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND dst_port IS NOT NULL),
        i AS (SELECT *, dst_port - row_number() OVER (PARTITION BY src_ip, dst_ip, time_window
          ORDER BY dst_port) AS island FROM p)
      SELECT src_ip, dst_ip, time_window, min(dst_port) AS first_port, max(dst_port) AS last_port,
        count(*) AS run_length FROM i GROUP BY src_ip, dst_ip, time_window, island HAVING count(*) >= 3""",
)
def detect_sequential_scan(inputs):
    return sig.sequential_scans(_packets(inputs))


@query(
    "signature_quality",
    oracle=f"""WITH s AS ({_SCAN}), d AS (
        SELECT CASE WHEN p.attack_type = 'port_scan' THEN -1 ELSE 1 END AS label,
          CASE WHEN s.src_ip IS NULL THEN 1 ELSE -1 END AS prediction
        FROM signature_packets p LEFT JOIN s ON p.src_ip = s.src_ip AND p.dst_ip = s.dst_ip
          AND CAST(floor(p.timestamp / 60) * 60 AS DOUBLE) = s.time_window),
      c AS (SELECT CAST(count(*) AS DOUBLE) AS n,
        CAST(count(*) FILTER (WHERE label > 0 AND prediction > 0) AS DOUBLE) AS tp,
        count(*) FILTER (WHERE label <= 0 AND prediction > 0) AS fp,
        count(*) FILTER (WHERE label > 0 AND prediction <= 0) AS fn,
        count(*) FILTER (WHERE label <= 0 AND prediction <= 0) AS tn FROM d)
      SELECT (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
        2 * tp / (2 * tp + fp + fn) AS f1_score, (fn + tn) / n AS anomaly_ratio FROM c""",
    floats="accuracy precision recall f1_score anomaly_ratio",
)
def signature_quality(inputs):
    """Packets inside a detected scan against the port_scan label."""
    packets = sig._windowed(_packets(inputs), 60)
    keys = ["src_ip", "dst_ip", "time_window"]
    found = sig.port_scans(_packets(inputs)).select(*keys, F.lit(-1).alias("hit"))
    scored = packets.join(found, keys, "left").select(
        F.when(F.col("attack_type") == "port_scan", -1).otherwise(1).alias("label"),
        F.coalesce("hit", F.lit(1)).alias("prediction"),
        F.lit(0.0).alias("anomaly_score"),
    )
    return al.evaluation_metrics(scored).drop("mean_score", "min_score", "max_score")
