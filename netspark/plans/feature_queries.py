"""Projections, flow, port, timing and behaviour features."""

from pyspark.sql import functions as F

from netspark.functions import calendar, network
from netspark.functions import severity as sev
from netspark.operators import flows, graph
from netspark.plans import fixtures
from netspark.plans.registry import query

_CAL = f"WITH c AS ({fixtures.CALENDAR_ORACLE})"
_DUCK_TS = "make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT))"

#: Packets with flow keys, for the oracle.
_KEYED = """keyed AS (
SELECT *, CASE WHEN src_ip IS NOT NULL AND dst_ip IS NOT NULL
            THEN concat(src_ip, '->', dst_ip) END AS flow,
  CAST(floor(timestamp / 60) * 60 AS DOUBLE) AS time_window FROM packets)"""


def _calendar(inputs):
    return inputs.sql(fixtures.CALENDAR_SPARK)


@query(
    "epoch_to_timestamp",
    oracle="""SELECT event_id AS packet_id, epoch_us(ts) AS micros, epoch_us(ts) AS micros_from_text
              FROM events""",
)
def epoch_to_timestamp(inputs):
    df = _calendar(inputs)
    return df.select(
        "packet_id",
        F.unix_micros(calendar.epoch_to_timestamp(F.col("timestamp"))).alias("micros"),
        F.unix_micros(calendar.text_to_timestamp(F.col("text_time"))).alias("micros_from_text"),
    )


@query(
    "time_features",
    oracle=_CAL
    + f""", t AS (SELECT packet_id, CAST(hour({_DUCK_TS}) AS INT) AS hour,
             CAST(isodow({_DUCK_TS}) - 1 AS INT) AS day_of_week FROM c)
        SELECT *, day_of_week >= 5 AS is_weekend, hour < 6 OR hour >= 20 AS is_night FROM t""",
)
def time_features(inputs):
    columns = calendar.time_features(F.col("timestamp"))
    return _calendar(inputs).select("packet_id", *[c.alias(n) for n, c in columns.items()])


_CAL_PARTS = f""", t AS (SELECT packet_id, CAST(hour({_DUCK_TS}) AS INT) AS hour,
     CAST(minute({_DUCK_TS}) AS INT) AS minute, CAST(isodow({_DUCK_TS}) - 1 AS INT) AS day_of_week FROM c)"""


@query(
    "temporal_calendar",
    oracle=_CAL
    + _CAL_PARTS
    + """ SELECT *, day_of_week >= 5 AS is_weekend, hour >= 22 OR hour <= 5 AS is_night,
            hour >= 9 AND hour <= 17 AND day_of_week < 5 AS is_business_hours FROM t""",
)
def temporal_calendar(inputs):
    columns = calendar.calendar_features(F.col("timestamp"))
    return _calendar(inputs).select("packet_id", *[c.alias(n) for n, c in columns.items()])


@query(
    "temporal_calendar_strict",
    oracle=_CAL
    + _CAL_PARTS
    + """ SELECT *, day_of_week >= 5 AS is_weekend,
            hour >= 9 AND hour < 17 AND day_of_week < 5 AS is_business_hours FROM t""",
)
def temporal_calendar_strict(inputs):
    columns = calendar.calendar_features(F.col("timestamp"), strict=True)
    return _calendar(inputs).select("packet_id", *[c.alias(n) for n, c in columns.items()])


@query("flow_window_keys", oracle=f"WITH {_KEYED} SELECT packet_id, flow, time_window FROM keyed")
def flow_window_keys(inputs):
    return flows.with_flow_keys(inputs.view("packets")).select("packet_id", "flow", "time_window")


@query(
    "same_subnet",
    oracle="""SELECT packet_id, regexp_extract(src_ip, '^\\d+\\.\\d+\\.\\d+')
              = regexp_extract(dst_ip, '^\\d+\\.\\d+\\.\\d+') AS same_subnet FROM packets""",
)
def same_subnet(inputs):
    return flows.enrich_packets(inputs.view("packets")).select("packet_id", "same_subnet")


_PORTS = ", ".join(str(p) for p in network.WELL_KNOWN_PORTS)


@query(
    "port_classes",
    oracle=f"""SELECT packet_id,
      coalesce(src_port IN ({_PORTS}), FALSE) AS src_port_well_known,
      coalesce(src_port BETWEEN 1024 AND 49151, FALSE) AS src_port_registered,
      coalesce(src_port >= 49152, FALSE) AS src_port_dynamic,
      coalesce(dst_port IN ({_PORTS}), FALSE) AS dst_port_well_known,
      coalesce(dst_port BETWEEN 1024 AND 49151, FALSE) AS dst_port_registered,
      coalesce(dst_port >= 49152, FALSE) AS dst_port_dynamic FROM packets""",
)
def port_classes(inputs):
    columns = {
        **network.port_classes("src_port", F.col("src_port")),
        **network.port_classes("dst_port", F.col("dst_port")),
    }
    return inputs.view("packets").select("packet_id", *[c.alias(n) for n, c in columns.items()])


@query(
    "packet_size_classes",
    oracle="""SELECT packet_id, length < 64 AS packet_size_tiny,
      length >= 64 AND length < 256 AS packet_size_small,
      length >= 256 AND length < 1024 AS packet_size_medium,
      length >= 1024 AND length < 1500 AS packet_size_large,
      length >= 1500 AS packet_size_jumbo FROM packets""",
)
def packet_size_classes(inputs):
    columns = network.size_classes(F.col("length"))
    return inputs.view("packets").select("packet_id", *[c.alias(n) for n, c in columns.items()])


@query(
    "cidr_membership",
    oracle="""WITH a AS (SELECT packet_id, src_ip, dst_ip,
        src_ip LIKE '192.168.1.%' OR src_ip LIKE '10.%'
          OR regexp_matches(src_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') AS s,
        dst_ip LIKE '192.168.1.%' OR dst_ip LIKE '10.%'
          OR regexp_matches(dst_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') AS d FROM signature_packets)
      SELECT packet_id, s AS src_internal, d AS dst_internal,
        CASE WHEN s AND d THEN 'internal' WHEN s AND NOT d THEN 'outbound'
             WHEN NOT s AND d THEN 'inbound' WHEN NOT s AND NOT d THEN 'external' END AS direction FROM a""",
)
def cidr_membership(inputs):
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return inputs.view("signature_packets").select(
        "packet_id",
        network.in_networks(src).alias("src_internal"),
        network.in_networks(dst).alias("dst_internal"),
        network.direction(src, dst).alias("direction"),
    )


@query(
    "in_out_ratio",
    oracle="""WITH e AS (SELECT DISTINCT src, dst FROM edges),
      p AS (SELECT src AS ip, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
      SELECT ip, coalesce(sum(i) / nullif(CAST(sum(o) AS DOUBLE), 0), 0) AS in_out_ratio
      FROM p GROUP BY ip""",
    floats="in_out_ratio",
)
def in_out_ratio(inputs):
    edges = graph.weighted_edges(inputs.view("packets"))
    return graph.degrees(edges).select("ip", "in_out_ratio")


@query(
    "entity_key",
    oracle="""SELECT DISTINCT src_ip AS ip, concat('ip_', md5(src_ip)) AS entity_key FROM packets
              WHERE src_ip IS NOT NULL""",
)
def entity_key(inputs):
    ips = inputs.view("packets").select(F.col("src_ip").alias("ip")).dropna().distinct()
    return ips.withColumn("entity_key", sev.entity_key(F.lit("ip"), F.col("ip")))


@query(
    "numeric_feature_select",
    oracle="""SELECT packet_id, CAST(coalesce(length, 0) AS INT) AS length, coalesce(src_port, 0) AS src_port,
      coalesce(dst_port, 0) AS dst_port, coalesce(ttl, 0) AS ttl, coalesce(tcp_flags, 0) AS tcp_flags
      FROM packets""",
)
def numeric_feature_select(inputs):
    from netspark.ml.features import numeric_features

    return numeric_features(inputs.view("packets"), keep=["packet_id"])


@query(
    "dummy_encode",
    oracle="""SELECT packet_id, CAST(protocol = 'DNS' AS INT) AS protocol_DNS,
      CAST(protocol = 'HTTP' AS INT) AS protocol_HTTP, CAST(protocol = 'ICMP' AS INT) AS protocol_ICMP,
      CAST(protocol = 'TCP' AS INT) AS protocol_TCP, CAST(protocol = 'UDP' AS INT) AS protocol_UDP
      FROM packets""",
)
def dummy_encode(inputs):
    from netspark.ml.features import dummy_columns

    return inputs.view("packets").select(
        "packet_id",
        *[c.alias(n) for n, c in dummy_columns("protocol", flows.PROTOCOLS).items()],
    )


# --- aggregations -------------------------------------------------------------------


@query(
    "flow_features",
    oracle="SELECT * FROM flows",
    floats="length_mean length_std packet_rate byte_rate",
)
def flow_features(inputs):
    return flows.flow_features(inputs.view("packets"))


_PROTO_COLUMNS = ", ".join(
    f"count(*) FILTER (WHERE protocol = '{p}') AS {p}" for p in flows.PROTOCOLS
)
_PROTO_RATIOS = ", ".join(
    f"count(*) FILTER (WHERE protocol = '{p}') / CAST(count(*) AS DOUBLE) AS ratio_{p}"
    for p in flows.PROTOCOLS
)


@query(
    "protocol_distribution",
    oracle=f"""WITH {_KEYED} SELECT flow, time_window, {_PROTO_COLUMNS}, {_PROTO_RATIOS} FROM keyed
       WHERE flow IS NOT NULL AND protocol IS NOT NULL GROUP BY flow, time_window""",
    floats="ratio_DNS ratio_HTTP ratio_ICMP ratio_TCP ratio_UDP",
)
def protocol_distribution(inputs):
    return flows.protocol_distribution(inputs.view("packets"))


@query(
    "protocol_distribution_long",
    oracle=f"""WITH {_KEYED}, c AS (SELECT flow, time_window, protocol, count(*) AS packets FROM keyed
         WHERE flow IS NOT NULL AND protocol IS NOT NULL GROUP BY ALL)
       SELECT *, packets / sum(packets) OVER (PARTITION BY flow, time_window) AS ratio FROM c""",
    floats="ratio",
)
def protocol_distribution_long(inputs):
    return flows.protocol_distribution_long(inputs.view("packets"))


_ENTROPY = f"""{_KEYED},
  v AS (SELECT flow, time_window, 0 AS side, src_port AS port, count(*) AS c FROM keyed
          WHERE flow IS NOT NULL GROUP BY ALL
        UNION ALL SELECT flow, time_window, 1, dst_port, count(*) FROM keyed
          WHERE flow IS NOT NULL GROUP BY ALL),
  p AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY flow, time_window, side) AS DOUBLE) AS share FROM v),
  entropy AS (SELECT flow, time_window, -sum(share * log2(share)) + 0.0e0 AS port_entropy FROM p
              GROUP BY flow, time_window)"""


@query(
    "port_entropy",
    oracle=f"""WITH {_ENTROPY} SELECT packet_id, flow, time_window, port_entropy + 0.0e0 AS port_entropy
               FROM keyed LEFT JOIN entropy USING (flow, time_window)""",
    floats="port_entropy",
)
def port_entropy(inputs):
    return flows.port_features(inputs.view("packets")).select(
        "packet_id", "flow", "time_window", (F.col("port_entropy") + 0.0).alias("port_entropy")
    )


_IAT = """SELECT packet_id, src_ip, timestamp,
    CASE WHEN src_ip IS NOT NULL THEN timestamp - lag(timestamp)
      OVER (PARTITION BY src_ip ORDER BY timestamp, packet_id) END AS inter_arrival_time FROM packets"""


@query("inter_arrival_time", oracle=_IAT, floats="inter_arrival_time")
def inter_arrival_time(inputs):
    packets = inputs.view("packets").select("packet_id", "src_ip", "timestamp")
    return flows.inter_arrival(packets)


@query(
    "inter_arrival_stats",
    oracle=f"""SELECT src_ip, avg(inter_arrival_time) AS mean_inter_arrival,
      stddev_samp(inter_arrival_time) AS std_inter_arrival, min(inter_arrival_time) AS min_inter_arrival,
      max(inter_arrival_time) AS max_inter_arrival FROM ({_IAT}) i WHERE src_ip IS NOT NULL GROUP BY src_ip""",
    floats="mean_inter_arrival std_inter_arrival min_inter_arrival max_inter_arrival",
)
def inter_arrival_stats(inputs):
    return flows.inter_arrival_stats(inputs.view("packets"))


_IAT_FLOW = f"""WITH {_KEYED} SELECT packet_id, flow, CASE WHEN flow IS NOT NULL THEN coalesce(timestamp
    - lag(timestamp) OVER (PARTITION BY flow ORDER BY timestamp, packet_id), 0) END
    AS inter_arrival_time FROM keyed"""


@query("inter_arrival_flow", oracle=_IAT_FLOW, floats="inter_arrival_time")
def inter_arrival_flow(inputs):
    keyed = flows.with_flow_keys(inputs.view("packets")).select("packet_id", "flow", "timestamp")
    return flows.inter_arrival(keyed, key="flow", first=0.0).drop("timestamp")


@query(
    "inter_arrival_stats_flow",
    oracle=f"""SELECT flow, avg(inter_arrival_time) AS iat_mean, stddev_samp(inter_arrival_time) AS iat_std,
      min(inter_arrival_time) AS iat_min, max(inter_arrival_time) AS iat_max
      FROM ({_IAT_FLOW}) i WHERE flow IS NOT NULL GROUP BY flow""",
    floats="iat_mean iat_std iat_min iat_max",
)
def inter_arrival_stats_flow(inputs):
    return flows.inter_arrival_stats_flow(inputs.view("packets"))


@query(
    "packets_per_second_stats",
    oracle=f"""WITH {_KEYED}, s AS (SELECT flow, CAST(trunc(timestamp) AS BIGINT) AS second,
         count(length) AS pps FROM keyed WHERE flow IS NOT NULL GROUP BY ALL)
      SELECT flow, avg(pps) AS pps_mean, stddev_samp(pps) AS pps_std, min(pps) AS pps_min,
        max(pps) AS pps_max, CAST(sum(pps) AS BIGINT) AS pps_sum FROM s GROUP BY flow""",
    floats="pps_mean pps_std",
)
def packets_per_second_stats(inputs):
    return flows.packets_per_second_stats(inputs.view("packets"))


_SIZES = {
    "tiny": "length < 64",
    "small": "length >= 64 AND length < 256",
    "medium": "length >= 256 AND length < 1024",
    "large": "length >= 1024 AND length < 1500",
    "jumbo": "length >= 1500",
}
_SIZE_SUMS = ", ".join(
    f"count(*) FILTER (WHERE {t}) AS packet_size_{n}_sum" for n, t in _SIZES.items()
)
_SIZE_RATIOS = ", ".join(
    f"coalesce(count(*) FILTER (WHERE {t}) / CAST(nullif(count(length), 0) AS DOUBLE), 0) AS ratio_{n}"
    for n, t in _SIZES.items()
)


@query(
    "packet_pattern_stats",
    oracle=f"""WITH {_KEYED} SELECT flow, time_window, avg(length) AS length_mean,
      coalesce(stddev_samp(length), 0) AS length_std, min(length) AS length_min, max(length) AS length_max,
      CAST(sum(length) AS BIGINT) AS length_sum, count(length) AS length_count, {_SIZE_SUMS}, {_SIZE_RATIOS}
      FROM keyed WHERE flow IS NOT NULL GROUP BY flow, time_window""",
    floats="length_mean length_std ratio_tiny ratio_small ratio_medium ratio_large ratio_jumbo",
)
def packet_pattern_stats(inputs):
    return flows.packet_pattern_stats(inputs.view("packets"))


@query(
    "flow_behavior",
    oracle="""WITH q AS (SELECT quantile_cont(length_count, 0.95) AS hc, quantile_cont(byte_rate, 0.95) AS hb
                         FROM flows)
      SELECT flows.*, length_std / nullif(length_mean, 0) AS packet_rate_cv,
        CAST(length_sum AS DOUBLE) / length_count AS byte_per_packet_mean,
        length_count > hc AS high_packet_count, length_count = 1 AS low_packet_count,
        byte_rate > hb AS high_byte_rate FROM flows CROSS JOIN q""",
    floats="length_mean length_std packet_rate byte_rate packet_rate_cv byte_per_packet_mean",
)
def flow_behavior(inputs):
    return flows.flow_behavior(flows.flow_features(inputs.view("packets")))


@query(
    "burst_and_rate_flags",
    oracle="""WITH q AS (SELECT quantile_cont(length_count, 0.95) AS hc, quantile_cont(byte_rate, 0.95) AS hb
                         FROM flows)
      SELECT flow, time_window FROM flows CROSS JOIN q WHERE length_count > hc OR byte_rate > hb""",
)
def burst_and_rate_flags(inputs):
    flagged = flows.flow_behavior(flows.flow_features(inputs.view("packets")))
    return flagged.filter("high_packet_count OR high_byte_rate").select("flow", "time_window")


@query(
    "port_scan_behavior",
    oracle="""SELECT src_ip, count(DISTINCT dst_port) AS unique_dst_ports, count(*) AS packet_count,
      count(DISTINCT dst_port) / CAST(count(*) AS DOUBLE) AS port_scan_ratio,
      count(DISTINCT dst_port) / CAST(count(*) AS DOUBLE) > 0.5 AS potential_scanner
      FROM packets WHERE src_ip IS NOT NULL GROUP BY src_ip""",
    floats="port_scan_ratio",
)
def port_scan_behavior(inputs):
    return flows.port_scan_behavior(inputs.view("packets"))


# --- joins and sequences ------------------------------------------------------------

_DEGREES = """e AS (SELECT DISTINCT src, dst FROM edges),
  p AS (SELECT src AS ip, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e),
  nodes AS (SELECT ip, count(*) AS degree, CAST(sum(i) AS BIGINT) AS in_degree,
    CAST(sum(o) AS BIGINT) AS out_degree,
    coalesce(sum(i) / nullif(CAST(sum(o) AS DOUBLE), 0), 0) AS in_out_ratio FROM p GROUP BY ip)"""


@query("degree_centrality_counts", oracle=f"WITH {_DEGREES} SELECT * FROM nodes", floats="in_out_ratio")
def degree_centrality_counts(inputs):
    return graph.degrees(graph.weighted_edges(inputs.view("packets")))


@query(
    "node_metrics_join",
    oracle=f"""WITH {_DEGREES} SELECT packet_id, src_ip, dst_ip, s.degree AS src_degree,
       s.in_degree AS src_in_degree, s.out_degree AS src_out_degree, s.in_out_ratio AS src_in_out_ratio,
       d.degree AS dst_degree, d.in_degree AS dst_in_degree, d.out_degree AS dst_out_degree,
       d.in_out_ratio AS dst_in_out_ratio
       FROM packets LEFT JOIN nodes s ON src_ip = s.ip LEFT JOIN nodes d ON dst_ip = d.ip""",
    floats="src_in_out_ratio dst_in_out_ratio",
)
def node_metrics_join(inputs):
    packets = inputs.view("packets").select("packet_id", "src_ip", "dst_ip")
    return graph.join_node_metrics(packets, graph.degrees(graph.weighted_edges(packets)))


@query(
    "group_stats_join_back",
    oracle=f"""WITH i AS ({_IAT}), s AS (SELECT src_ip, avg(inter_arrival_time) AS mean_inter_arrival,
        max(inter_arrival_time) AS max_inter_arrival FROM i WHERE src_ip IS NOT NULL GROUP BY src_ip)
      SELECT packet_id, src_ip, mean_inter_arrival, max_inter_arrival
      FROM packets LEFT JOIN s USING (src_ip)""",
    floats="mean_inter_arrival max_inter_arrival",
)
def group_stats_join_back(inputs):
    packets = inputs.view("packets")
    stats = flows.inter_arrival_stats(packets).select(
        "src_ip", "mean_inter_arrival", "max_inter_arrival"
    )
    return flows.join_group_stats(packets.select("packet_id", "src_ip"), stats, ["src_ip"])


@query(
    "feature_full_join",
    oracle=f"""WITH {_ENTROPY}, t AS (SELECT flow, time_window, count(*) AS tcp_packets FROM keyed
        WHERE flow IS NOT NULL AND protocol = 'TCP' GROUP BY ALL)
      SELECT flow, time_window, coalesce(length_count, 0) AS length_count,
        coalesce(port_entropy, 0) + 0.0e0 AS port_entropy, coalesce(tcp_packets, 0) AS tcp_packets
      FROM flows FULL JOIN entropy USING (flow, time_window) FULL JOIN t USING (flow, time_window)""",
    floats="port_entropy",
)
def feature_full_join(inputs):
    packets = inputs.view("packets")
    tcp = (
        flows.with_flow_keys(packets)
        .filter((F.col("protocol") == "TCP") & F.col("flow").isNotNull())
        .groupBy(*flows.FLOW_KEYS)
        .agg(F.count(F.lit(1)).alias("tcp_packets"))
    )
    groups = [
        flows.flow_features(packets).select(*flows.FLOW_KEYS, "length_count"),
        flows.port_entropy_by_flow(packets),
        tcp,
    ]
    combined = flows.combine_feature_groups(groups)
    return combined.withColumn("port_entropy", F.col("port_entropy") + 0.0)


@query(
    "ip_stats_inner_join",
    oracle="""WITH p AS (SELECT src_ip, count(DISTINCT dst_port) AS unique_dst_ports FROM packets GROUP BY src_ip),
       c AS (SELECT src_ip, count(*) AS packet_count FROM packets GROUP BY src_ip)
      SELECT src_ip, unique_dst_ports, packet_count FROM p JOIN c USING (src_ip)""",
)
def ip_stats_inner_join(inputs):
    return flows.port_scan_behavior(inputs.view("packets")).select(
        "src_ip", "unique_dst_ports", "packet_count"
    )


@query(
    "sliding_sequences",
    oracle="""WITH w AS (SELECT packet_id, src_ip, timestamp,
        count(*) OVER f AS n, array_agg(length) OVER f AS ls, array_agg(dst_port) OVER f AS ps
        FROM packets WHERE src_ip IS NOT NULL
        WINDOW f AS (PARTITION BY src_ip ORDER BY timestamp, packet_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
      SELECT packet_id, src_ip, timestamp, n AS steps, array_to_string(ls, ',') AS lengths,
        array_to_string(ps, ',') AS ports FROM w WHERE n = 10""",
)
def sliding_sequences(inputs):
    sequences = flows.sliding_sequences(inputs.view("packets"), ["length", "dst_port"])
    joined = lambda i: F.array_join(
        F.transform("sequence", lambda step: step[i].cast("int").cast("string")), ","
    )
    return sequences.select(
        "packet_id",
        "src_ip",
        "timestamp",
        F.size("sequence").cast("bigint").alias("steps"),
        joined(0).alias("lengths"),
        joined(1).alias("ports"),
    )


@query(
    "sort_by_time",
    oracle="SELECT packet_id, timestamp, src_ip, length FROM packets ORDER BY timestamp, packet_id",
)
def sort_by_time(inputs):
    packets = inputs.view("packets").select("packet_id", "timestamp", "src_ip", "length")
    return packets.orderBy("timestamp", "packet_id")
