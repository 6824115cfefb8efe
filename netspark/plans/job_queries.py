"""Whole-feature jobs."""

from netspark.plans import jobs
from netspark.plans.feature_queries import _DEGREES, _IAT, _KEYED, _SIZE_RATIOS, _SIZE_SUMS
from netspark.plans.components_sql import component_ctes, projected
from netspark.plans.registry import query

_NUMBERS = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in ("length", "src_port", "dst_port", "ttl", "tcp_flags"))
_WITH_DUMMIES = f"""v AS (SELECT DISTINCT protocol AS value FROM packets WHERE protocol IS NOT NULL),
  hot AS (SELECT packet_id, list(coalesce(CAST(protocol = value AS DOUBLE), 0) ORDER BY value) AS hot
          FROM packets CROSS JOIN v GROUP BY packet_id),
  e AS MATERIALIZED (SELECT packet_id AS id, list_concat([{_NUMBERS}], hot) AS features FROM packets JOIN hot USING (packet_id))"""


@query(
    "extract_all_features_job",
    oracle=f"""WITH {_KEYED}, {_DEGREES}, i AS ({_IAT}),
        g AS (SELECT src_ip, avg(inter_arrival_time) AS mean_inter_arrival FROM i WHERE src_ip IS NOT NULL
              GROUP BY src_ip),
        z AS (SELECT flow, time_window, {_SIZE_SUMS}, {_SIZE_RATIOS} FROM keyed WHERE flow IS NOT NULL GROUP BY ALL),
        c AS (SELECT src_ip, count(*) AS packet_count FROM packets WHERE src_ip IS NOT NULL GROUP BY src_ip)
      SELECT packet_id, CAST(hour(make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT))) AS INT) AS hour,
        coalesce(src_port >= 49152, FALSE) AS src_port_dynamic, length_count, byte_rate, mean_inter_arrival,
        packet_count, s.degree AS src_degree, d.degree AS dst_degree,
        coalesce(length >= 64 AND length < 256, FALSE) AS packet_size_small, packet_size_small_sum,
        packet_size_jumbo_sum, ratio_small
      FROM keyed LEFT JOIN z USING (flow, time_window) LEFT JOIN flows USING (flow, time_window) LEFT JOIN g USING (src_ip) LEFT JOIN c USING (src_ip)
      LEFT JOIN nodes s ON src_ip = s.ip LEFT JOIN nodes d ON dst_ip = d.ip""",
    floats="byte_rate mean_inter_arrival ratio_small",
)
def extract_all_features_job(inputs):
    table = jobs.packet_feature_table(inputs.view("packets"))
    return table.select(
        "packet_id",
        "hour",
        "src_port_dynamic",
        "length_count",
        "byte_rate",
        "mean_inter_arrival",
        "packet_count",
        "src_degree",
        "dst_degree",
        "packet_size_small",
        "packet_size_small_sum",
        "packet_size_jumbo_sum",
        "ratio_small",
    )


@query(
    "feature_assembly",
    oracle=f"""WITH {_KEYED}, t AS (SELECT flow, time_window, count(*) FILTER (WHERE protocol = 'TCP') AS TCP,
          count(*) FILTER (WHERE protocol = 'TCP') / CAST(count(protocol) AS DOUBLE) AS ratio_TCP FROM keyed
        WHERE flow IS NOT NULL GROUP BY ALL),
        s AS (SELECT src_ip, count(DISTINCT dst_port) AS unique_dst_ports FROM packets WHERE src_ip IS NOT NULL
          GROUP BY src_ip)
      SELECT packet_id, length_mean, length_count = 1 AS low_packet_count, TCP, ratio_TCP, unique_dst_ports
      FROM keyed LEFT JOIN flows USING (flow, time_window) LEFT JOIN t USING (flow, time_window)
      LEFT JOIN s USING (src_ip)""",
    floats="length_mean ratio_TCP",
)
def feature_assembly(inputs):
    """Groups of three grains on every packet, joined by their keys."""
    table = jobs.packet_feature_table(inputs.view("packets"))
    return table.select(
        "packet_id", "length_mean", "low_packet_count", "TCP", "ratio_TCP", "unique_dst_ports"
    )


@query("feature_assembly_reduced", floats="PC1 PC2 PC3")
def feature_assembly_reduced(inputs):
    """All packet features down to three components."""
    return jobs.reduce_feature_table(jobs.packet_feature_table(inputs.view("packets")), k=3)


@query("feature_assembly_selected")
def feature_assembly_selected(inputs):
    """The five features that separate the attack types best."""
    packets = inputs.view("packets")
    table = jobs.packet_feature_table(packets)
    return jobs.reduce_feature_table(table, k=5, label="attack_type")


@query(
    "feature_reduction_default",
    oracle=f"""WITH RECURSIVE {_WITH_DUMMIES}, {component_ctes("e", "3")}
      SELECT id AS packet_id, PC1, PC2, PC3 FROM ({projected("e", 3)})""",
    floats="PC1 PC2 PC3",
)
def feature_reduction_default(inputs):
    """Five numbers and five protocols: a third of them is left."""
    return jobs.reduce_feature_table(inputs.view("packets"))
