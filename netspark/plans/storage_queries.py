"""Sources and sinks: each query writes below the shared folder and reads back."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from netspark.functions import payloads
from netspark.ml import preprocess
from netspark.operators import alerts as al
from netspark.operators import flows, intel
from netspark.plans.captures_fixture import encode_captures, write_captures
from netspark.plans.intel_queries import NOW
from netspark.plans.registry import query
from netspark.session import scratch_path
from netspark.sources import capture_source, captures, readers, sinks


@query("read_packets_csv", oracle="SELECT * FROM packets")
def read_packets_csv(inputs):
    """Two runs are written; the newest one is read."""
    base = scratch_path(inputs.spark, "csv")
    packets = inputs.view("packets")
    sinks.write_run(packets.filter("attack_type = 'ddos'"), base, "20240101-000000", file_format="csv")
    sinks.write_run(packets, base, "20240102-000000", file_format="csv")
    return readers.read_latest_packets_csv(inputs.spark, base)


_FLAGS = """CAST(hour(make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT))) AS INT) AS hour"""


@query(
    "read_processed_pair",
    oracle=f"""WITH k AS (SELECT packet_id, concat(src_ip, '->', dst_ip) AS flow,
          CAST(floor(timestamp / 60) * 60 AS DOUBLE) AS time_window, {_FLAGS}
          FROM packets WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL)
      SELECT packet_id, flow, time_window, hour, length_count FROM k JOIN flows USING (flow, time_window)""",
)
def read_processed_pair(inputs):
    path = _processed(inputs)
    enriched, flow_table = readers.read_processed_pair(inputs.spark, path)
    keyed = flows.with_flow_keys(enriched).select("packet_id", *flows.FLOW_KEYS, "hour")
    return keyed.join(flow_table.select(*flows.FLOW_KEYS, "length_count"), flows.FLOW_KEYS)


def _processed(inputs, run_id="20240102-000000"):
    base = scratch_path(inputs.spark, "processed")
    packets = inputs.view("packets").drop("attack_type")
    enriched = flows.enrich_packets(packets)
    model = preprocess.fit_preprocessor(packets)
    matrix = preprocess.apply_preprocessor(model, packets).select("packet_id", "features")
    sinks.write_processed_set(matrix, enriched, flows.flow_features(packets), model, base, run_id)
    return base


@query(
    "write_processed_set",
    oracle="""SELECT (SELECT count(*) FROM packets) AS matrix_rows, (SELECT count(*) FROM packets) AS enriched_rows,
      (SELECT count(*) FROM flows) AS flow_rows, (SELECT count(*) FROM packets) AS scored_rows""",
)
def write_processed_set(inputs):
    """The four artefacts of a run; the reloaded preprocessing gives the same matrix."""
    spark = inputs.spark
    run = readers.latest_run(spark, _processed(inputs))
    matrix = spark.read.parquet(f"{run}/matrix")
    model = PipelineModel.load(f"{run}/preprocessor")
    again = preprocess.apply_preprocessor(model, inputs.view("packets").drop("attack_type"))
    same = matrix.join(
        again.select("packet_id", F.col("features").alias("f")), "packet_id"
    ).filter(F.col("features") == F.col("f"))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return matrix.agg(F.count(F.lit(1)).alias("matrix_rows")).select(
        "matrix_rows",
        count(spark.read.parquet(f"{run}/enriched")).alias("enriched_rows"),
        count(spark.read.parquet(f"{run}/flows")).alias("flow_rows"),
        count(same).alias("scored_rows"),
    )


@query(
    "read_features_labels",
    oracle="""SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS chars, quality AS label
              FROM documents LEFT JOIN labels USING (doc_id)""",
)
def read_features_labels(inputs):
    features, labels = scratch_path(inputs.spark, "x"), scratch_path(inputs.spark, "y")
    documents = inputs.table("documents")
    documents.select(
        F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double")).alias("features")
    ).write.parquet(features)
    inputs.table("labels").withColumnRenamed("doc_id", "id").write.parquet(labels)
    joined = readers.read_features_labels(inputs.spark, features, labels)
    return joined.select("id", F.col("features")[0].alias("chars"), "label")


_LAYERED = """l AS (SELECT *, dst_ip IS NOT NULL AS ip,
  CASE WHEN dst_ip IS NULL THEN NULL WHEN protocol IN ('TCP', 'HTTP') THEN 'TCP'
       WHEN protocol IN ('UDP', 'DNS') THEN 'UDP' END AS transport FROM packets)"""


@query(
    "read_pcap_dir",
    oracle=f"""WITH {_LAYERED} SELECT timestamp, CAST(length AS BIGINT) AS frame_length,
      CASE WHEN ip THEN '0x0800' ELSE '0x0806' END AS eth_type,
      CASE WHEN NOT ip THEN NULL WHEN transport = 'TCP' THEN '6' WHEN transport = 'UDP' THEN '17' ELSE '1' END
        AS ip_proto, CASE WHEN ip THEN src_ip END AS src_ip, dst_ip, CASE WHEN ip THEN ttl END AS ttl, transport,
      CASE WHEN transport IS NOT NULL THEN src_port END AS src_port,
      CASE WHEN transport IS NOT NULL THEN dst_port END AS dst_port,
      CASE WHEN transport = 'TCP' THEN tcp_flags END AS tcp_flags FROM l""",
    floats="timestamp",
)
def read_pcap_dir(inputs):
    """Files of a folder, each read in ranges by several tasks."""
    folder = scratch_path(inputs.spark, "captures")
    write_captures(inputs.view("packets"), folder)
    found = capture_source.read_captures(inputs.spark, folder, range_bytes=100_000)
    return found.drop("file", "record", "highest_layer", "malformed", "record_bytes", "file_bytes")


@query(
    "packet_projection",
    oracle=f"""WITH {_LAYERED} SELECT timestamp, length, coalesce(transport, 'UNKNOWN') AS protocol,
      CASE WHEN ip THEN src_ip END AS src_ip, dst_ip,
      CASE WHEN transport IS NOT NULL THEN src_port END AS src_port,
      CASE WHEN transport IS NOT NULL THEN dst_port END AS dst_port, CASE WHEN ip THEN ttl END AS ttl,
      CASE WHEN transport = 'TCP' THEN tcp_flags END AS tcp_flags FROM l""",
    floats="timestamp",
)
def packet_projection(inputs):
    files = encode_captures(inputs.view("packets"))
    return captures.to_packets(captures.dissect_captures(files)).drop("packet_id")


@query(
    "read_records_json",
    oracle="""SELECT packet_id AS request_id, CAST(length AS DOUBLE) AS length,
      CAST(dst_port AS DOUBLE) AS dst_port, CAST(ttl AS DOUBLE) AS ttl, 0 AS position FROM packets
      UNION ALL SELECT packet_id, CAST(length AS DOUBLE) + 1, CAST(dst_port AS DOUBLE), NULL, 1 FROM packets
        WHERE packet_id % 3 <> 0""",
)
def read_records_json(inputs):
    """Bodies in the three accepted shapes: one object, objects, lists."""
    names = ["length", "dst_port", "ttl"]
    one = F.struct(*names)
    more = F.struct((F.col("length") + 1).alias("length"), "dst_port")
    lists = F.array(F.array(*names), F.array(F.col("length") + 1, F.col("dst_port")))
    objects = F.concat(F.lit("["), F.to_json(one), F.lit(","), F.to_json(more), F.lit("]"))
    shape = F.col("packet_id") % 3
    body = F.when(shape == 0, F.to_json(one)).when(shape == 1, objects).otherwise(F.to_json(lists))
    requests = inputs.view("packets").select(F.col("packet_id").alias("request_id"), body.alias("body"))
    return readers.read_records_json(requests, names)


@query("read_blocklist", oracle="SELECT DISTINCT ip FROM blocklist")
def read_blocklist(inputs):
    """The list with padding, comments, blanks and repeats, as text."""
    path = scratch_path(inputs.spark, "blocklist")
    noise = F.array(
        F.concat(F.lit("  "), "ip", F.lit(" ")), F.concat(F.lit("# "), "ip"), F.lit(""), F.col("ip")
    )
    lines = inputs.view("blocklist").select(F.explode(noise).alias("line"))
    sinks.write_lines(lines, "line", path)
    return readers.read_blocklist(inputs.spark, path)


@query("read_threat_db", oracle="SELECT * EXCLUDE (item_id) FROM threat_db")
def read_threat_db(inputs):
    path = scratch_path(inputs.spark, "threat_db")
    table = inputs.view("threat_db").drop("item_id")
    table.write.option("header", True).option("escape", '"').csv(path)
    known = readers.read_threat_db(inputs.spark, path)
    missing = readers.read_threat_db(inputs.spark, scratch_path(inputs.spark, "none"))
    return known.unionByName(missing)


@query("read_reputation_feeds", oracle="SELECT * FROM reputation_feeds")
def read_reputation_feeds(inputs):
    path = scratch_path(inputs.spark, "feeds")
    inputs.view("reputation_feeds").write.json(path)
    return readers.read_reputation_feeds(inputs.spark, path)


@query(
    "write_features",
    oracle="SELECT src_ip, count(DISTINCT dst_port) AS unique_dst_ports FROM packets WHERE src_ip IS NOT NULL GROUP BY src_ip",
)
def write_features(inputs):
    base = scratch_path(inputs.spark, "features")
    table = flows.port_scan_behavior(inputs.view("packets")).select("src_ip", "unique_dst_ports")
    sinks.write_run(table.filter("src_ip = 'nobody'"), base, "20240103-000000")  # empty: skipped
    path = sinks.write_run(table, base, "20240102-000000")
    assert readers.latest_run(inputs.spark, base) == path
    return inputs.spark.read.parquet(path)


@query(
    "write_metrics",
    oracle="""SELECT count(*) AS total, count(*) FILTER (WHERE prediction = -1) AS anomalies, 'run-1' AS run_id
              FROM detections""",
)
def write_metrics(inputs):
    path = scratch_path(inputs.spark, "metrics")
    metrics = al.capture_summary(inputs.view("detections")).select("total", "anomalies")
    sinks.write_metrics(metrics, path, "run-1")
    schema = "total bigint, anomalies bigint, run_id string"
    return inputs.spark.read.schema(schema).option("header", True).csv(path)


@query(
    "write_detections",
    oracle="""SELECT *, strftime(make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT)), '%Y-%m-%d') AS date
              FROM detections""",
)
def write_detections(inputs):
    path = scratch_path(inputs.spark, "detections")
    sinks.write_detections(inputs.view("detections"), path)
    return inputs.spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))


@query(
    "write_report_json",
    oracle="""SELECT count(*) AS total_alerts, CAST(count(*) FILTER (WHERE severity = 'critical') AS DOUBLE)
        AS critical, CAST(count(*) FILTER (WHERE type = 'Ddos Attack') AS DOUBLE) AS ddos,
        min(timestamp) AS start, max(timestamp) AS "end" FROM alerts""",
)
def write_report_json(inputs):
    path = scratch_path(inputs.spark, "report")
    sinks.write_report_json(al.report_document(inputs.view("alerts")), path)
    schema = (
        "total_alerts bigint, severity map<string,double>, type map<string,double>, "
        "time_range struct<start:double,end:double>"
    )
    return inputs.spark.read.schema(schema).json(path).select(
        "total_alerts",
        F.col("severity")["critical"].alias("critical"),
        F.col("type")["Ddos Attack"].alias("ddos"),
        "time_range.start",
        "time_range.end",
    )


@query(
    "write_outbound",
    oracle="SELECT alert_id, severity FROM alerts",
)
def write_outbound(inputs):
    """Batches of documents as JSON lines, unpacked again."""
    path = scratch_path(inputs.spark, "outbound")
    alerts = inputs.view("alerts")
    fields = {n: F.col(n) for n in ("timestamp", "severity", "type", "src_ip", "dst_ip", "protocol")}
    ranked = alerts.select("alert_id", *fields)
    document = payloads.generic_event(fields, F.struct("src_ip", "dst_ip"), now=NOW)
    prepared = ranked.withColumn("document", document)
    sinks.write_outbound(al.outbound_batches(prepared, F.col("document")), path)
    schema = "batch_id bigint, batch_rows int, alert_ids array<bigint>, documents array<string>"
    rows = inputs.spark.read.schema(schema).json(path).select(
        F.explode(F.arrays_zip("alert_ids", "documents")).alias("d")
    )
    return rows.select(
        F.col("d.alert_ids").alias("alert_id"),
        F.get_json_object("d.documents", "$.severity").alias("severity"),
    )


@query("feed_rows", oracle="SELECT ip, provider, collected_at FROM reputation_feeds")
def feed_rows(inputs):
    """Every stored document parses to a result."""
    return intel.parse_feeds(inputs.view("reputation_feeds")).drop("result")
