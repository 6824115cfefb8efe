"""Streaming operators, drained over packet files derived from the packet table."""

from pyspark.sql import functions as F

from netspark.ml import detector as det
from netspark.ml import preprocess
from netspark.operators import alerts as al
from netspark.plans import jobs
from netspark.plans.alert_queries import BUILT
from netspark.plans.forest_sql import VERDICT, forest_ctes
from netspark.plans.model_queries import PACKET_FEATURES
from netspark.plans.registry import query
from netspark.session import scratch_path
from netspark.sources import readers
from netspark.streaming import live_gaps, streams

#: Files that arrive one after the other.
ARRIVALS = 3


def arrive(inputs, table: str = "packets") -> str:
    """Write the packets in time order as a few successive arrivals."""
    path = scratch_path(inputs.spark, "arrivals")
    packets = inputs.view(table)
    low, high = packets.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (high - low) / ARRIVALS
    for i in range(ARRIVALS):
        part = al.time_range(packets, start=low + i * step)
        if i + 1 < ARRIVALS:
            part = part.filter(F.col("timestamp") < low + (i + 1) * step)
        part.write.mode("append").option("header", True).csv(path)
    return path


def _drain(inputs, stream, write, name, **options):
    checkpoint = scratch_path(inputs.spark, f"{name}-checkpoint")
    running = streams.write_batches(stream, write, checkpoint, **options)
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return running


def _through_folder(inputs, stream, name, **options):
    path = scratch_path(inputs.spark, name)
    _drain(inputs, stream, streams.to_folders(path), name, **options)
    return inputs.spark.read.parquet(path).drop("batch")


@query("read_packet_stream", oracle="SELECT * FROM packets")
def read_packet_stream(inputs):
    packets = readers.read_packet_stream(inputs.spark, arrive(inputs))
    return _through_folder(inputs, packets, "stream-packets")


@query(
    "stream_packets",
    oracle="SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY protocol",
)
def stream_packets(inputs):
    """Files one by one; batches are counted from the sink."""
    packets = readers.read_packet_stream(inputs.spark, arrive(inputs), files_per_trigger=4)
    kept = _through_folder(inputs, packets, "stream-files")
    return kept.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes")
    )


_FINAL = "floor((SELECT max(timestamp) FROM packets) * 1000) / 1000 - 120"


@query(
    "stream_flow_windows",
    oracle=f"""SELECT flow, time_window, length_count, length_mean, length_std, length_min, length_max,
      length_sum, protocol_nunique, src_port_nunique, dst_port_nunique, packet_rate, byte_rate
      FROM flows WHERE time_window + 60 <= {_FINAL}""",
    floats="length_mean length_std packet_rate byte_rate",
)
def stream_flow_windows(inputs):
    """Windows that the watermark has closed by the end of the input."""
    packets = readers.read_packet_stream(inputs.spark, arrive(inputs))
    windows = streams.flow_windows(streams.with_event_time(packets))
    return _through_folder(inputs, windows, "stream-flows")


@query(
    "stream_volume_windows",
    oracle=f"""SELECT CAST(floor(timestamp / 5) * 5 AS DOUBLE) AS bin_start, count(*) AS packet_count FROM packets
      GROUP BY ALL HAVING floor(min(timestamp) / 5) * 5 + 5 <= {_FINAL}""",
)
def stream_volume_windows(inputs):
    packets = readers.read_packet_stream(inputs.spark, arrive(inputs))
    volume = streams.volume_windows(streams.with_event_time(packets))
    return _through_folder(inputs, volume, "stream-volume")


@query(
    "stream_statistics",
    oracle="""SELECT count(*) AS total_packets, count(*) FILTER (WHERE attack_type <> 'normal') AS total_alerts,
      count(*) FILTER (WHERE attack_type <> 'normal') * 100.0e0 / count(*) AS anomaly_rate FROM packets""",
    floats="anomaly_rate",
)
def stream_statistics(inputs):
    """The last state of the running totals."""
    packets = readers.read_packet_stream(inputs.spark, arrive(inputs), files_per_trigger=8)
    verdict = F.when(F.col("attack_type") == "normal", 1).otherwise(-1)
    totals = streams.statistics(packets.withColumn("prediction", verdict))
    path = scratch_path(inputs.spark, "stream-totals")
    done = _drain(inputs, totals, streams.to_folders(path), "totals", mode="complete")
    return inputs.spark.read.parquet(streams.batch_folder(path, streams.last_batch(done)))


#: Every so many-th packet arrives when its slot has been closed.
_OVERDUE = 50


@query(
    "stream_inter_arrival",
    oracle=f"""WITH kept AS (SELECT src_ip, timestamp - lag(timestamp) OVER (
        PARTITION BY src_ip ORDER BY timestamp, packet_id) AS gap
        FROM packets WHERE src_ip IS NOT NULL AND timestamp IS NOT NULL AND packet_id % {_OVERDUE} <> 0),
      overdue AS (SELECT src_ip, count(timestamp) AS late, count(*) - count(timestamp) AS undated
        FROM packets WHERE src_ip IS NOT NULL AND (packet_id % {_OVERDUE} = 0 OR timestamp IS NULL) GROUP BY src_ip),
      gaps AS (SELECT src_ip, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, min(gap) AS low, max(gap) AS high
        FROM kept GROUP BY src_ip)
      SELECT src_ip, mean_gap AS mean_inter_arrival, std_gap AS std_inter_arrival, low AS min_inter_arrival,
        high AS max_inter_arrival, coalesce(late, 0)::BIGINT AS late_packets,
        coalesce(undated, 0)::BIGINT AS undated_packets
      FROM gaps FULL JOIN overdue USING (src_ip)""",
    floats="mean_inter_arrival std_inter_arrival min_inter_arrival max_inter_arrival",
)
def stream_inter_arrival(inputs):
    """Gap statistics per source of a live stream; some packets arrive too late and are only counted."""
    packets = inputs.view("packets")
    overdue = (F.col("packet_id") % _OVERDUE == 0) | F.col("timestamp").isNull()
    path = arrive_in_order(inputs, packets.filter(~overdue))
    low, high = packets.agg(F.min("timestamp"), F.max("timestamp")).first()
    # A packet of a much later time closes all slots; it has no source of its own.
    closing = packets.limit(1).withColumns(
        {"timestamp": F.lit(high + 10 * (high - low) + 1e6), "src_ip": F.lit(None).cast("string")}
    )
    for part in (closing, packets.filter(overdue)):
        part.coalesce(1).write.mode("append").option("header", True).csv(path)
    stream = readers.read_packet_stream(inputs.spark, path, files_per_trigger=1)
    slot_seconds = max(1, int((high - low) / 2))
    slots = live_gaps.gap_slots(stream, slot_seconds=slot_seconds)
    return live_gaps.statistics(_through_folder(inputs, slots, "stream-gaps"))


#: Packets of one file that arrives in time order.
ORDERED_FILE_ROWS = 500_000


def arrive_in_order(inputs, packets) -> str:
    """One file per arrival, of bounded size, so that no micro-batch sees a later packet first."""
    path = scratch_path(inputs.spark, "ordered")
    low, high, rows = packets.agg(F.min("timestamp"), F.max("timestamp"), F.count(F.lit(1))).first()
    arrivals = max(ARRIVALS, -(-rows // ORDERED_FILE_ROWS))
    step = (high - low) / arrivals
    for i in range(arrivals):
        part = al.time_range(packets, start=low + i * step)
        if i + 1 < arrivals:
            part = part.filter(F.col("timestamp") < low + (i + 1) * step)
        part.coalesce(1).write.mode("append").option("header", True).csv(path)
    return path


@query(
    "stream_alerts",
    oracle=f"""WITH {PACKET_FEATURES}, {forest_ctes("e", "e", 0.1)}, y AS (SELECT {VERDICT} FROM forest_scores),
      scored AS (SELECT packets.*, anomaly_score, prediction FROM packets JOIN y ON id = packet_id)
      {BUILT.replace("detections d", "scored d")}""",
    floats="anomaly_score",
)
def stream_alerts(inputs):
    """Score arriving packets with a fitted forest, alert, route and batch; the alerts."""
    packets = inputs.view("packets")
    numeric = ["length", "src_port", "dst_port", "ttl", "tcp_flags"]
    model = preprocess.fit_preprocessor(packets, numeric=numeric, categorical=["protocol"])
    ready = preprocess.apply_preprocessor(model, packets).withColumnRenamed("packet_id", "id")
    detector = det.AnomalyDetector.fit(ready, det.FOREST, use_pca=False, contamination=0.1)
    arriving = readers.read_packet_stream(inputs.spark, arrive(inputs))
    score = lambda batch: jobs.detect_packets(batch, model, detector)
    path = scratch_path(inputs.spark, "stream-alerts")
    _drain(inputs, arriving, streams.after(score, streams.alert_writer(path)), "alerts")
    return inputs.spark.read.parquet(f"{path}/alerts").drop("batch")


_BEST = """best AS (SELECT * FROM threat_db
  QUALIFY row_number() OVER (PARTITION BY indicator, type ORDER BY confidence DESC, item_id) = 1)"""


@query(
    "stream_enrich",
    oracle=f"""WITH {_BEST} SELECT packet_id,
        CASE WHEN d.confidence > coalesce(s.confidence, -1) THEN d.confidence ELSE s.confidence END
          AS threat_confidence, b.ip IS NOT NULL AS is_malicious
      FROM packets p LEFT JOIN best s ON p.src_ip = s.indicator LEFT JOIN best d ON p.dst_ip = d.indicator
      LEFT JOIN blocklist b ON p.src_ip = b.ip""",
)
def stream_enrich(inputs):
    arriving = readers.read_packet_stream(inputs.spark, arrive(inputs))
    enriched = streams.enrich(arriving, inputs.view("threat_db"), inputs.view("blocklist"))
    wanted = enriched.select("packet_id", "threat_confidence", "is_malicious")
    return _through_folder(inputs, wanted, "stream-enrich")
