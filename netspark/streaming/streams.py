"""Live traffic with Structured Streaming.

Sinks write one folder per micro-batch and replace it, so a batch that is replayed
after a failure does not count twice. State goes to the RocksDB store, off the heap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netspark.functions import calendar
from netspark.operators import alerts as al
from netspark.operators import intel
from netspark.session import remove_folder, scratch_scope

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "2 minutes"


@contextmanager
def stream_settings(spark: SparkSession, *, state_partitions: int | None = None) -> Iterator[None]:
    """Settings that a query takes over when it starts.

    The number of state partitions is fixed for a query's whole life; choose it for the
    key count. The previous settings come back afterwards.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def with_event_time(packets: DataFrame, *, watermark: str = WATERMARK) -> DataFrame:
    event_time = calendar.epoch_to_timestamp(F.col("timestamp"))
    return packets.withColumn("event_time", event_time).withWatermark("event_time", watermark)


def write_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    mode: str = "append",
    once: bool = True,
    interval: str = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``write``; ``once`` drains and stops."""
    with stream_settings(stream.sparkSession, state_partitions=state_partitions):
        writer = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
        )
        trigger = {"availableNow": True} if once else {"processingTime": interval}
        return writer.trigger(**trigger).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def to_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that replaces its own folder for each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def flow_windows(packets: DataFrame, *, window_seconds: int = 60) -> DataFrame:
    """Tumbling flow statistics; a window is final once the watermark has passed it.

    Distinct counts are exact: their sets are part of the state, at most 65,536 ports each.
    """
    size = F.window("event_time", f"{window_seconds} seconds")
    flow = calendar.flow_key(F.col("src_ip"), F.col("dst_ip"))
    seconds = F.lit(float(window_seconds))
    return (
        packets.withColumn("flow", flow)
        .filter(F.col("flow").isNotNull())
        .groupBy(size.alias("w"), "flow")
        .agg(
            F.count("length").alias("length_count"),
            F.avg("length").alias("length_mean"),
            F.stddev_samp("length").alias("length_std"),
            F.min("length").alias("length_min"),
            F.max("length").alias("length_max"),
            F.sum("length").alias("length_sum"),
            F.size(F.collect_set("protocol")).cast("bigint").alias("protocol_nunique"),
            F.size(F.collect_set("src_port")).cast("bigint").alias("src_port_nunique"),
            F.size(F.collect_set("dst_port")).cast("bigint").alias("dst_port_nunique"),
        )
        .select(
            "flow",
            (F.unix_micros("w.start") / 1e6).alias("time_window"),
            F.col("length_count"),
            "length_mean",
            "length_std",
            "length_min",
            "length_max",
            "length_sum",
            "protocol_nunique",
            "src_port_nunique",
            "dst_port_nunique",
            (F.col("length_count") / seconds).alias("packet_rate"),
            (F.col("length_sum") / seconds).alias("byte_rate"),
        )
    )


def volume_windows(packets: DataFrame, *, seconds: int = 5) -> DataFrame:
    """Packets per bin of the live volume chart."""
    return (
        packets.groupBy(F.window("event_time", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("packet_count"))
        .select((F.unix_micros("w.start") / 1e6).alias("bin_start"), "packet_count")
    )


def statistics(detections: DataFrame) -> DataFrame:
    """Running totals and alert rate over all time."""
    return detections.groupBy().agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.count_if(F.col("prediction") == -1).alias("total_alerts"),
        (
            F.coalesce(
                F.try_divide(
                    F.count_if(F.col("prediction") == -1) * 100.0, F.count(F.lit(1))
                ),
                F.lit(0.0),
            )
        ).alias("anomaly_rate"),
    )


def alert_writer(path: str, *, channels=None, document=None, batch_size: int = 50):
    """Per micro-batch: alerts, their channels and outbound batches, each in its own folder."""

    def write(detections: DataFrame, batch_id: int) -> None:
        folder = batch_folder(f"{path}/alerts", batch_id)
        al.build_alerts(detections).write.mode("overwrite").parquet(folder)
        alerts = detections.sparkSession.read.parquet(folder)
        routed = al.route(alerts, channels).select("alert_id", "severity", "channel")
        routed.write.mode("overwrite").parquet(batch_folder(f"{path}/routes", batch_id))
        body = F.struct(*alerts.columns) if document is None else document
        batches = al.outbound_batches(alerts, body, batch_size=batch_size)
        batches.write.mode("overwrite").json(batch_folder(f"{path}/outbound", batch_id))

    return write


def after(
    change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """Change each micro-batch as an ordinary table, then write it; scratch tables go with the batch.

    Models that store tables or join them, such as the outlier factor, work here and not on a stream.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            write(change(batch), batch_id)

    return run


def enrich(alerts: DataFrame, threat_db: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Stream-static lookups: indicators and blocklist on each alert."""
    return intel.flag_blocklisted(intel.enrich_alerts(alerts, threat_db), blocklist)


def last_batch(query: StreamingQuery) -> int:
    """Number of the newest micro-batch of a finished query."""
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]
