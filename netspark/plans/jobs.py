"""Whole jobs: feature extraction, training, batch detection, live monitoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netspark.functions import calendar, network
from netspark.ml import detector as det
from netspark.ml import preprocess, reduce
from netspark.ml.features import NOT_FEATURES, encoded_columns, feature_array, numeric_columns
from netspark.operators import alerts as al
from netspark.operators import flows, graph
from netspark.session import cut_lineage
from netspark.sources import capture_source, captures, readers, sinks
from netspark.streaming import streams


def packet_feature_table(
    packets: DataFrame,
    *,
    window_seconds: float = 60,
    centralities: bool = False,
    pivots: int | None = None,
) -> DataFrame:
    """All feature groups at packet grain, joined by key and never by row position.

    Flow-grain groups join on (flow, time_window), address-grain groups on the address.
    ``centralities`` adds all node measures to both ends; they take a search from every node,
    or, estimated, from ``pivots`` of them.
    """
    base = flows.with_flow_keys(packets, window_seconds=window_seconds).withColumns(
        {
            **calendar.calendar_features(F.col("timestamp")),
            **network.port_classes("src_port", F.col("src_port")),
            **network.port_classes("dst_port", F.col("dst_port")),
            **network.size_classes(F.col("length")),
        }
    )
    # Three consumers (two quantiles and the join) share the flow table.
    flow_table = cut_lineage(
        flows.flow_features(packets, window_seconds=window_seconds, protocols=flows.PROTOCOLS)
    )
    entropy = flows.port_entropy_by_flow(packets, window_seconds=window_seconds)
    limits = flows.flow_thresholds(flow_table)
    # Lengths are in the flow table already.
    patterns = flows.packet_pattern_stats(packets, window_seconds=window_seconds)
    patterns = patterns.drop(*[c for c in patterns.columns if c.startswith("length_")])
    flow_grain = flows.flow_behavior(flow_table, limits).join(entropy, flows.FLOW_KEYS, "left")
    flow_grain = flow_grain.join(patterns, flows.FLOW_KEYS, "left")
    edges = graph.weighted_edges(packets)
    nodes = graph.node_metrics(edges, pivots=pivots, relative=True) if centralities else graph.degrees(edges)
    source_grain = flows.port_scan_behavior(packets).join(
        flows.inter_arrival_stats(packets), "src_ip", "left"
    )
    joined = base.join(flow_grain, flows.FLOW_KEYS, "left").join(source_grain, "src_ip", "left")
    return graph.join_node_metrics(joined, nodes)


def reduce_feature_table(
    table: DataFrame, *, k: int | None = None, label: str | None = None, id_column: str = "packet_id"
) -> DataFrame:
    """Keep the k best features by F-test with a label, else k components.

    With ``k`` the numeric columns are reduced. Without it truth values and dummies of the string columns are
    features as well, and a third of all features is left.
    """
    if k is None:
        not_features = {*NOT_FEATURES, id_column, "flow", *([] if label is None else [label])}
        encoded = encoded_columns(table, exclude=not_features)
        others = [id_column, *([] if label is None else [label])]
        table = table.select(*others, *[column.alias(name) for name, column in encoded.items()])
        names, k = list(encoded), max(1, len(encoded) // 3)
    else:
        names = numeric_columns(table)
    # The joins behind the table are costly and every fit reads it, so it is written once.
    vectors = cut_lineage(
        table.select(
            F.col(id_column),
            feature_array(names).alias("features"),
            *([] if label is None else [F.col(label).alias("label")]),
        )
    )
    if label is None:
        fitted = reduce.Projection.fit(vectors, k=k)
        return fitted.columns(vectors).drop("features")
    positions, _ = reduce.select_k_best(vectors, k)
    return vectors.select(
        id_column, *[F.col("features")[i].alias(names[i]) for i in positions]
    )


def train_and_evaluate(
    labelled: DataFrame,
    path: str,
    *,
    model_type: str = det.FOREST,
    test_percent: int = 20,
    **options,
) -> DataFrame:
    """Train on one part, save, load, and evaluate on the other (``label`` > 0 is normal)."""
    spark = labelled.sparkSession
    train, test = det.hash_split(labelled, test_percent=test_percent)
    det.AnomalyDetector.fit(train, model_type, **options).save(spark, path)
    loaded = det.AnomalyDetector.load(spark, path)
    return al.evaluation_metrics(loaded.transform(test))


def detect_packets(
    packets: DataFrame, preprocessor: PipelineModel, detector: det.AnomalyDetector
) -> DataFrame:
    """Batch detection: per-packet features, score and verdict, no other columns lost."""
    features = preprocess.apply_preprocessor(preprocessor, packets).withColumn(
        "id", F.col("packet_id")
    )
    return detector.transform(features).drop("id", "features")


def preprocess_files(
    spark: SparkSession, source: str, target: str, run_id: str, *, window_seconds: float = 60
) -> str:
    """Packet CSV to the four artefacts of a processing run."""
    packets = readers.read_packets_csv(spark, source)
    model = preprocess.fit_preprocessor(packets)
    matrix = preprocess.apply_preprocessor(model, packets).select(
        F.col("packet_id").alias("id"), "features"
    )
    table = flows.flow_features(packets, window_seconds=window_seconds)
    return sinks.write_processed_set(
        matrix, flows.enrich_packets(packets), table, model, target, run_id
    )


def capture_files(spark: SparkSession, source: str, target: str, run_id: str) -> str | None:
    """Capture files to a packet run."""
    return sinks.write_run(captures.to_packets(capture_source.read_captures(spark, source)), target, run_id)


def feature_files(
    spark: SparkSession,
    source: str,
    target: str,
    run_id: str,
    *,
    k: int | None = None,
    centralities: bool = False,
    pivots: int | None = None,
) -> str | None:
    """Packet CSV to the joined feature table, or to its k components."""
    packets = readers.read_packets_csv(spark, source)
    table = packet_feature_table(packets, centralities=centralities, pivots=pivots)
    return sinks.write_run(table if k is None else reduce_feature_table(table, k=k), target, run_id)


def train_files(
    spark: SparkSession,
    features: str,
    labels: str | None,
    model_path: str,
    metrics_path: str,
    run_id: str,
    *,
    model_type: str = det.FOREST,
    test_percent: int = 20,
    use_pca: bool = True,
) -> DataFrame:
    """Feature arrays (and labels by id) to a saved model and one row of metrics.

    Without labels the metrics that need them are null.
    """
    rows = readers.read_features_labels(spark, features, labels)
    labelled = rows if labels is not None else rows.withColumn("label", F.lit(None).cast("int"))
    metrics = train_and_evaluate(
        labelled, model_path, model_type=model_type, test_percent=test_percent, use_pca=use_pca
    )
    if labels is None:
        needs_labels = ("accuracy", "precision", "recall", "f1_score")
        metrics = metrics.withColumns({n: F.lit(None).cast("double") for n in needs_labels})
    sinks.write_metrics(metrics, metrics_path, run_id)
    return metrics


def detect_files(
    spark: SparkSession, source: str, run_path: str, model_path: str, target: str
) -> DataFrame:
    """Packet CSV scored with a saved run's preprocessing and a saved model; the summary."""
    packets = readers.read_packets_csv(spark, source)
    preprocessor = PipelineModel.load(f"{run_path}/preprocessor")
    detector = det.AnomalyDetector.load(spark, model_path)
    sinks.write_detections(detect_packets(packets, preprocessor, detector), target)
    return al.capture_summary(spark.read.parquet(target))


def predict_records(
    requests: DataFrame, columns: list[str], detector: det.AnomalyDetector
) -> DataFrame:
    """Verdicts for JSON request bodies, one row per record of each request."""
    records = readers.read_records_json(requests, columns)
    keys = [c for c in requests.columns if c != "body"]
    ready = records.withColumns(
        {"features": feature_array(columns), "id": F.xxhash64(*keys, "position")}
    )
    return detector.transform(ready).drop("id", "features")


def monitor_files(
    spark: SparkSession,
    source: str,
    run_path: str,
    model_path: str,
    target: str,
    checkpoint: str,
    *,
    once: bool = True,
) -> StreamingQuery:
    """Arriving packet files to alerts, routes and outbound batches; any type of model."""
    preprocessor = PipelineModel.load(f"{run_path}/preprocessor")
    detector = det.AnomalyDetector.load(spark, model_path)
    arriving = readers.read_packet_stream(spark, source)
    score = lambda packets: detect_packets(packets, preprocessor, detector)
    write = streams.after(score, streams.alert_writer(target))
    return streams.write_batches(arriving, write, checkpoint, once=once)


def report_files(
    spark: SparkSession,
    alerts: str,
    target: str,
    *,
    start: float | None = None,
    end: float | None = None,
) -> None:
    """Alert table to the summary document."""
    chosen = al.time_range(spark.read.parquet(alerts), start=start, end=end)
    sinks.write_report_json(al.report_document(chosen), target)
