"""Alerts: building, filtering, routing, summaries and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.functions import calendar
from netspark.functions import severity as sev
from netspark.operators import ordering
from netspark.session import cut_lineage

# Channel, enabled, lowest severity that it takes.
DEFAULT_CHANNELS = [("email", True, "high"), ("chat", True, "medium"), ("card", False, "high")]


#: Longest top list of a detail report; it is sent to every task.


def anomalies(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("prediction") == -1)


def time_range(df: DataFrame, *, start: float | None = None, end: float | None = None):
    """Inclusive on both ends; either may be open."""
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(float(start)))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(float(end)))
    return df


def build_alerts(detections: DataFrame) -> DataFrame:
    """One alert per anomalous packet."""
    return anomalies(detections).select(
        F.col("packet_id").alias("alert_id"),
        "timestamp",
        sev.alert_type_title(F.col("attack_type")).alias("type"),
        sev.severity_from_score(F.col("anomaly_score")).alias("severity"),
        "src_ip",
        "dst_ip",
        "protocol",
        F.col("dst_port").alias("port"),
        F.col("length").alias("packet_size"),
        "anomaly_score",
        sev.alert_description(F.col("src_ip"), F.col("dst_ip"), F.col("protocol")).alias(
            "description"
        ),
    )


#: Columns of the alert table page; one that the input lacks is shown empty.
TABLE_COLUMNS = ["severity", "type", "src_ip", "dst_ip", "description", "threat_intel_display"]


def alert_table(alerts: DataFrame) -> DataFrame:
    """Readable time and no nulls; order it with :func:`newest` when it is shown."""
    stamp = F.date_format(calendar.epoch_to_timestamp(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss")
    shown = {
        name: F.coalesce(F.col(name), F.lit("")) if name in alerts.columns else F.lit("")
        for name in TABLE_COLUMNS
    }
    return alerts.withColumns({"timestamp": stamp, **shown})


def newest(df: DataFrame, n: int, *, tie: str = "alert_id") -> DataFrame:
    """The last ``n`` rows by time; each task keeps only its own best ``n``."""
    return df.orderBy(F.desc("timestamp"), F.desc(tie)).limit(n)


def top_anomalies(detections: DataFrame, n: int = 5) -> DataFrame:
    return anomalies(detections).orderBy("anomaly_score", "packet_id").limit(n)


def top_sources(alerts: DataFrame, n: int = 10) -> DataFrame:
    return _counts(alerts, "src_ip").orderBy(F.desc("alerts"), "src_ip").limit(n)


def _counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("alerts"))
    )


def route(alerts: DataFrame, channels: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """One row per alert and channel that is enabled and takes its severity.

    The channel list is configuration, so it is a literal array: no join, no shuffle.
    """
    rank = sev.severity_rank(F.lower(F.coalesce("severity", F.lit(sev.LOWEST_SEVERITY))))
    takers = [
        F.when(rank >= sev.SEVERITY_RANK.get(threshold, 0), F.lit(name))
        for name, enabled, threshold in (DEFAULT_CHANNELS if channels is None else channels)
        if enabled
    ]
    if not takers:
        return alerts.withColumn("channel", F.lit(None).cast("string")).filter(F.lit(False))
    return alerts.withColumn("channel", F.explode(F.array_compact(F.array(*takers))))


def outbound_batches(
    alerts: DataFrame, document: Column, *, batch_size: int = 50, order: str = "timestamp"
) -> DataFrame:
    """Documents in time order, ``batch_size`` per batch, as one array per batch; no time comes first."""
    prepared = alerts.select("alert_id", order, F.to_json(document).alias("document"))
    ranked = ordering.with_rank(prepared, [], order, "_rank", tie="alert_id")
    batch = F.floor((F.col("_rank") - 1) / batch_size)
    item = F.struct("_rank", "alert_id", "document")
    return (
        ranked.groupBy(batch.alias("batch_id"))
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            "batch_id",
            F.size("_items").alias("batch_rows"),
            F.transform("_items", lambda i: i["alert_id"]).alias("alert_ids"),
            F.transform("_items", lambda i: i["document"]).alias("documents"),
        )
    )


def alert_summary(alerts: DataFrame, *, top: int = 10) -> DataFrame:
    """Long form (section, key, value): totals, severities, types, top sources, time range.

    Alerts are read and aggregated once, by (severity, type, source); every section is a
    roll-up of that much smaller table, which is written for them to share.
    """
    base = cut_lineage(
        alerts.groupBy("severity", "type", "src_ip").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("lo"),
            F.max("timestamp").alias("hi"),
        )
    )

    def section(name: str, rows: DataFrame, key: Column, value: Column) -> DataFrame:
        return rows.select(
            F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value")
        )

    def by(column: str) -> DataFrame:
        return (
            base.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        )

    whole = base.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    sources = by("src_ip").orderBy(F.desc("n"), "src_ip").limit(top)
    range_rows = whole.select(
        F.explode(F.create_map(F.lit("start"), F.col("lo"), F.lit("end"), F.col("hi"))).alias("k", "v")
    )
    return (
        section("total", whole, F.lit("alerts"), F.col("n"))
        .unionByName(section("severity", by("severity"), F.col("severity"), F.col("n")))
        .unionByName(section("type", by("type"), F.col("type"), F.col("n")))
        .unionByName(section("top_source", sources, F.col("src_ip"), F.col("n")))
        .unionByName(section("time_range", range_rows, F.col("k"), F.col("v")))
    )


def report_document(alerts: DataFrame, *, top: int = 10) -> DataFrame:
    """The summary as one nested row, ready for JSON.

    Only severities, alert types and the top list are gathered, never alerts.
    """
    entries = lambda name: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("key", "value"))))
    ).alias(name)
    value = lambda name, key: F.max(
        F.when((F.col("section") == name) & (F.col("key") == key), F.col("value"))
    )
    return alert_summary(alerts, top=top).agg(
        value("total", "alerts").cast("bigint").alias("total_alerts"),
        entries("severity"),
        entries("top_source"),
        entries("type"),
        F.struct(
            value("time_range", "start").alias("start"), value("time_range", "end").alias("end")
        ).alias("time_range"),
    )


def capture_summary(detections: DataFrame) -> DataFrame:
    return detections.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction") == -1).alias("anomalies"),
    ).withColumn(
        "anomaly_percent",
        F.coalesce(F.try_divide(F.col("anomalies") * 100.0, F.col("total")), F.lit(0.0)),
    )


def evaluation_metrics(detections: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 with *normal* as the positive class; score range."""
    truth, guess = F.col("label") > 0, F.col("prediction") > 0
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = detections.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.avg("anomaly_score").alias("mean_score"),
        F.min("anomaly_score").alias("min_score"),
        F.max("anomaly_score").alias("max_score"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1_score"),
        ratio(fn + F.col("tn"), F.col("n")).alias("anomaly_ratio"),
        "mean_score",
        "min_score",
        "max_score",
    )


def attack_distribution(packets: DataFrame) -> DataFrame:
    return packets.groupBy("attack_type").agg(F.count(F.lit(1)).alias("packets"))


def running_statistics(
    packets: DataFrame,
    alerts: DataFrame,
    *,
    keep_packets: int | None = 10_000,
    keep_alerts: int | None = 1_000,
) -> DataFrame:
    """Packets, alerts and alert rate, over the retained rows or (with None) all time."""
    if keep_packets is not None:
        packets = newest(packets, keep_packets, tie="packet_id")
    if keep_alerts is not None:
        alerts = newest(alerts, keep_alerts)
    total = packets.agg(F.count(F.lit(1)).alias("total_packets"))
    found = alerts.agg(F.count(F.lit(1))).scalar()
    return total.withColumn("total_alerts", found).withColumn(
        "anomaly_rate",
        F.coalesce(
            F.try_divide(F.col("total_alerts") * 100.0, F.col("total_packets")), F.lit(0.0)
        ),
    )


def score_histogram(
    detections: DataFrame, *, low: float = -1.0, high: float = 1.0, bins: int = 20
) -> DataFrame:
    """Rows per score bin and prediction; bin 0 is below ``low``, bins + 1 is from ``high``."""
    return detections.groupBy(
        "prediction",
        F.width_bucket("anomaly_score", F.lit(low), F.lit(high), F.lit(bins)).alias("bin"),
    ).agg(F.count(F.lit(1)).alias("packets"))


def score_quartiles(detections: DataFrame) -> DataFrame:
    """Box-plot numbers per prediction: quartiles, and whisker fences at 1.5 IQR."""
    score = {str(p): F.when(F.col("prediction") == p, F.col("anomaly_score")) for p in (-1, 1)}
    quartiles = ordering.exact_quantile_table(detections, score, [0.25, 0.5, 0.75])
    rows = detections.filter(F.col("prediction").isin(-1, 1))
    boxes = rows.groupBy(F.col("prediction").cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("packets"))
    numbers = {"q1": {}, "median": {}, "q3": {}, "low_fence": {}, "high_fence": {}}
    for prediction, (q1, median, q3) in quartiles.items():
        fences = [None, None] if q1 is None else [q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)]
        for name, value in zip(numbers, (q1, median, q3, *fences)):
            numbers[name][int(prediction)] = value
    of = lambda known: F.when(F.col("prediction") == -1, F.lit(known[-1])).otherwise(F.lit(known[1]))
    return boxes.select("*", *[of(known).cast("double").alias(name) for name, known in numbers.items()])


def timeline(packets: DataFrame, results: DataFrame, *, on: str = "timestamp") -> DataFrame:
    """Packets with their scores; joining on ``packet_id`` avoids fan-out on equal times."""
    return packets.join(results.select(on, "prediction", "anomaly_score"), on, "left")


def severity_bubbles(alerts: DataFrame) -> DataFrame:
    """Timeline points with a numeric severity, null when the severity is unknown."""
    return alerts.select(
        "alert_id",
        "timestamp",
        "anomaly_score",
        "severity",
        sev.severity_rank(F.col("severity"), unknown=None).alias("numeric_severity"),
    )


def alert_detail(
    alerts: DataFrame, packets: DataFrame, *, top: int = 10, around_seconds: float = 5.0
) -> DataFrame:
    """The ``top`` worst alerts with the packets of the same pair close in time.

    The report side is a top list, which the planner may broadcast. Rows stay in long form:
    a busy pair is not gathered.
    """
    worst = alerts.orderBy("anomaly_score", "alert_id").limit(top).select(
        "alert_id",
        F.col("timestamp").alias("alert_time"),
        "severity",
        "type",
        "src_ip",
        "dst_ip",
    )
    near = F.abs(F.col("timestamp") - F.col("alert_time")) <= F.lit(float(around_seconds))
    traffic = packets.select("packet_id", "timestamp", "length", "protocol", "src_ip", "dst_ip")
    return traffic.join(worst, ["src_ip", "dst_ip"]).filter(near)


def traffic_around(
    alerts: DataFrame,
    packets: DataFrame,
    *,
    around_seconds: float = 5.0,
    max_bucket_rows: int = ordering.MAX_BUCKET_ROWS,
) -> DataFrame:
    """For every alert: packets and bytes of its pair within the time band, ends included.

    An alert without an address or a time has none. ``alert_id`` identifies an alert.

    Difference of two running totals, read at both ends of the band, so no alert is
    paired with packets. Totals run per time bucket; bucket sums carry over.
    """
    band = F.lit(float(around_seconds))
    order = lambda side, key: F.struct(
        F.lit(side).alias("side"), F.col(key).cast("bigint").alias("id")
    )
    placed = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("timestamp").isNotNull()
    marks = alerts.filter(placed).select(
        "src_ip",
        "dst_ip",
        "alert_id",
        F.inline(
            F.array(
                # Below all packets at the lower end, above all of them at the upper end.
                F.struct(
                    (F.col("timestamp") - band).alias("t"),
                    order(0, "alert_id").alias("o"),
                    F.lit(-1).alias("sign"),
                ),
                F.struct(
                    (F.col("timestamp") + band).alias("t"),
                    order(2, "alert_id").alias("o"),
                    F.lit(1).alias("sign"),
                ),
            )
        ),
    ).withColumns({"n": F.lit(0).cast("bigint"), "bytes": F.lit(0).cast("bigint")})
    rows = packets.filter(placed).select(
        "src_ip",
        "dst_ip",
        F.lit(None).cast("bigint").alias("alert_id"),
        F.col("timestamp").alias("t"),
        order(1, "packet_id").alias("o"),
        F.lit(0).alias("sign"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("length").cast("bigint").alias("bytes"),
    )
    totals = ordering.with_running_sums(
        rows.unionByName(marks),
        ["src_ip", "dst_ip"],
        "t",
        ["n", "bytes"],
        tie="o",
        max_bucket_rows=max_bucket_rows,
    )
    sums = (
        totals.filter(F.col("sign") != 0)
        .groupBy("alert_id")
        .agg(
            F.sum(F.col("sign") * F.col("n_total")).alias("packets_around"),
            F.sum(F.col("sign") * F.col("bytes_total")).alias("bytes_around"),
        )
    )
    none = F.lit(0).cast("bigint")
    return alerts.select("alert_id").distinct().join(sums, "alert_id", "left").select(
        "alert_id",
        F.coalesce("packets_around", none).alias("packets_around"),
        F.coalesce("bytes_around", none).alias("bytes_around"),
    )


def union_traffic(*batches: DataFrame) -> DataFrame:
    """Append batches; columns that one lacks are null there."""
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch, allowMissingColumns=True)
    return result
