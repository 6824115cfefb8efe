"""Writers. Every run has its own ``run_id=`` folder, so a repeated run replaces itself."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.calendar import epoch_to_timestamp


def write_run(df: DataFrame, base: str, run_id: str, *, file_format: str = "parquet") -> str | None:
    """Write one run; nothing is written for an empty table."""
    if df.isEmpty():
        return None
    path = f"{base.rstrip('/')}/run_id={run_id}"
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_format).save(path)
    return path


def write_processed_set(
    matrix: DataFrame,
    enriched: DataFrame,
    flows: DataFrame,
    model: PipelineModel,
    base: str,
    run_id: str,
) -> str:
    """Feature matrix, enriched packets, flows and the fitted preprocessing of one run."""
    path = f"{base.rstrip('/')}/run_id={run_id}"
    for name, table in (("matrix", matrix), ("enriched", enriched), ("flows", flows)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    model.write().overwrite().save(f"{path}/preprocessor")
    return path


def write_detections(detections: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append by day. The rebalance hint evens out file sizes, splitting a busy day."""
    dated = detections.withColumn("date", epoch_to_timestamp(F.col("timestamp")).cast("date"))
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append one row of metrics, marked with its run."""
    metrics.withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("append").option(
        "header", True
    ).csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON document per row of a small report."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_outbound(batches: DataFrame, path: str) -> None:
    """Outbound batches as JSON lines, ready for a delivery service."""
    batches.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
