"""Run a job: ``python -m netspark <job> ...`` (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netspark.ml.detector import FOREST, MODEL_TYPES
from netspark.plans import jobs
from netspark.session import configure


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="netspark")
    commands = root.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str, run: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        if run:
            sub.add_argument("--run-id", required=True)
        return sub

    job("capture", "source", "target", run=True)
    job("preprocess", "source", "target", run=True).add_argument("--window", type=float, default=60)
    features = job("features", "source", "target", run=True)
    features.add_argument("--k", type=int)
    features.add_argument("--centralities", action="store_true")
    features.add_argument("--pivots", type=int)
    train = job("train", "features", "model", "metrics", run=True)
    train.add_argument("--labels")
    train.add_argument("--type", choices=MODEL_TYPES, default=FOREST)
    train.add_argument("--test-percent", type=int, default=20)
    train.add_argument("--no-pca", action="store_true")
    job("detect", "source", "run", "model", "target")
    monitor = job("monitor", "source", "run", "model", "target", "checkpoint")
    monitor.add_argument("--forever", action="store_true")
    report = job("report", "alerts", "target")
    report.add_argument("--start", type=float)
    report.add_argument("--end", type=float)
    return root


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName(f"netspark {a.job}").getOrCreate())
    if a.job == "capture":
        jobs.capture_files(spark, a.source, a.target, a.run_id)
    elif a.job == "preprocess":
        jobs.preprocess_files(spark, a.source, a.target, a.run_id, window_seconds=a.window)
    elif a.job == "features":
        jobs.feature_files(
            spark, a.source, a.target, a.run_id, k=a.k, centralities=a.centralities, pivots=a.pivots
        )
    elif a.job == "train":
        jobs.train_files(
            spark,
            a.features,
            a.labels,
            a.model,
            a.metrics,
            a.run_id,
            model_type=a.type,
            test_percent=a.test_percent,
            use_pca=not a.no_pca,
        )
    elif a.job == "detect":
        jobs.detect_files(spark, a.source, a.run, a.model, a.target).show()
    elif a.job == "monitor":
        running = jobs.monitor_files(
            spark, a.source, a.run, a.model, a.target, a.checkpoint, once=not a.forever
        )
        running.awaitTermination()
    elif a.job == "report":
        jobs.report_files(spark, a.alerts, a.target, start=a.start, end=a.end)


if __name__ == "__main__":
    main()
