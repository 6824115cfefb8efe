"""The command-line jobs, one after the other, over files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.__main__ import main
from netspark.ml import detector as det
from netspark.plans import jobs
from netspark.plans.captures_fixture import encode_captures
from netspark.plans.registry import Inputs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    """A folder with packets as CSV."""
    base = tmp_path_factory.mktemp("jobs")
    Inputs(spark, SF_DIR).view("packets").write.option("header", True).csv(str(base / "csv"))
    return base


def test_preprocess_train_detect_monitor_report(spark, work):
    path = lambda name: str(work / name)
    main(["preprocess", "--source", path("csv"), "--target", path("processed"), "--run-id", "r1"])
    run = path("processed/run_id=r1")
    assert spark.read.parquet(f"{run}/flows").count() > 0
    labels = Inputs(spark, SF_DIR).view("detections").select(F.col("packet_id").alias("id"), "label")
    labels.write.parquet(path("labels"))
    main(["train", "--features", f"{run}/matrix", "--labels", path("labels"), "--model", path("model"),
          "--metrics", path("metrics"), "--run-id", "r1"])
    main(["train", "--features", f"{run}/matrix", "--model", path("model2"), "--metrics", path("metrics"),
          "--run-id", "r2", "--no-pca", "--type", "one_class_svm"])
    metrics = {r.run_id: r for r in spark.read.option("header", True).csv(path("metrics")).collect()}
    assert 0 <= float(metrics["r1"].accuracy) <= 1 and metrics["r2"].accuracy is None
    main(["detect", "--source", path("csv"), "--run", run, "--model", path("model"), "--target", path("found")])
    found = spark.read.parquet(path("found"))
    assert found.count() == 1000 and {"anomaly_score", "prediction", "date"} <= set(found.columns)
    main(["monitor", "--source", path("csv"), "--run", run, "--model", path("model"),
          "--target", path("live"), "--checkpoint", path("live-checkpoint")])
    alerts = spark.read.parquet(path("live/alerts"))
    assert alerts.count() == found.filter("prediction = -1").count() > 0
    main(["report", "--alerts", path("live/alerts"), "--target", path("report")])
    (document,) = (json.loads(line.value) for line in spark.read.text(path("report")).collect())
    assert document["total_alerts"] == alerts.count()
    assert sum(document["severity"].values()) == alerts.count()


@pytest.mark.parametrize("kind", ["one_class_svm", "lof", "ensemble"])
def test_monitor_with_every_model(spark, work, tmp_path, kind):
    path = lambda name: str(tmp_path / name)
    packets = spark.read.option("header", True).csv(str(work / "csv")).limit(300)
    packets.repartition(2).write.option("header", True).csv(path("csv"))
    main(["preprocess", "--source", path("csv"), "--target", path("processed"), "--run-id", "r1"])
    run = path("processed/run_id=r1")
    main(["train", "--features", f"{run}/matrix", "--model", path("model"), "--metrics", path("metrics"),
          "--run-id", "r1", "--type", kind])
    main(["detect", "--source", path("csv"), "--run", run, "--model", path("model"), "--target", path("found")])
    main(["monitor", "--source", path("csv"), "--run", run, "--model", path("model"),
          "--target", path("live"), "--checkpoint", path("live-checkpoint")])
    alerts = spark.read.parquet(path("live/alerts"))
    assert alerts.count() == spark.read.parquet(path("found")).filter("prediction = -1").count()


def test_features(spark, work):
    main(["features", "--source", str(work / "csv"), "--target", str(work / "features"), "--run-id", "r1", "--k", "4"])
    table = spark.read.parquet(str(work / "features/run_id=r1"))
    assert table.count() == 1000 and {"PC1", "PC4"} <= set(table.columns)


def test_captures(spark, work, tmp_path):
    packets = Inputs(spark, SF_DIR).view("packets")
    for row in encode_captures(packets, packets_per_file=300).collect():
        (tmp_path / row.path).write_bytes(row.content)
    main(["capture", "--source", str(tmp_path), "--target", str(work / "captured"), "--run-id", "r1"])
    assert spark.read.parquet(str(work / "captured/run_id=r1")).count() == 1000


def test_predict_requests(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(200)]
    fitted = det.AnomalyDetector.fit(spark.createDataFrame(rows, "id bigint, features array<double>"))
    bodies = [(1, '{"a": 1, "b": 2}'), (2, '[{"a": 500, "b": 900}, {"a": 3}]'), (3, "[[1, 2], [3, 4]]")]
    requests = spark.createDataFrame(bodies, "request bigint, body string")
    found = jobs.predict_records(requests, ["a", "b"], fitted).orderBy("anomaly_score").collect()
    assert len(found) == 5 and (found[0].request, found[0].position) == (2, 0) and found[0].is_anomaly


def test_all_centralities_in_the_feature_table(spark):
    table = jobs.packet_feature_table(Inputs(spark, SF_DIR).view("packets"), centralities=True)
    row = table.filter("dst_ip IS NOT NULL").first()
    assert row.src_betweenness is not None and row.dst_closeness is not None and row.src_degree > 0


def test_default_reduction_keeps_a_third(spark):
    rows = [(i, float(i % 7), float(i * i % 11), i % 2 == 0, "abc"[i % 3] if i % 5 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "packet_id bigint, x double, y double, even boolean, kind string")
    matrix = np.array([[x, y, even, kind == "a", kind == "b", kind == "c"] for _, x, y, even, kind in rows], float)
    centred = matrix - matrix.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False)[:2]
    found = jobs.reduce_feature_table(table)
    assert found.columns == ["packet_id", "PC1", "PC2"]
    parts = np.array([[r.PC1, r.PC2] for r in found.collect()])
    assert np.linalg.norm(parts, axis=0) == pytest.approx(values)
    labelled = table.withColumn("label", F.col("packet_id") % 2)
    assert jobs.reduce_feature_table(labelled, label="label").columns[0] == "packet_id"


def test_too_many_dummies_are_an_error(spark):
    table = spark.range(3000).select(F.col("id").alias("packet_id"), F.col("id").cast("string").alias("kind"))
    with pytest.raises(ValueError, match="more than 2000 values"):
        jobs.reduce_feature_table(table)
