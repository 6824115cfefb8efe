"""Models against brute force and known outliers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.ml import boundary, preprocess, reduce
from netspark.ml import detector as det
from netspark.ml.forest import IsolationForest, average_path, tree_samples
from netspark.ml.outlier_factor import OutlierFactor
from netspark.ml.sequence import SequenceDetector


@pytest.fixture(scope="module")
def cloud(spark):
    """300 points around the origin and five far away (ids 300 to 304)."""
    generator = np.random.default_rng(7)
    points = np.vstack([generator.normal(size=(300, 3)), generator.normal(size=(5, 3)) + 12.0])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return points, spark.createDataFrame(rows, "id bigint, features array<double>").cache()


@pytest.mark.parametrize("model_type", det.MODEL_TYPES)
@pytest.mark.parametrize("use_pca", [True, False])
def test_outliers_have_the_lowest_scores(cloud, model_type, use_pca):
    _, df = cloud
    options = {"boundary_options": {"nu": 0.1}}
    fitted = det.AnomalyDetector.fit(df, model_type, use_pca=use_pca, **options)
    scored = fitted.transform(df).select("id", "anomaly_score", "prediction", "is_anomaly").collect()
    assert len(scored) == 305
    worst = sorted(scored, key=lambda r: r.anomaly_score)[:5]
    if model_type == det.FACTOR:  # the five are each other's neighbours, trained on themselves
        assert all(np.isfinite(r.anomaly_score) for r in scored)
    else:
        assert {r.id for r in worst} == {300, 301, 302, 303, 304}
    assert all(r.is_anomaly == (r.prediction == -1) for r in scored)


def test_forest_is_the_same_for_every_partitioning(cloud):
    _, df = cloud
    one = IsolationForest.fit(df.repartition(1), trees=10)
    many = IsolationForest.fit(df.repartition(13), trees=10)
    assert one.nodes().equals(many.nodes())


def test_trees_follow_their_draws(cloud):
    """Each inner node splits where the MD5 of seed, tree and node says; children lie at 2n + 1 and 2n + 2."""
    points, df = cloud
    fitted = IsolationForest.fit(df, trees=5, sample_rows=64, seed=3)
    for tree in range(5):
        order = sorted(range(len(points)), key=lambda i: hashlib.md5(f"3-{tree}-{i}".encode()).hexdigest())
        inside = {0: points[order[:64]]}
        for node in range(63):
            if node not in inside or fitted.feature[tree, node] < 0:
                continue
            part = inside[node]
            digest = hashlib.md5(f"3-{tree}-node-{node}".encode()).hexdigest()
            feature = int(digest[24:], 16) % 3
            low, high = part[:, feature].min(), part[:, feature].max()
            assert fitted.feature[tree, node] == feature
            assert fitted.threshold[tree, node] == low + int(digest[:13], 16) / 2**52 * (high - low)
            left = part[:, feature] <= fitted.threshold[tree, node]
            inside[2 * node + 1], inside[2 * node + 2] = part[left], part[~left]
        assert len(inside) > 20 and all(len(part) for part in inside.values())


def test_forest_samples(cloud):
    _, df = cloud
    samples = tree_samples(df, trees=7, rows=64, seed=1, total=305)
    counts = samples.groupBy("tree").agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert [(r.n, r.d) for r in counts] == [(64, 64)] * 7


def test_forest_samples_of_a_large_table(spark):
    df = spark.range(200_000).withColumn("features", F.array(F.col("id").cast("double")))
    samples = tree_samples(df, trees=100, rows=256, seed=42, total=200_000)
    counts = samples.groupBy("tree").count().collect()
    assert len(counts) == 100 and all(r["count"] == 256 for r in counts)


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_packet_outliers(packets, spark):
    """Packets of length 9999 to port 31337 among ordinary ones."""
    odd = {"length": 9999, "dst_port": 31337}
    rows = [(i, i, "10.0.0.1", "10.0.0.2", {"length": 60 + i % 50, "dst_port": 80 + i % 3}) for i in range(95)]
    rows += [(95 + i, 95 + i, "10.0.0.1", "10.0.0.2", odd) for i in range(5)]
    table = packets(rows)
    model = preprocess.fit_preprocessor(table)
    df = preprocess.apply_preprocessor(model, table).withColumnRenamed("packet_id", "id")
    scored = det.AnomalyDetector.fit(df.select("id", "features")).transform(df.select("id", "features"))
    worst = scored.orderBy("anomaly_score").limit(5).collect()
    assert {r.id for r in worst} == {95, 96, 97, 98, 99}


def test_contamination(cloud):
    _, df = cloud
    scored = det.AnomalyDetector.fit(df, contamination=0.1).transform(df)
    assert scored.filter("is_anomaly").count() == 31  # the lowest tenth of 305


def test_fourier_features_approach_the_kernel():
    generator = np.random.default_rng(0)
    points = generator.normal(size=(40, 5))
    exact = np.exp(-0.2 * ((points[:, None] - points[None]) ** 2).sum(-1))
    z = boundary.FourierMap.draw(5, 0.2, features=4096)(points)
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_boundary_share_outside(cloud):
    points, df = cloud
    fitted = boundary.Boundary.fit(df, nu=0.2)
    assert np.mean(fitted.scores(points) < 0) == pytest.approx(0.2, abs=0.01)


def test_boundary_solves_the_dual(cloud):
    """No convex combination within the box has a clearly shorter normal vector."""
    points, df = cloud
    fitted = boundary.Boundary.fit(df, nu=0.5, steps=200)
    z = fitted.fourier(points)
    weights = np.full(len(z), 1 / len(z))
    for step in range(3000):
        margin = z @ (weights @ z)
        order = np.argsort(margin)
        target = np.zeros(len(z))
        target[order[: len(z) // 2]] = 1 / (len(z) // 2)
        weights += 2 / (step + 2) * (target - weights)
    best = np.linalg.norm(weights @ z)
    assert np.linalg.norm(fitted.normal) <= best * 1.05


def brute_factors(train, rows, k, same):
    def knn(points, skip):
        d = np.sqrt(((points[:, None] - train[None]) ** 2).sum(-1))
        if skip:
            np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(d, order, 1)

    order, dist = knn(train, True)
    radius = dist[:, -1]
    lrd = 1 / (np.maximum(dist, radius[order]).mean(1) + 1e-10)
    if same:
        return -(lrd[order].mean(1) / lrd)
    order, dist = knn(rows, False)
    own = 1 / (np.maximum(dist, radius[order]).mean(1) + 1e-10)
    return -(lrd[order].mean(1) / own)


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}])
def test_outlier_factor(spark, cloud, options):
    points, df = cloud
    rows = df.withColumnRenamed("features", "vector")
    fitted = OutlierFactor.fit(rows, k=20, **options)
    found = {r.id: r.raw for r in fitted.known.collect()}
    assert [found[i] for i in range(305)] == pytest.approx(brute_factors(points, None, 20, True), rel=1e-9)
    fresh = points[:50] + 0.5
    new = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(fresh)], "id bigint, vector array<double>"
    )
    scored = {r.id: r.raw for r in fitted.raw_scores(new, **options).collect()}
    assert [scored[i] for i in range(50)] == pytest.approx(brute_factors(points, fresh, 20, False), rel=1e-9)


@pytest.mark.parametrize("model_type", det.MODEL_TYPES)
@pytest.mark.parametrize("use_pca", [True, False])
def test_outliers_have_the_lowest_scores(cloud, model_type, use_pca):
    _, df = cloud
    options = {"boundary_options": {"nu": 0.1}}
    fitted = det.AnomalyDetector.fit(df, model_type, use_pca=use_pca, **options)
    scored = fitted.transform(df).select("id", "anomaly_score", "prediction", "is_anomaly").collect()
    assert len(scored) == 305
    worst = sorted(scored, key=lambda r: r.anomaly_score)[:5]
    if model_type == det.FACTOR:  # the five are each other's neighbours, trained on themselves
        assert all(np.isfinite(r.anomaly_score) for r in scored)
    else:
        assert {r.id for r in worst} == {300, 301, 302, 303, 304}
    assert all(r.is_anomaly == (r.prediction == -1) for r in scored)


def test_forest_is_the_same_for_every_partitioning(cloud):
    _, df = cloud
    one = IsolationForest.fit(df.repartition(1), trees=10)
    many = IsolationForest.fit(df.repartition(13), trees=10)
    assert one.nodes().equals(many.nodes())


def test_forest_samples(cloud):
    _, df = cloud
    samples = tree_samples(df, trees=7, rows=64, seed=1, total=305)
    counts = samples.groupBy("tree").agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert [(r.n, r.d) for r in counts] == [(64, 64)] * 7


def test_forest_samples_of_a_large_table(spark):
    df = spark.range(200_000).withColumn("features", F.array(F.col("id").cast("double")))
    samples = tree_samples(df, trees=100, rows=256, seed=42, total=200_000)
    counts = samples.groupBy("tree").count().collect()
    assert len(counts) == 100 and all(r["count"] == 256 for r in counts)


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_packet_outliers(packets, spark):
    """Packets of length 9999 to port 31337 among ordinary ones."""
    odd = {"length": 9999, "dst_port": 31337}
    rows = [(i, i, "10.0.0.1", "10.0.0.2", {"length": 60 + i % 50, "dst_port": 80 + i % 3}) for i in range(95)]
    rows += [(95 + i, 95 + i, "10.0.0.1", "10.0.0.2", odd) for i in range(5)]
    table = packets(rows)
    model = preprocess.fit_preprocessor(table)
    df = preprocess.apply_preprocessor(model, table).withColumnRenamed("packet_id", "id")
    scored = det.AnomalyDetector.fit(df.select("id", "features")).transform(df.select("id", "features"))
    worst = scored.orderBy("anomaly_score").limit(5).collect()
    assert {r.id for r in worst} == {95, 96, 97, 98, 99}


def test_contamination(cloud):
    _, df = cloud
    scored = det.AnomalyDetector.fit(df, contamination=0.1).transform(df)
    assert scored.filter("is_anomaly").count() == 31  # the lowest tenth of 305


def test_fourier_features_approach_the_kernel():
    generator = np.random.default_rng(0)
    points = generator.normal(size=(40, 5))
    exact = np.exp(-0.2 * ((points[:, None] - points[None]) ** 2).sum(-1))
    z = boundary.FourierMap.draw(5, 0.2, features=4096)(points)
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_boundary_share_outside(cloud):
    points, df = cloud
    fitted = boundary.Boundary.fit(df, nu=0.2)
    assert np.mean(fitted.scores(points) < 0) == pytest.approx(0.2, abs=0.01)


def test_boundary_solves_the_dual(cloud):
    """No convex combination within the box has a clearly shorter normal vector."""
    points, df = cloud
    fitted = boundary.Boundary.fit(df, nu=0.5, steps=200)
    z = fitted.fourier(points)
    weights = np.full(len(z), 1 / len(z))
    for step in range(3000):
        margin = z @ (weights @ z)
        order = np.argsort(margin)
        target = np.zeros(len(z))
        target[order[: len(z) // 2]] = 1 / (len(z) // 2)
        weights += 2 / (step + 2) * (target - weights)
    best = np.linalg.norm(weights @ z)
    assert np.linalg.norm(fitted.normal) <= best * 1.05


def brute_factors(train, rows, k, same):
    def knn(points, skip):
        d = np.sqrt(((points[:, None] - train[None]) ** 2).sum(-1))
        if skip:
            np.fill_diagonal(d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(d, order, 1)

    order, dist = knn(train, True)
    radius = dist[:, -1]
    lrd = 1 / (np.maximum(dist, radius[order]).mean(1) + 1e-10)
    if same:
        return -(lrd[order].mean(1) / lrd)
    order, dist = knn(rows, False)
    own = 1 / (np.maximum(dist, radius[order]).mean(1) + 1e-10)
    return -(lrd[order].mean(1) / own)


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}])
def test_outlier_factor(spark, cloud, options):
    points, df = cloud
    rows = df.withColumnRenamed("features", "vector")
    fitted = OutlierFactor.fit(rows, k=20, **options)
    found = {r.id: r.raw for r in fitted.known.collect()}
    assert [found[i] for i in range(305)] == pytest.approx(brute_factors(points, None, 20, True), rel=1e-9)
    fresh = points[:50] + 0.5
    new = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(fresh)], "id bigint, vector array<double>"
    )
    scored = {r.id: r.raw for r in fitted.raw_scores(new, **options).collect()}
    assert [scored[i] for i in range(50)] == pytest.approx(brute_factors(points, fresh, 20, False), rel=1e-9)


def test_blocks_agree_with_broadcast(spark):
    """Ties included: many equal rows on both sides."""
    generator = np.random.default_rng(1)
    points = generator.integers(0, 3, size=(120, 2)).astype(float)
    df = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, vector array<double>"
    )
    options = {"k": 7, "score": nearest.negative_distances, "skip_self": True}
    whole = {r.id: r.best for r in nearest.top_k(df, df, **options).collect()}
    parts = {
        r.id: r.best
        for r in nearest.top_k(df, df, max_broadcast_bytes=1, block_rows=17, **options).collect()
    }
    assert whole == parts and len(whole) == 120


def test_nothing_to_compare_with(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, vector array<double>")
    none = df.filter("id < 0")
    best = nearest.top_k(df, none, k=1, score=nearest.cosine_scores).collect()
    assert [r.best for r in best] == [[]]


@pytest.mark.parametrize("model_type", det.MODEL_TYPES)
def test_save_and_load(spark, cloud, tmp_path, model_type):
    _, df = cloud
    fitted = det.AnomalyDetector.fit(df, model_type)
    fitted.save(spark, str(tmp_path / "model"))
    loaded = det.AnomalyDetector.load(spark, str(tmp_path / "model"))
    before = fitted.transform(df).orderBy("id").select("anomaly_score", "prediction").collect()
    after = loaded.transform(df).orderBy("id").select("anomaly_score", "prediction").collect()
    assert [r.prediction for r in before] == [r.prediction for r in after]
    assert [r.anomaly_score for r in before] == pytest.approx([r.anomaly_score for r in after])


def test_unknown_model(cloud):
    with pytest.raises(ValueError):
        det.AnomalyDetector.fit(cloud[1], "other")


def test_split_is_stable(spark):
    df = spark.range(2000)
    train, test = det.hash_split(df)
    again = {r.id for r in det.hash_split(df.repartition(11))[1].collect()}
    assert {r.id for r in test.collect()} == again
    assert train.count() + test.count() == 2000 and 300 < len(again) < 500


def test_scaler_keeps_constant_columns(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    scaler = preprocess.Scaler.fit(df)
    scaled = [r.z for r in df.select(scaler.column(F.col("features")).alias("z")).collect()]
    assert scaled == [[-1.0, 0.0], [1.0, 0.0]]


def test_preprocessor_on_new_data(packets):
    known = packets([(1, 1, "a", "b", {"protocol": "TCP"}), (2, 2, "a", "b", {"protocol": None, "ttl": None})])
    model = preprocess.fit_preprocessor(known, numeric=["ttl"], categorical=["protocol"])
    fresh = packets([(3, 3, "a", "b", {"protocol": "GRE"}), (4, 4, "a", "b", {"protocol": None})])
    rows = preprocess.apply_preprocessor(model, fresh).orderBy("packet_id").collect()
    assert [r.features for r in rows] == [[0.0, 0.0, 0.0], [0.0, 0.0, 1.0]]  # TCP, unknown


def test_projection_matches_svd(cloud):
    points, df = cloud
    fitted = reduce.Projection.fit(df, k=2)
    centred = points - points.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.abs(np.sum(np.array(fitted.components) * vt[:2], axis=1)) == pytest.approx([1, 1])
    assert fitted.explained == pytest.approx((s**2 / (s**2).sum())[:2].tolist())


def test_variance_keeps_the_fewest_components(spark):
    generator = np.random.default_rng(2)
    base = generator.normal(size=(200, 1))
    points = np.hstack([base, base * 2, generator.normal(size=(200, 1)) * 0.01])
    df = spark.createDataFrame([([float(x) for x in p],) for p in points], "features array<double>")
    assert len(reduce.Projection.fit(df, variance=0.95).components) == 1


def test_selection_needs_two_classes(spark):
    df = spark.createDataFrame([([1.0], 1), ([2.0], 1)], "features array<double>, label int")
    with pytest.raises(ValueError):
        reduce.select_k_best(df, 1)


def test_selection_finds_the_separating_feature(spark):
    rows = [([float(i % 5), float(10 * (i % 2)) + i / 100, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    positions, reduced = reduce.select_k_best(df, 1)
    assert positions == [1] and len(reduced.first().features) == 1


def test_sequences_flag_the_odd_run(packets):
    rows = [(i, i, "h", "d", {"length": 100 + i % 3, "dst_port": 80}) for i in range(200)]
    rows[150] = (150, 150, "h", "d", {"length": 9000, "dst_port": 31337})
    rows += [(500 + i, i, "short", "d") for i in range(4)]
    table = packets(rows)
    fitted = SequenceDetector.fit(table, ["length", "dst_port"], encoding=2)
    found = {r.packet_id: r for r in fitted.transform(table).collect()}
    assert len(found) == 204
    assert all(found[i].anomaly_score == 0.0 and found[i].prediction == 1 for i in [*range(9), 500, 503])
    _, judged = SequenceDetector.fit_transform(table, ["length", "dst_port"], encoding=2)
    assert {r.packet_id: r for r in judged.collect()} == found
    flagged = {i for i, r in found.items() if r.prediction == -1}
    assert flagged and flagged <= set(range(9, 200))
    assert len(flagged) == 10  # 5 % of 191 runs lie above the 95th percentile


def test_constants_are_never_selected(spark):
    """Rounding of sums must not make a constant look infinitely far apart."""
    constants = [0.1, 0.3, 0.7, 1.1, 2.3, 0.001, 123.456, 5.0]
    rows = [(i % 3, [*constants, (i % 3) * 10.0 + (i % 7) * 0.1, float(i % 2), float(i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "label int, features array<double>")
    found = {r.position: r.f_value for r in reduce.f_statistics(df).collect()}
    assert all(found[k] is None for k in range(len(constants)))
    assert found[10] == float("inf") and found[8] > 1000 > found[9] >= 0
    positions, _ = reduce.select_k_best(df, 2)
    assert positions == [8, 10]
    assert reduce.select_k_best(df, 9)[0] == [8, 9, 10]
