"""Rows that used to be lost, plans that one key used to decide, and searches that grew with the columns."""

import numpy as np
from pyspark.sql import functions as F

from netspark.ml import preprocess, reduce
from netspark.operators import alerts as al
from netspark.operators import ordering, volume


def test_alerts_without_time_are_sent_first(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, None)], "alert_id long, timestamp double")
    batches = al.outbound_batches(df, F.struct("alert_id"), batch_size=3).collect()
    assert {b.batch_id: b.alert_ids for b in batches} == {0: [2, 4, 3], 1: [1]}


def test_running_sums_keep_null_keys_and_times(spark):
    rows = [(k, t, i, 1) for i, (k, t) in enumerate([("a", 1.0), ("a", None), (None, 2.0), (None, None), ("a", 99.0)])]
    df = spark.createDataFrame(rows, "k string, t double, id long, n long")
    for options in ({}, {"max_bucket_rows": 1}):
        found = ordering.with_running_sums(df, ["k"], "t", ["n"], tie="id", **options).collect()
        assert {r.id: r.n_total for r in found} == {0: 2, 1: 1, 2: 2, 3: 1, 4: 3}


def test_only_the_full_slot_is_cut(spark):
    rows = [("hot", 5.0, i) for i in range(200)] + [(f"k{i}", float(i), 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t double, id long")
    parts = ordering.with_buckets(df, ["k"], "t", "id", max_bucket_rows=40)
    found = {r.k: r.parts for r in parts.groupBy("k").agg(F.max("_bucket.part").alias("parts")).collect()}
    assert found.pop("hot") > 2 and set(found.values()) == {0}
    ranked = ordering.with_rank(df, ["k"], "t", "r", tie="id", max_bucket_rows=40).collect()
    assert sorted(r.r for r in ranked if r.k == "hot") == list(range(1, 201))
    assert all(r.r == r.id + 1 for r in ranked if r.k == "hot")


def test_a_separating_feature_is_best(spark):
    rows = [([float(i % 2), float(i % 3), 7.0], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    positions, _ = reduce.select_k_best(df, 1)
    assert positions == [0]
    found = {r.position: r.f_value for r in reduce.f_statistics(df).collect()}
    assert found[0] == float("inf") and found[2] is None


def test_volume_with_a_stray_time(spark):
    df = spark.createDataFrame([(0.0,), (60_000_000.0,)], "timestamp double")
    row = volume.traffic_volume(df, seconds=5).agg(F.count(F.lit(1)), F.sum("packet_count"), F.max("bin_start")).first()
    assert tuple(row) == (12_000_001, 2, 60_000_000.0)


def test_volume_below_a_second(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (1.6,)], "timestamp double")
    found = volume.traffic_volume(df, seconds=0.5).orderBy("bin_start").collect()
    assert [tuple(r) for r in found] == [(0.0, 2), (0.5, 0), (1.0, 0), (1.5, 1)]


def test_quantiles_of_many_columns_take_the_same_jobs(spark):
    random = np.random.default_rng(4)
    values = random.normal(size=(3000, 6)).round(2)
    values[:, 1] = 3.0
    df = spark.createDataFrame(values.tolist(), [f"c{k}" for k in range(6)]).cache()
    df.count()

    def jobs(columns):
        tracker, group = spark.sparkContext.statusTracker(), f"quantiles-{len(columns)}"
        spark.sparkContext.setJobGroup(group, "")
        named = {c: F.col(c) for c in columns}
        found = ordering.exact_quantile_table(df, named, [0.0, 0.25, 0.5, 1.0], exact_rows=20)
        spark.sparkContext.setJobGroup("", "")
        for k, c in enumerate(columns):
            assert np.allclose(found[c], np.quantile(values[:, k], [0.0, 0.25, 0.5, 1.0]))
        return len(tracker.getJobIdsForGroup(group))

    assert jobs([f"c{k}" for k in range(6)]) <= jobs(["c0"]) + 4


def test_hashed_categories(spark):
    df = spark.createDataFrame([(i, f"value{i}") for i in range(200)], "length int, word string")
    model = preprocess.fit_preprocessor(df, numeric=["length"], categorical=["word"], hashed=16)
    rows = preprocess.apply_preprocessor(model, df).collect()
    assert all(len(r.features) == 17 and sum(r.features[1:]) == 1 for r in rows)


def test_closeness_from_pivots(spark):
    from netspark.operators import graph

    edges = [(f"n{i}", f"n{(i + step) % 12}", 1) for i in range(12) for step in (1, 5)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    exact = {r.ip: r.closeness for r in graph.closeness(df).collect()}
    all_pivots = {r.ip: r.closeness for r in graph.closeness(df, pivots=12).collect()}
    some = {r.ip: r.closeness for r in graph.closeness(df, pivots=6).collect()}
    assert exact == all_pivots and set(some) == set(exact)
    assert all(abs(some[k] - exact[k]) < 0.25 for k in exact)
