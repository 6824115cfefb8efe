"""Nearest rows in time against brute force."""

import random

import pytest

from netspark.operators import asof


def by_hand(left, right, direction, tolerance):
    out = []
    for i, key, t in left:
        near = []
        if key is not None and t is not None:
            near = [(abs(t - u), u, j) for j, k, u in right if k == key and u is not None]
            near = [x for x in near if direction == "nearest" or (x[1] <= t if direction == "backward" else x[1] >= t)]
        best = min(near, default=None)
        if best is None or (tolerance is not None and best[0] > tolerance):
            best = (None, None, None)
        out.append((i, key, t, best[2], best[1]))
    return sorted(out)


def series(seed, n, first):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None, "one side " + str(seed)]
    return [
        (first + i, draw.choice(keys), None if draw.random() < 0.05 else draw.choice([1, 3, 400]) * draw.randint(0, 60) / 2)
        for i in range(n)
    ]


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("tolerance, options", [(None, {}), (5.0, {"bucket_seconds": 7, "max_bucket_rows": 9})])
def test_equals_brute_force(spark, direction, tolerance, options):
    """Ties in both series, equal distances, long gaps without rows, buckets that are too full."""
    left, right = series(1, 150, 0), series(2, 120, 1000)
    rows = lambda some, names: spark.createDataFrame(some, names).repartition(3)
    found = asof.nearest_in_time(
        rows(left, "i long, key string, time double"),
        rows(right, "j long, k string, at double").withColumnRenamed("k", "key"),
        left_id="i", right_id="j", left_time="time", right_time="at", keys=["key"],
        direction=direction, tolerance=tolerance, **options,
    )
    assert found.columns == ["i", "key", "time", "match_id", "match_time"]
    assert sorted(map(tuple, found.collect())) == by_hand(left, right, direction, tolerance)


def test_without_keys_and_without_rows(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None)], "i long, timestamp double")
    right = spark.createDataFrame([(7, 1.0), (8, 4.0)], "j long, timestamp double")
    found = asof.nearest_in_time(left, right, left_id="i", right_id="j")
    assert sorted((r.i, r.match_id) for r in found.collect()) == [(1, 7), (2, 7), (3, None)]
    none = asof.nearest_in_time(left, right.where("false"), left_id="i", right_id="j")
    assert sorted((r.i, r.match_id) for r in none.collect()) == [(1, None), (2, None), (3, None)]
    assert asof.nearest_in_time(left.where("false"), right, left_id="i", right_id="j").count() == 0
    with pytest.raises(ValueError):
        asof.nearest_in_time(left, right, left_id="i", right_id="j", direction="up")


def test_no_window_reaches_to_the_end(spark):
    """Such a frame is read anew for each row: a key with many buckets, or a full one, took time squared."""
    left = spark.createDataFrame([(1, "a", 1.0)], "i long, key string, timestamp double")
    found = asof.nearest_in_time(left, left.withColumnRenamed("i", "j"), left_id="i", right_id="j", keys=["key"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_many_times_of_one_key(spark):
    """More rows in one bucket, and more buckets of one key, than a square of them allows."""
    right = spark.range(0, 120_000).selectExpr("id AS j", "'a' AS key", "id * 1.0D AS timestamp")
    left = spark.range(0, 120_000).selectExpr("id AS i", "'a' AS key", "id + 0.75D AS timestamp")
    for seconds in (1.0, 1e9):
        found = asof.nearest_in_time(left, right, left_id="i", right_id="j", keys=["key"], bucket_seconds=seconds)
        wrong = found.filter("match_id <> least(i + 1, 119999)")
        assert (found.count(), wrong.count()) == (120_000, 0)
