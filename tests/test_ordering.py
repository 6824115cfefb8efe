"""Order-dependent helpers against pandas, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from netspark.operators import ordering


def skewed(rows=600, seed=3):
    generator = np.random.default_rng(seed)
    keys = np.where(generator.random(rows) < 0.34, "hot", generator.integers(0, 9, rows).astype(str))
    frame = pd.DataFrame(
        {
            "packet_id": np.arange(rows),
            "key": keys,
            "timestamp": generator.integers(0, 900, rows) / 4.0,
            "v": generator.integers(0, 50, rows),
        }
    )
    frame.loc[generator.random(rows) < 0.05, "key"] = None
    return frame


@pytest.mark.parametrize("bucket, fullest", [(0.5, 10**6), (60.0, 10**6), (1e6, 10**6), (60.0, 7)])
@pytest.mark.parametrize("partitions", [1, 16])
def test_previous(spark, bucket, fullest, partitions):
    frame = skewed()
    df = spark.createDataFrame(frame, "packet_id bigint, key string, timestamp double, v bigint")
    found = ordering.with_previous(
        df.repartition(partitions),
        "key",
        "timestamp",
        "prev",
        bucket_seconds=bucket,
        max_bucket_rows=fullest,
    ).toPandas()
    ordered = frame.sort_values(["timestamp", "packet_id"])
    expected = ordered.groupby("key")["timestamp"].shift(1)
    merged = found.set_index("packet_id")["prev"].sort_index()
    pd.testing.assert_series_equal(
        merged, expected.sort_index(), check_names=False, check_index_type=False
    )


@pytest.mark.parametrize("bucket, fullest", [(0.5, 10**6), (60.0, 10**6), (1e6, 10**6), (60.0, 7)])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_rank(spark, bucket, fullest, keys):
    frame = skewed().dropna()
    df = spark.createDataFrame(frame, "packet_id bigint, key string, timestamp double, v bigint")
    found = ordering.with_rank(
        df, keys, "timestamp", "r", tie="packet_id", bucket_seconds=bucket, max_bucket_rows=fullest
    ).toPandas().set_index("packet_id")["r"].sort_index()
    ordered = frame.sort_values(["timestamp", "packet_id"])
    rank = (ordered.groupby("key").cumcount() if keys else pd.Series(range(len(ordered)), ordered.index)) + 1
    assert found.tolist() == rank.sort_index().tolist()


@pytest.mark.parametrize("bucket, fullest", [(0.5, 10**6), (60.0, 10**6), (60.0, 7)])
def test_gaps(spark, bucket, fullest):
    frame = skewed()
    df = spark.createDataFrame(frame, "packet_id bigint, key string, timestamp double, v bigint")
    found = ordering.gaps(df, "key", "timestamp", bucket_seconds=bucket, max_bucket_rows=fullest)
    ordered = frame.dropna().sort_values(["timestamp", "packet_id"])
    expected = ordered.assign(gap=ordered.groupby("key")["timestamp"].diff())[["key", "gap"]]
    as_text = lambda table: sorted(map(str, table.itertuples(index=False, name=None)))
    assert as_text(found.toPandas()) == as_text(expected)


@pytest.mark.parametrize("chunk, fullest", [(5, 10**6), (16, 10**6), (4096, 10**6), (16, 9)])
def test_history(spark, chunk, fullest):
    frame = skewed().dropna()
    df = spark.createDataFrame(frame, "packet_id bigint, key string, timestamp double, v bigint")
    found = ordering.with_history(
        df, ["key"], "timestamp", ["v"], 5, "h", tie="packet_id", chunk_rows=chunk, max_bucket_rows=fullest
    ).collect()
    assert len(found) == len(frame)
    ordered = frame.sort_values(["timestamp", "packet_id"])
    expected = {}
    for _, group in ordered.groupby("key"):
        values, ids = group["v"].tolist(), group["packet_id"].tolist()
        for i, packet in enumerate(ids):
            expected[packet] = values[max(0, i - 4) : i + 1]
    assert {row.packet_id: [x.v for x in row.h] for row in found} == expected


def test_one_instant_is_split(spark):
    """All rows of one key at one time still end up in several small groups."""
    df = spark.range(1000).selectExpr("id AS packet_id", "'k' AS key", "5.0D AS timestamp")
    bucketed = ordering.with_buckets(df, ["key"], "timestamp", "packet_id", max_bucket_rows=100)
    sizes = [r["count"] for r in bucketed.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 150
    ranked = ordering.with_rank(df, ["key"], "timestamp", "r", tie="packet_id", max_bucket_rows=100)
    assert all(r.r == r.packet_id + 1 for r in ranked.collect())


def test_history_needs_room(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1)], "packet_id bigint, key string, timestamp double, v bigint")
    with pytest.raises(ValueError):
        ordering.with_history(df, ["key"], "timestamp", ["v"], 5, "h", tie="packet_id", chunk_rows=4)


@pytest.mark.parametrize("fullest", [10**6, 9])
def test_running_sums(spark, fullest):
    frame = skewed().dropna()
    df = spark.createDataFrame(frame, "packet_id bigint, key string, timestamp double, v bigint")
    found = ordering.with_running_sums(
        df, ["key"], "timestamp", ["v"], tie="packet_id", bucket_seconds=7, max_bucket_rows=fullest
    ).toPandas().set_index("packet_id")["v_total"].sort_index()
    expected = frame.sort_values(["timestamp", "packet_id"]).groupby("key")["v"].cumsum()
    assert found.tolist() == expected.sort_index().tolist()


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.integers(-5, 5) | st.floats(-1e3, 1e3), min_size=1, max_size=60),
    quantile=st.floats(0, 1),
)
def test_quantile_by_selection(spark, values, quantile):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = ordering.exact_quantiles(df, "v", [quantile], exact_rows=3)[0]
    assert found == pytest.approx(np.quantile(np.array(values, float), quantile), rel=1e-9, abs=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ordering.exact_quantiles(df, "v", [0.5, 0.9]) == [None, None]


def test_medians(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (4, 7.0)], "a int, b double")
    assert ordering.exact_column_quantiles(df, ["a", "b"], 0.5) == {"a": 2.0, "b": 6.0}
    assert ordering.exact_column_quantiles(df, ["a", "b"], 0.5, exact_rows=1) == {"a": 2.0, "b": 6.0}
