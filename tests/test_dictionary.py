"""Categories without a list."""

from pyspark.sql import functions as F

from netspark.ml.dictionary import CategoryDictionary


def test_positions_are_ranks(spark, tmp_path):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "b", "x"), (5, "ä", "")]
    df = spark.createDataFrame(rows, "id long, first string, second string").repartition(3)
    fitted = CategoryDictionary.fit(df, ["first", "second"], ranges=3)
    assert fitted.sizes == {"first": 4, "second": 4} and fitted.width == 8
    first, second = sorted({r[1] or "unknown" for r in rows}), sorted({"unknown" if r[2] is None else r[2] for r in rows})
    expected = {
        r[0]: [first.index(r[1] or "unknown"), 4 + second.index("unknown" if r[2] is None else r[2])] for r in rows
    }
    assert {r.id: r.positions for r in fitted.positions(df).collect()} == expected
    fitted.save(str(tmp_path / "d"))
    loaded = CategoryDictionary.load(spark, str(tmp_path / "d"), ["first", "second"])
    new = spark.createDataFrame([(1, "b", "never seen"), (2, "nor this", None)], df.schema)
    assert {r.id: r.positions for r in loaded.positions(new).collect()} == {1: [1], 2: [4 + second.index("unknown")]}


def test_a_million_values_stay_distributed(spark, monkeypatch):
    """Nothing but a count per column reaches the driver."""
    collected = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: collected.append(collect(df)) or collected[-1])
    df = spark.range(1_000_000, numPartitions=8).select(
        F.sha1(F.col("id").cast("string")).alias("value"), F.when(F.col("id") % 3 > 0, "hot").alias("other")
    )
    fitted = CategoryDictionary.fit(df, ["value", "other"], ranges=8)
    assert fitted.sizes == {"value": 1_000_000, "other": 2}
    assert sum(map(len, collected)) == 2
    found = fitted.table.filter("column = 'value'").agg(
        F.count_distinct("place"), F.min("place"), F.max("place"), F.max_by("value", "place"), F.max("value")
    ).first()
    assert found[:3] == (1_000_000, 0, 999_999) and found[3] == found[4]


def test_no_rows(spark):
    df = spark.createDataFrame([], "a string")
    fitted = CategoryDictionary.fit(df, ["a"])
    assert fitted.width == 0 and fitted.positions(df).count() == 0
