"""Every registered query against its oracle SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_by_name(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    described = oracle.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    expected = oracle.execute(ORACLES[name]).fetchall()
    names = [d[0] for d in described]
    assert sorted(df.columns) == sorted(names)
    assert {d[0]: TYPES.get(d[1], d[1]) for d in described} == dict(df.dtypes)
    assert rows_by_name(df.collect(), df.columns) == rows_by_name(expected, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
