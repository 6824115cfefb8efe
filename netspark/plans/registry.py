"""Registry of named queries, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.plans import fixtures

#: Digits of floating-point results that two engines are compared on.
DIGITS = 6

Build = Callable[["Inputs"], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """Where a query reads from."""

    spark: SparkSession
    sf_dir: str

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        return fixtures.run(self.spark, self.sf_dir, text)


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None
    floats: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Inputs(spark, sf_dir))
        return df.withColumns({c: F.round(F.col(c), DIGITS) for c in self.floats})

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        sql = fixtures.with_views(self.oracle)
        if not self.floats:
            return sql
        rounded = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in self.floats)
        return f"SELECT * REPLACE ({rounded}) FROM ({sql}) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, *, oracle: str | None = None, floats: str = "") -> Callable[[Build], Build]:
    """Register a query; ``floats`` names the columns that are compared rounded."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = Query(name, build, oracle, tuple(floats.split()))
        return build

    return register
