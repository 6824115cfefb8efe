"""Categories of any number as positions of a sparse row, without a list of them in one place.

The distinct values of all columns are range partitioned by (column, value); a value's position is its rank in
its range plus the values of the ranges before, so only one count per range and column is windowed over a column.
The dictionary stays a table, which rows are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.ml.preprocess import UNKNOWN
from netspark.session import cut_lineage


@dataclass(frozen=True)
class CategoryDictionary:
    """``table`` has column, value and place, from 0 in alphabetical order for each column; null is ``unknown``.

    ``sizes`` has the number of values of each column, ``columns`` in the order of their blocks of positions.
    """

    columns: list[str]
    table: DataFrame
    sizes: dict[str, int]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], *, ranges: int | None = None) -> CategoryDictionary:
        """All values of ``columns``; ``ranges`` is the number of partitions that share them."""
        cells = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias("value"))
                for c in columns
            ]
        )
        values = df.select(F.inline(cells)).distinct()
        keys = ["column", "value"]
        ranged = values.repartitionByRange(*keys) if ranges is None else values.repartitionByRange(ranges, *keys)
        # The range number is fixed data from here on.
        stored = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = stored.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"))
        offsets = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        inside = Window.partitionBy("column", "part").orderBy("value")
        placed = stored.withColumn("at", F.row_number().over(inside)).join(F.broadcast(offsets), ["column", "part"])
        table = cut_lineage(placed.select("column", "value", (F.col("first") + F.col("at") - 1).alias("place")))
        found = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        return CategoryDictionary(list(columns), table, {c: found.get(c, 0) for c in columns})

    @property
    def width(self) -> int:
        """Positions of all columns together."""
        return sum(self.sizes.values())

    def positions(self, df: DataFrame, output: str = "positions") -> DataFrame:
        """Add the ascending positions of a row's values (array<bigint>): what is 1 in its one-hot row.

        A value that was not fitted has none.
        """
        result, found, offset = df, [], 0
        for i, column in enumerate(self.columns):
            own = self.table.filter(F.col("column") == column).select(
                F.col("value").alias(f"_v{i}"), (F.col("place") + offset).alias(f"_p{i}")
            )
            value = F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))
            result = result.join(own, value == F.col(f"_v{i}"), "left").drop(f"_v{i}")
            found.append(F.col(f"_p{i}"))
            offset += self.sizes[column]
        return result.withColumn(output, F.array_compact(F.array(*found))).drop(*[f"_p{i}" for i in range(len(found))])

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, columns: list[str]) -> CategoryDictionary:
        table = spark.read.parquet(path)
        found = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}
        return CategoryDictionary(list(columns), table, {c: found.get(c, 0) for c in columns})
