"""Feature selection from a packet table: numeric columns, dummies, vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that identify or label a packet and are never features.
NOT_FEATURES = ["packet_id", "timestamp", "src_ip", "dst_ip", "attack_type", "label"]
_NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def numeric_columns(df: DataFrame, *, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    left_out = set(exclude)
    return [name for name, kind in df.dtypes if kind in _NUMERIC and name not in left_out]


def numeric_features(df: DataFrame, *, keep: Iterable[str] = ("packet_id",)) -> DataFrame:
    """Numeric feature columns with null as 0.

    With fewer than two of them, the length and its share of the longest packet are used.
    """
    names = numeric_columns(df)
    if len(names) >= 2:
        return df.select(*keep, *names).fillna(0, subset=names)
    longest = df.agg(F.max("length")).scalar()
    length = F.coalesce("length", F.lit(0))
    share = F.coalesce(F.try_divide(length, longest), F.lit(0.0))
    return df.select(*keep, length.alias("length"), share.alias("normalized_length"))


def dummy_columns(name: str, values: Iterable[str]) -> dict[str, Column]:
    """One 0/1 column per known value; a value outside the list is 0 everywhere."""
    column = F.col(name)
    return {f"{name}_{v}": F.coalesce((column == v).cast("int"), F.lit(0)) for v in values}


#: String values of all columns together that become dummies; reductions work on dense rows.
MAX_DUMMIES = 2000


def encoded_columns(df: DataFrame, *, exclude: Iterable[str] = NOT_FEATURES) -> dict[str, Column]:
    """Numbers, truth values as 0 and 1, and a dummy for each value of each string column (null: 0 everywhere).

    Dummies are in the order of their values. More than ``MAX_DUMMIES`` values are an error: such columns want
    the dictionary of :mod:`netspark.ml.dictionary` and sparse rows.
    """
    left_out = set(exclude)
    names = numeric_columns(df, exclude=left_out)
    columns = {name: F.col(name) for name in names}
    columns |= {n: F.col(n).cast("int") for n, kind in df.dtypes if kind == "boolean" and n not in left_out}
    texts = [n for n, kind in df.dtypes if kind == "string" and n not in left_out]
    if not texts:
        return columns
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in texts])))
    known = pairs.select("col.*").filter(F.col("value").isNotNull()).distinct().limit(MAX_DUMMIES + 1).collect()
    if len(known) > MAX_DUMMIES:
        raise ValueError(f"more than {MAX_DUMMIES} values in {texts}")
    for name in texts:
        columns |= dummy_columns(name, sorted(row.value for row in known if row.name == name))
    return columns


def feature_array(names: Iterable[str]) -> Column:
    """array<double> of the columns, null as 0 and NaN as 0."""
    zero = F.lit(0.0)
    return F.array(*[F.coalesce(F.nanvl(F.col(n).cast("double"), zero), zero) for n in names])
