"""Readers for packet, feature, intelligence and record files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark import schemas

_RUN = re.compile(r"/run_id=([^/]+)/")


def read_packets_csv(
    spark: SparkSession, path: str, *, schema: T.StructType = schemas.PACKETS
) -> DataFrame:
    """Packets from CSV with a header, in the columns of the explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def latest_run(spark: SparkSession, base: str) -> str:
    """Path of the newest ``run_id=`` folder. Only file names are listed, nothing is read."""
    files = spark.read.format("text").load(base).inputFiles()
    runs = {found.group(1) for name in files if (found := _RUN.search(name))}
    if not runs:
        raise FileNotFoundError(f"no run_id= folder below {base}")
    return f"{base.rstrip('/')}/run_id={max(runs)}"


def latest_file(spark: SparkSession, base: str) -> str:
    """The lexicographically last file of a folder whose names start with a time stamp."""
    return max(spark.read.format("text").load(base).inputFiles())


def read_latest_packets_csv(spark: SparkSession, base: str) -> DataFrame:
    return read_packets_csv(spark, latest_run(spark, base))


def read_processed_pair(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(enriched packets, flows) of the newest processing run."""
    run = latest_run(spark, base)
    return spark.read.parquet(f"{run}/enriched"), spark.read.parquet(f"{run}/flows")


def read_features_labels(
    spark: SparkSession, features_path: str, labels_path: str | None = None, *, key: str = "id"
) -> DataFrame:
    """Feature arrays with labels joined by id, null where a row has none.

    The label is the column ``label``, or else the first column besides the key.
    """
    features = spark.read.parquet(features_path)
    if labels_path is None:
        return features
    labels = spark.read.parquet(labels_path)
    names = [c for c in labels.columns if c != key]
    name = "label" if "label" in names else names[0]
    return features.join(labels.select(key, F.col(name).alias("label")), key, "left")


def records_from_json(body: Column, columns: list[str]) -> Column:
    """A request body (one object, a list of objects or a list of lists) as an array of structs."""
    fields = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    text = F.trim(body)
    objects = F.from_json(text, T.ArrayType(fields))
    single = F.array(F.from_json(text, fields))
    lists = F.transform(
        F.from_json(text, T.ArrayType(T.ArrayType(T.DoubleType()))),
        lambda row: F.struct(*[F.get(row, F.lit(i)).alias(c) for i, c in enumerate(columns)]),
    )
    return (
        F.when(text.rlike(r"^\[\s*\["), lists).when(text.rlike(r"^\["), objects).otherwise(single)
    )


def read_records_json(requests: DataFrame, columns: list[str], *, body: str = "body") -> DataFrame:
    """One row per record of every request, with its position in the request."""
    keep = [c for c in requests.columns if c != body]
    records = records_from_json(F.col(body), columns)
    return requests.select(*keep, F.posexplode(records).alias("position", "_r")).select(
        *keep, "position", "_r.*"
    )


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """One address per line; blanks and ``#`` comments are skipped, repeats removed."""
    line = F.trim(F.col("value"))
    return (
        spark.read.text(path)
        .select(line.alias("ip"))
        .filter((F.col("ip") != "") & ~F.col("ip").startswith("#"))
        .distinct()
    )


def read_threat_db(spark: SparkSession, path: str | None) -> DataFrame:
    """Indicator table from CSV; an empty table of the same schema when there is none."""
    if path is not None:
        try:
            return (
                spark.read.schema(schemas.THREAT_DB)
                .option("header", True)
                .option("multiLine", True)
                .option("escape", '"')
                .csv(path)
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schemas.THREAT_DB)


def read_reputation_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Raw provider documents as (ip, provider, collected_at, body) JSON lines."""
    return spark.read.schema(schemas.REPUTATION_FEED).json(path)


def read_packet_stream(
    spark: SparkSession, path: str, *, files_per_trigger: int | None = None
) -> DataFrame:
    """Packet files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schemas.PACKETS).option("header", True)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)
