"""A corpus pipeline of the llm operators, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm import chunks, forest_join, packing, quality, templates
from netspark.llm.queries import END_ID, TOKENIZER
from netspark.llm.workers import free_name, table
from netspark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from ``labels``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learnable())
    score = free_name(docs, "score")
    return quality.with_scores(docs, model, output=score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return forest_join.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id keeps."""
    return chunks.without_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of ``benchmark``."""
    return templates.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, TOKENIZER, END_ID, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_group),
    ("substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenize, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
