import random

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def words(seed: int, count: int) -> list[str]:
    random.seed(seed)
    return ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(count)]


def text(seed: int, count: int) -> str:
    return " ".join(words(seed, count)) + "."


LONG = text(99, 60_000)
#: doc_id, text: ids and texts that are null or empty, repeats, copies, a very long text.
ODD = [
    (1, text(1, 120)),
    (2, text(1, 120)),
    (2, text(1, 120)),
    (None, text(1, 120)),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, None),
    (6, LONG),
    (7, "word"),
    (8, "é 日本語 🙂 ..."),
    (9, "x" * 5000),
    (10, "in " * 500),
]
#: Names that helpers of some operator use or that a result has.
CLASHING = ["row_key", "score", "shard", "slot", "key", "rank", "cid", "group", "n", "license", "_row_key", "start"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}
        | {name: F.lit("mine") for name in CLASHING}
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
