"""Small helpers of the functions that run in Python workers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netspark.session import configure

#: Rows that travel to a worker at once; long texts make a batch of 1,000 rows some MB.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of this package: small Arrow batches, so that long texts fit a worker."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """An object that outlives its task, such as a tokenizer with its word cache.

    Functions that travel by value get new globals with each task, so it is kept in a module of its own. A
    worker process serves one operator after the other; only the state that was asked for last is kept.
    """
    holder = sys.modules.setdefault("netspark_worker_state", types.ModuleType("netspark_worker_state"))
    known = getattr(holder, "state", None)
    if known is None or known[0] != name:
        holder.state = known = None
        holder.state = known = (name, make())
    return known[1]


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column without nulls as numpy values."""
    values = batch.column(name)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal integer keys, each with the places where its runs begin and end.

    The rows come sorted by the keys; a run that goes on in the next batch waits for it.
    """
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = np.stack([column(batch, k).astype(np.int64) for k in keys])
        if last is not None and (values == last[:, None]).all():
            waiting.append(batch)
            continue
        change = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        cut = int(change[-1]) if len(change) else 0
        head = [*waiting, *([batch.slice(0, cut)] if cut else [])]
        if head:
            yield _with_bounds(pa.Table.from_batches(head), keys)
        waiting, last = [batch.slice(cut)], values[:, -1]
    if waiting:
        yield _with_bounds(pa.Table.from_batches(waiting), keys)


def _with_bounds(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    values = np.stack([column(table, k).astype(np.int64) for k in keys])
    change = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
    return table.combine_chunks(), np.concatenate(([0], change, [table.num_rows]))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
