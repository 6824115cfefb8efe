"""Gaps between a source's packets, live: a stateful operator per (source, time slot).

A slot holds the times of its packets until the watermark passes its end; then a timer puts out one summary row
and frees the state. So rows may come in any order within the watermark's delay, a busy source is spread over its
slots, untouched sources are neither read nor written, and nothing stays of a source that has fallen silent.
A summary carries its edges, the first and last time, from which gaps between slots follow when summaries are
read; summaries of consecutive slots merge into one of the same form.

The state store must be the RocksDB one (``streams.write_batches`` sees to it).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Seconds of a slot, and how long rows may be overdue.
SLOT_SECONDS, DELAY = 60, "2 minutes"

SLOTS = (
    "src_ip string, slot bigint, packets bigint, first double, last double, "
    "n bigint, mean double, m2 double, low double, high double, late bigint, undated bigint"
)
#: The slot of rows without a time.
_UNDATED = -(1 << 53)
#: Seconds before which there is no packet.
_NEVER = -(10**11)


def summary(times: np.ndarray) -> dict[str, Any]:
    """Edges and gap statistics of one slot's times, in any order."""
    times = np.sort(times)
    gaps = np.diff(times)
    some = len(gaps) > 0
    mean = float(gaps.mean()) if some else None
    return {
        "packets": len(times),
        "first": float(times[0]),
        "last": float(times[-1]),
        "n": len(gaps),
        "mean": mean,
        "m2": float(((gaps - mean) ** 2).sum()) if some else 0.0,
        "low": float(gaps.min()) if some else None,
        "high": float(gaps.max()) if some else None,
        "late": 0,
        "undated": 0,
    }


class SlotGaps(StatefulProcessor):
    """Times of a slot until its end; later rows are only counted."""

    def __init__(self, slot_seconds: int):
        self.slot_seconds = slot_seconds

    def init(self, handle) -> None:
        self.handle = handle
        # One sorted chunk of times per micro-batch: adding to a slot does not rewrite it.
        self.chunks = handle.getListState("chunks", "times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source, slot = key[0], int(key[1])
        times = np.concatenate([part["timestamp"].to_numpy(np.float64) for part in rows])
        if slot == _UNDATED:
            yield self._row(source, None, {"late": 0, "undated": len(times)})
            return
        end = (slot + 1) * self.slot_seconds * 1000
        if timerValues.getCurrentWatermarkInMs() >= end:
            yield self._row(source, slot, {"late": len(times), "undated": 0})
            return
        self.chunks.appendValue((np.sort(times).tobytes(),))
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = np.concatenate([np.frombuffer(bytes(row[0])) for row in self.chunks.get()])
        self.chunks.clear()
        yield self._row(key[0], int(key[1]), summary(times))

    def _row(self, source: str, slot: int | None, values: dict[str, Any]) -> pd.DataFrame:
        whole = {"packets": 0, "n": 0, "m2": 0.0, "first": None, "last": None, "mean": None, "low": None, "high": None}
        whole |= values
        frame = {"src_ip": [source], "slot": pd.array([slot], "Int64")}
        for name in ("packets", "n", "late", "undated"):
            frame[name] = [whole[name]]
        for name in ("first", "last", "mean", "m2", "low", "high"):
            frame[name] = pd.array([whole[name]], "Float64")
        return pd.DataFrame(frame)[[c.split()[0] for c in SLOTS.split(", ")]]

    def close(self) -> None:
        pass


def gap_slots(packets: DataFrame, *, slot_seconds: int = SLOT_SECONDS, delay: str = DELAY) -> DataFrame:
    """The stream of slot summaries (``SLOTS``), in append mode, of a stream with ``timestamp`` and ``src_ip``.

    Rows behind the watermark whose slot is closed, and rows without a time, give rows that only count them in
    ``late`` and ``undated``. Rows without a source are left out, but their times move the watermark on.
    """
    slot = F.coalesce(F.floor(F.col("timestamp") / slot_seconds), F.lit(_UNDATED))
    # The condition names the event time so that it is not applied before the watermark has seen the row.
    sourced = F.col("src_ip").isNotNull() | (F.col("event_time") < F.timestamp_seconds(F.lit(_NEVER)))
    rows = (
        packets.withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint")))
        .withWatermark("event_time", delay)
        .filter(sourced)
        # Without the event time no row is dropped as late before the processor can count it.
        .select("src_ip", slot.alias("slot"), "timestamp")
    )
    return rows.groupBy("src_ip", "slot").transformWithStateInPandas(
        SlotGaps(slot_seconds), SLOTS, outputMode="append", timeMode="EventTime"
    )


def merged(slots: DataFrame, *, expire_seconds: float | None = None) -> DataFrame:
    """One summary per source of all its slots, ``slot`` being the last one.

    The gap between the last packet of a slot and the first one of the next counts, unless it is longer than
    ``expire_seconds``: a source that was silent for so long starts anew. Summaries that were merged before can
    be merged again with later ones.
    """
    gap = F.col("first") - F.lag("last").over(Window.partitionBy("src_ip").orderBy("first"))
    if expire_seconds is not None:
        gap = F.when(gap <= expire_seconds, gap)
    edged = slots.filter(F.col("first").isNotNull()).withColumn("edge", gap)
    part = F.struct("n", "mean", "m2", "low", "high")
    edge = F.when(
        F.col("edge").isNotNull(),
        F.struct(
            F.lit(1).cast("bigint").alias("n"),
            F.col("edge").alias("mean"),
            F.lit(0.0).alias("m2"),
            F.col("edge").alias("low"),
            F.col("edge").alias("high"),
        ),
    )
    parts = edged.select(
        "src_ip", "slot", "first", "last", F.inline(F.array_compact(F.array(part, edge)))
    )
    source = Window.partitionBy("src_ip")
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(source), F.sum("n").over(source))
    shift = F.coalesce(F.col("mean") - F.col("whole_mean"), F.lit(0.0))
    gaps = (
        parts.withColumn("whole_mean", mean)
        .groupBy("src_ip")
        .agg(
            F.max("slot").alias("slot"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("n").alias("n"),
            F.first("whole_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )
    counts = slots.groupBy("src_ip").agg(
        F.sum("packets").alias("packets"), F.sum("late").alias("late"), F.sum("undated").alias("undated")
    )
    both = counts.join(gaps, "src_ip", "left").na.fill({"n": 0, "m2": 0.0})
    return both.select(*[c.split()[0] for c in SLOTS.split(", ")])


def statistics(slots: DataFrame, *, expire_seconds: float | None = None) -> DataFrame:
    """Gap statistics of each source, with the late and undated rows that they leave out."""
    return merged(slots, expire_seconds=expire_seconds).select(
        "src_ip",
        F.col("mean").alias("mean_inter_arrival"),
        F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))).alias("std_inter_arrival"),
        F.col("low").alias("min_inter_arrival"),
        F.col("high").alias("max_inter_arrival"),
        F.col("late").alias("late_packets"),
        F.col("undated").alias("undated_packets"),
    )
