"""Clock, calendar and flow-key columns of a packet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WINDOW_SECONDS = 60


def epoch_to_timestamp(epoch: Column) -> Column:
    """Epoch seconds to a timestamp with microseconds."""
    return F.timestamp_micros(F.round(epoch * F.lit(1e6)).cast("bigint"))


def text_to_timestamp(text: Column) -> Column:
    """A parseable string to a timestamp, null where it does not parse."""
    return text.try_cast("timestamp")


def time_features(epoch: Column) -> dict[str, Column]:
    """Hour, Monday-based weekday, weekend and night (20:00 to 05:59) flags."""
    ts = epoch_to_timestamp(epoch)
    hour, day = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": day,
        "is_weekend": day >= 5,
        "is_night": (hour < 6) | (hour >= 20),
    }


def calendar_features(epoch: Column, *, strict: bool = False) -> dict[str, Column]:
    """Hour, minute, weekday, weekend and business-hour flags.

    By default business hours include the hour that starts at 17:00 and a night
    flag (22:00 to 05:59) is given; ``strict`` ends business at 17:00, no night flag.
    """
    ts = epoch_to_timestamp(epoch)
    hour, day = F.hour(ts), F.weekday(ts)
    columns = {
        "hour": hour,
        "minute": F.minute(ts),
        "day_of_week": day,
        "is_weekend": day >= 5,
    }
    if strict:
        columns["is_business_hours"] = (hour >= 9) & (hour < 17) & (day < 5)
    else:
        columns["is_night"] = (hour >= 22) | (hour <= 5)
        columns["is_business_hours"] = hour.between(9, 17) & (day < 5)
    return columns


def flow_key(src: Column, dst: Column) -> Column:
    """``src->dst``; null when either end is null."""
    return F.concat(src, F.lit("->"), dst)


def time_window(epoch: Column, seconds: float = DEFAULT_WINDOW_SECONDS) -> Column:
    """Start of the tumbling window, in epoch seconds."""
    return (F.floor(epoch / F.lit(seconds)) * F.lit(seconds)).cast("double")
