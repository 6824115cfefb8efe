"""Severity, risk and alert-text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# A score strictly below the bound has the severity.
SEVERITY_BOUNDS = [("critical", -0.8), ("high", -0.6), ("medium", -0.4)]
LOWEST_SEVERITY = "low"

# Rank of a severity.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# Severity on the ten-point scale of event collectors.
SEVERITY_TEN_POINT = {"low": 3, "medium": 5, "high": 8, "critical": 10}
TEN_POINT_DEFAULT = 5

# Text formats of an alert.
GENERIC_ALERT_TYPE = "Anomalous Network Traffic"
DESCRIPTION_FORMAT = "Unusual traffic pattern detected from %s to %s using %s"
RISK_FORMAT = "**Risk: %d%%** - %s"


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(mapping.items())])
    return F.try_element_at(table, key)


def severity_from_score(score: Column) -> Column:
    result = None
    for name, bound in SEVERITY_BOUNDS:
        test = score < F.lit(bound)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(LOWEST_SEVERITY)


def severity_rank(severity: Column, unknown: int | None = 0) -> Column:
    rank = lookup(SEVERITY_RANK, severity)
    return rank if unknown is None else F.coalesce(rank, F.lit(unknown))


def severity_ten_point(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_TEN_POINT, F.lower(severity)), F.lit(TEN_POINT_DEFAULT))


def alert_type_title(attack_type: Column) -> Column:
    """``port_scan`` -> ``Port Scan Attack``; the generic title when nothing is known."""
    title = F.concat(F.initcap(F.replace(attack_type, F.lit("_"), F.lit(" "))), F.lit(" Attack"))
    return F.when(attack_type != "normal", title).otherwise(GENERIC_ALERT_TYPE)


def alert_description(src: Column, dst: Column, protocol: Column) -> Column:
    unknown = F.lit("unknown")
    return F.format_string(
        DESCRIPTION_FORMAT,
        F.coalesce(src, unknown),
        F.coalesce(dst, unknown),
        F.coalesce(protocol, unknown),
    )


def risk_display(confidence: Column, tags: Column) -> Column:
    """Whole per cent (cut, not rounded) and the tags with a space after each comma."""
    percent = (confidence * 100).cast("int")
    spaced = F.replace(F.coalesce(tags, F.lit("")), F.lit(","), F.lit(", "))
    return F.format_string(RISK_FORMAT, percent, spaced)


def entity_key(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.md5(value))
