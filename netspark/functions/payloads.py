"""Outbound documents (collector events, chat messages, cards, mails) as structs.

Names that a deployment chooses (product, host, index, channel) are parameters.
``now`` is always passed in, so a re-run writes the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netspark.functions.severity import lookup, severity_ten_point

# Severity colours of chat messages.
CHAT_COLOURS = {"low": "#36a64f", "medium": "#ffcc00", "high": "#ff9900", "critical": "#ff0000"}
# Severity colours of cards.
CARD_COLOURS = {"low": "008000", "medium": "FFC000", "high": "FF9900", "critical": "FF0000"}

PRODUCT = "netspark"
UNKNOWN_TYPE = "Unknown"
UNKNOWN_THREAT = "Unknown Threat"

# Text formats, the alert type or description follows.
HEADLINE = "Security Alert: "
COMMON_SCHEMA_MESSAGE = "Network threat detected: "
FLAT_EVENT_NAME = "Network anomaly detected: "


def _or(column: Column, default) -> Column:
    return F.coalesce(column, F.lit(default))


def _clock(now: float, epoch: Column | None = None) -> Column:
    """A text time stamp; ``now`` where the alert has none."""
    seconds = F.lit(now) if epoch is None else F.coalesce(epoch, F.lit(now))
    stamp = F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def generic_event(alert: dict[str, Column], details: Column, *, now: float, product=PRODUCT):
    return F.struct(
        F.coalesce(alert["timestamp"], F.lit(now)).alias("timestamp"),
        _or(alert["severity"], "medium").alias("severity"),
        _or(alert["type"], UNKNOWN_TYPE).alias("type"),
        F.lit(product).alias("source"),
        details.alias("details"),
    )


def collector_event(
    details: Column, *, now: float, host=PRODUCT, source="anomaly", kind="threat", index="security"
):
    return F.struct(
        F.lit(int(now)).cast("bigint").alias("time"),
        F.lit(host).alias("host"),
        F.lit(source).alias("source"),
        F.lit(kind).alias("sourcetype"),
        F.lit(index).alias("index"),
        details.alias("event"),
    )


def common_schema_event(alert: dict[str, Column], details: Column, *, now: float, product=PRODUCT):
    """Nested event; note that the level and the event severity have different defaults."""
    address = lambda column: F.struct(_or(column, "unknown").alias("ip"))
    return F.struct(
        F.coalesce(alert["timestamp"], F.lit(now)).alias("@timestamp"),
        F.concat(F.lit(COMMON_SCHEMA_MESSAGE), _or(alert["type"], UNKNOWN_TYPE)).alias("message"),
        F.struct(_or(alert["severity"], "medium").alias("level")).alias("log"),
        F.struct(
            F.lit("threats").alias("module"),
            F.lit("network").alias("dataset"),
            _or(alert["severity"], "3").alias("severity"),
            F.lit("detected").alias("action"),
        ).alias("event"),
        F.struct(F.lit(product).alias("name")).alias("host"),
        F.struct(
            _or(alert["protocol"], "unknown").alias("protocol"),
            address(alert["src_ip"]).alias("source"),
            address(alert["dst_ip"]).alias("destination"),
        ).alias("network"),
        F.struct(F.lit(product).alias("framework"), details.alias("indicator")).alias("threat"),
    )


def flat_event(alert: dict[str, Column], details: Column, *, now: float, vendor=PRODUCT):
    return F.struct(
        F.lit(int(now * 1000)).cast("bigint").alias("eventTime"),
        F.lit(vendor).alias("deviceVendor"),
        F.lit("anomaly-detector").alias("deviceProduct"),
        F.lit("1.0").alias("deviceVersion"),
        F.lit("security").alias("category"),
        severity_ten_point(_or(alert["severity"], "medium")).alias("severity"),
        F.concat(F.lit(FLAT_EVENT_NAME), _or(alert["type"], UNKNOWN_TYPE)).alias("name"),
        _or(alert["src_ip"], "unknown").alias("sourceAddress"),
        _or(alert["dst_ip"], "unknown").alias("destinationAddress"),
        _or(alert["protocol"], "unknown").alias("protocol"),
        details.alias("customFields"),
    )


def _headline(alert: dict[str, Column]) -> Column:
    return F.concat(F.lit(HEADLINE), _or(alert["type"], UNKNOWN_THREAT))


def _intel_facts(alert: dict[str, Column], fact) -> Column:
    """Risk score, and the categories when there are any; empty without intelligence."""
    risk, categories = alert["risk_score"], alert["categories"]
    score = fact("Risk Score", F.concat(_or(risk.cast("int"), 0).cast("string"), F.lit("/100")), True)
    names = fact("Threat Categories", F.array_join(categories, ", "), False)
    some = F.coalesce(F.size(categories) > 0, F.lit(False))
    return F.array_compact(
        F.array(F.when(alert["has_intel"], score), F.when(alert["has_intel"] & some, names))
    )


def chat_payload(
    alert: dict[str, Column], *, now: float, channel="#alerts", username=PRODUCT, footer=PRODUCT
) -> Column:
    def field(title, value, short):
        return F.struct(
            F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short")
        )

    severity = _or(alert["severity"], "medium")
    text = _or(alert["description"], UNKNOWN_THREAT)
    base = F.array(
        field("Severity", F.upper(severity), True),
        field("Source", _or(alert["source"], "Unknown"), True),
        field("Time", _clock(now, alert["timestamp"]), True),
    )
    attachment = F.struct(
        F.concat(F.lit(HEADLINE), text).alias("fallback"),
        F.coalesce(lookup(CHAT_COLOURS, F.lower(severity)), F.lit(CHAT_COLOURS["high"])).alias("color"),
        _headline(alert).alias("title"),
        text.alias("text"),
        F.concat(base, _intel_facts(alert, field)).alias("fields"),
        F.lit(footer).alias("footer"),
        F.lit(int(now)).cast("bigint").alias("ts"),
    )
    return F.struct(
        F.lit(channel).alias("channel"),
        F.lit(username).alias("username"),
        F.array(attachment).alias("attachments"),
    )


def card_payload(alert: dict[str, Column], *, now: float) -> Column:
    def fact(name, value, _short=None):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    severity = _or(alert["severity"], "medium")
    null = F.lit(None).cast("string")

    def section(title, subtitle, facts):
        return F.struct(
            title.alias("activityTitle"), subtitle.alias("activitySubtitle"), facts.alias("facts")
        )

    main = section(
        _headline(alert),
        F.concat(F.lit("Severity: "), F.upper(severity)),
        F.array(
            fact("Description", _or(alert["description"], UNKNOWN_THREAT)),
            fact("Source", _or(alert["source"], "Unknown")),
            fact("Time", _clock(now, alert["timestamp"])),
        ),
    )
    intel = F.when(
        alert["has_intel"], section(F.lit("Threat Intelligence"), null, _intel_facts(alert, fact))
    )
    return F.struct(
        F.lit("MessageCard").alias("@type"),
        F.coalesce(lookup(CARD_COLOURS, F.lower(severity)), F.lit(CARD_COLOURS["high"])).alias("themeColor"),
        _headline(alert).alias("summary"),
        F.array_compact(F.array(main, intel)).alias("sections"),
    )


def email_fields(alert: dict[str, Column], recipients: list[str]) -> dict[str, Column]:
    severity = F.upper(_or(alert["severity"], "medium"))
    return {
        "subject": F.concat(_headline(alert), F.lit(" - "), severity),
        "body": F.concat(F.lit(HEADLINE), _or(alert["description"], UNKNOWN_THREAT)),
        "recipients": F.array_join(F.array(*[F.lit(name) for name in recipients]), ", "),
    }
