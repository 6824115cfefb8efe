"""Threat intelligence: indicators, blocklists, reputation feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions import reputation
from netspark.functions import severity as sev

FRESH_SECONDS = 86_400
#: Order in which feeds are asked; the location of the last one wins.
FEED_ORDER = ["abuse", "votes", "fraud"]
BLOCKLIST_CATEGORY = "local_blocklist"
BLOCKLIST_SCORE = 100.0

_INTEL = ["confidence", "severity", "description", "tags"]


def best_indicators(threat_db: DataFrame, *, row_order: str = "item_id") -> DataFrame:
    """One row per (indicator, type): the highest confidence, the first row on ties."""
    rank = F.struct(F.col("confidence"), (-F.col(row_order)).alias("o"))
    return (
        threat_db.filter(F.col("confidence").isNotNull())
        .groupBy("indicator", "type")
        .agg(F.max_by(F.struct(*_INTEL), rank).alias("intel"))
    )


def enrich_alerts(
    alerts: DataFrame, threat_db: DataFrame, *, row_order: str = "item_id"
) -> DataFrame:
    """Attach the best indicator match of source or destination; the source wins a tie.

    The indicator side is reduced to unique keys, so each lookup is a plain left join:
    broadcast by the planner when small, else sort-merge, where a hot address on the
    alert side is split by the skew rule.
    """
    best = best_indicators(threat_db, row_order=row_order).filter(F.col("type") == "ip")
    result = alerts
    for side in ("src", "dst"):
        keyed = best.select(
            F.col("indicator").alias(f"{side}_ip"), F.col("intel").alias(f"_{side}")
        )
        result = result.join(keyed, f"{side}_ip", "left")
    take_dst = F.coalesce(
        F.col("_dst.confidence") > F.col("_src.confidence"), F.col("_src").isNull()
    )
    chosen = F.when(take_dst, F.col("_dst")).otherwise(F.col("_src"))
    result = result.withColumn("_intel", chosen)
    display = sev.risk_display(F.col("_intel.confidence"), F.col("_intel.tags"))
    return result.withColumns(
        {
            "threat_confidence": F.col("_intel.confidence"),
            "threat_severity": F.when(
                F.col("_intel").isNotNull(), F.coalesce("_intel.severity", F.lit("unknown"))
            ),
            "threat_description": F.when(
                F.col("_intel").isNotNull(), F.coalesce("_intel.description", F.lit(""))
            ),
            "threat_tags": F.when(
                F.col("_intel").isNotNull(), F.coalesce("_intel.tags", F.lit(""))
            ),
            "threat_intel_display": F.when(F.col("_intel").isNotNull(), display),
        }
    ).drop("_src", "_dst", "_intel")


def best_match(candidates: DataFrame, group: str, score: str, tie: str, value: str) -> DataFrame:
    """First row with the highest score in each group, by aggregation rather than a sort."""
    rank = F.struct(F.col(score), (-F.col(tie)).alias("o"))
    return candidates.groupBy(group).agg(
        F.max(score).alias(score), F.max_by(value, rank).alias(value)
    )


def flag_blocklisted(traffic: DataFrame, blocklist: DataFrame, *, column: str = "src_ip"):
    """Flag rows whose address is on the list, with its fixed score and category."""
    listed = blocklist.select(F.col("ip").alias(column)).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return traffic.join(listed, column, "left").select(
        *traffic.columns,
        hit.alias("is_malicious"),
        F.when(hit, BLOCKLIST_SCORE).otherwise(0.0).alias("risk_score"),
        F.when(hit, BLOCKLIST_CATEGORY).alias("category"),
    )


def blocklist_hits(traffic: DataFrame, blocklist: DataFrame, *, column: str = "src_ip"):
    return traffic.join(blocklist.select(F.col("ip").alias(column)), column, "left_semi")


def clean_traffic(traffic: DataFrame, blocklist: DataFrame, *, column: str = "src_ip"):
    return traffic.join(blocklist.select(F.col("ip").alias(column)), column, "left_anti")


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Feed documents to (ip, provider, collected_at, result)."""
    result = reputation.provider_result(F.col("provider"), F.col("body"))
    return feeds.select("ip", "provider", "collected_at", result.alias("result")).filter(
        F.col("result").isNotNull()
    )


def reputation_rollup(
    feeds: DataFrame, blocklist: DataFrame | None = None, *, feed_order: list[str] | None = None
) -> DataFrame:
    """Per address: malicious in any feed, highest score, distinct categories, last location.

    Each provider counts with its latest document, so an address keeps at most one row
    per provider however often it was asked.
    """
    order = feed_order or FEED_ORDER
    position = sev.lookup({name: i for i, name in enumerate(order)}, F.col("provider"))
    latest = feeds.groupBy("ip", "provider").agg(F.max_by("body", "collected_at").alias("body"))
    parsed = latest.select(
        "ip",
        "provider",
        position.alias("position"),
        reputation.provider_result(F.col("provider"), F.col("body")).alias("r"),
    ).filter(F.col("r").isNotNull() & F.col("position").isNotNull())
    if blocklist is not None:
        null = F.lit(None).cast("string")
        listed = blocklist.select("ip").distinct().select(
            "ip",
            F.lit(BLOCKLIST_CATEGORY).alias("provider"),
            F.lit(None).cast("int").alias("position"),
            F.struct(
                F.lit(BLOCKLIST_SCORE).alias("score"),
                F.lit(True).alias("is_malicious"),
                F.array(F.lit(BLOCKLIST_CATEGORY)).alias("categories"),
                F.struct(*[null.alias(n) for n in ("country", "city", "region", "isp")]).alias("location"),
                null.alias("last_reported"),
            ).alias("r"),
        )
        parsed = parsed.unionByName(listed)
    return parsed.groupBy("ip").agg(
        F.bool_or("r.is_malicious").alias("is_malicious"),
        F.max("r.score").alias("risk_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.categories")))).alias("categories"),
        F.max_by("r.location", "position").alias("location"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "provider",
                        F.struct(F.col("r.score").alias("score"),
                                 F.col("r.is_malicious").alias("is_malicious")),
                    )
                )
            )
        ).alias("sources"),
    )


def fresh_reputation(
    addresses: DataFrame,
    results: DataFrame,
    *,
    now: float,
    ttl_seconds: float = FRESH_SECONDS,
    tie: str = "provider",
) -> DataFrame:
    """Each address with its latest result, to be used again while it is younger than the time to live.

    ``collected_at`` is the time of the latest result, of several at that time the one with the
    smallest ``tie``; its other columns are null once it is no longer fresh.
    """
    parts = [c for c in results.columns if c not in ("ip", "collected_at")]
    latest = results.groupBy("ip").agg(
        F.min_by(F.struct("collected_at", *parts), F.struct(-F.col("collected_at"), tie)).alias("_latest")
    )
    joined = addresses.select("ip").distinct().join(latest, "ip", "left")
    age = F.lit(float(now)) - F.col("_latest.collected_at")
    fresh = F.coalesce(age < ttl_seconds, F.lit(False))
    return joined.select(
        "ip",
        F.col("_latest.collected_at").alias("collected_at"),
        fresh.alias("is_fresh"),
        *[F.when(fresh, F.col(f"_latest.{c}")).alias(c) for c in parts],
    )


def refresh_worklist(
    addresses: DataFrame, results: DataFrame, *, now: float, ttl_seconds: float = FRESH_SECONDS
) -> DataFrame:
    """Addresses without a fresh result."""
    fresh = results.filter(F.lit(float(now)) - F.col("collected_at") < ttl_seconds).select("ip")
    return addresses.select("ip").distinct().join(fresh, "ip", "left_anti")


def distinct_categories(categories):
    """Sorted list without repeats."""
    return F.array_sort(F.array_distinct(categories))
