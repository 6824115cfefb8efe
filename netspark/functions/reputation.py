"""Provider reputation documents to one common result struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netspark import schemas
from netspark.functions.severity import lookup

# Report category codes and their names.
ABUSE_CATEGORIES = {
    1: "dns_compromise",
    2: "dns_poisoning",
    3: "fraud_orders",
    4: "ddos_attack",
    5: "ftp_brute_force",
    6: "ping_of_death",
    7: "phishing",
    8: "fraud_voip",
    9: "open_proxy",
    10: "web_spam",
    11: "email_spam",
    12: "blog_spam",
    13: "vpn_ip",
    14: "port_scan",
    15: "hacking",
    16: "sql_injection",
    17: "spoofing",
    18: "brute_force",
    19: "bad_web_bot",
    20: "exploited_host",
    21: "web_app_attack",
    22: "ssh",
    23: "iot_targeted",
}

# Document field and the category it stands for.
FRAUD_FLAGS = [
    ("proxy", "proxy"),
    ("vpn", "vpn"),
    ("tor", "tor"),
    ("bot_status", "bot"),
    ("is_crawler", "crawler"),
    ("recent_abuse", "recent_abuse"),
]

ABUSE_LIMIT = 50
VOTES_LIMIT = 50
FRAUD_LIMIT = 75


def _location(country=None, city=None, region=None, isp=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        (null if country is None else country).alias("country"),
        (null if city is None else city).alias("city"),
        (null if region is None else region).alias("region"),
        (null if isp is None else isp).alias("isp"),
    )


def _result(score: Column, limit: float, categories: Column, location: Column, seen: Column):
    score = F.coalesce(score, F.lit(0.0))
    return F.struct(
        score.alias("score"),
        (score > limit).alias("is_malicious"),
        categories.alias("categories"),
        location.alias("location"),
        seen.alias("last_reported"),
    )


def _no_categories() -> Column:
    return F.array().cast("array<string>")


def abuse_result(body: Column) -> Column:
    """Confidence score; category codes of all reports, unknown codes left out."""
    data = F.from_json(body, schemas.ABUSE_BODY)["data"]
    codes = F.flatten(F.transform(data["reports"], lambda report: report["categories"]))
    names = F.filter(
        F.transform(codes, lambda code: lookup(ABUSE_CATEGORIES, code)),
        lambda name: name.isNotNull(),
    )
    return _result(
        data["abuseConfidenceScore"],
        ABUSE_LIMIT,
        F.coalesce(names, _no_categories()),
        _location(country=data["countryCode"], isp=data["isp"]),
        data["lastReportedAt"],
    )


def votes_result(body: Column) -> Column:
    """Share of vendors that vote malicious (suspicious counts half), whole per cent."""
    attributes = F.from_json(body, schemas.VOTES_BODY)["data"]["attributes"]
    stats = attributes["last_analysis_stats"]
    zero = F.lit(0.0)
    votes = lambda name: F.coalesce(F.try_element_at(stats, F.lit(name)), zero)
    total = F.aggregate(F.map_values(stats), zero, lambda acc, count: acc + count)
    share = F.try_divide(votes("malicious") + votes("suspicious") * 0.5, total) * 100
    names = F.transform(
        F.map_values(attributes["categories"]),
        lambda name: F.replace(F.lower(name), F.lit(" "), F.lit("_")),
    )
    return _result(
        share.cast("int").cast("double"),
        VOTES_LIMIT,
        F.coalesce(names, _no_categories()),
        _location(country=attributes["country"], isp=attributes["as_owner"]),
        attributes["last_analysis_date"],
    )


def fraud_result(body: Column) -> Column:
    """Fraud score; each raised flag is a category."""
    data = F.from_json(body, schemas.FRAUD_BODY)
    names = F.array_compact(F.array(*[F.when(data[field], name) for field, name in FRAUD_FLAGS]))
    return _result(
        data["fraud_score"],
        FRAUD_LIMIT,
        F.coalesce(names, _no_categories()),
        _location(data["country_code"], data["city"], data["region"], data["ISP"]),
        F.lit(None).cast("string"),
    )


def provider_result(provider: Column, body: Column) -> Column:
    """The result struct of whichever provider sent the document."""
    return (
        F.when(provider == "abuse", abuse_result(body))
        .when(provider == "votes", votes_result(body))
        .when(provider == "fraud", fraud_result(body))
    )
