"""URL rules by expressions of host suffix and path prefix.

A URL is expanded into the expressions a rule could have (a suffix of its host's labels with a prefix of its
path), only for the shapes, labels by path length, that occur among the rules. Expressions and rules meet on
the first four bytes of their SHA-256; the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Hex digits of a digest that are joined on: four bytes.
PREFIX = 8


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", host, path), 256)


def judge(df: DataFrame, rules: DataFrame, url: str, keys: list[str], default: str = ALLOW) -> DataFrame:
    """Each row's ``keys`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: host, path, action. A rule fits its host and all subdomains of it when the path begins with
    the rule's path. Of those that fit, the longest (host and path together) wins, then the longer host,
    then block before allow. No fitting rule: ``rule`` is null and the verdict is ``default``. Null and
    malformed URLs have an empty host and path and fit no rule. Rules with a null part count for nothing;
    repeated rows are judged one by one. The path is compared as it stands: ``http://a.org`` has an empty
    one, which does not begin with ``/``.
    """
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin(ALLOW, BLOCK))
        .where(F.col("host") != "")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action")
        .distinct()
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("full", 1, PREFIX))
    )
    # Labels by path length: at most the depth of host names by the length of paths, however many rules.
    shapes = [
        (row.labels, row.chars)
        for row in rules.select(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("chars"))
        .distinct()
        .collect()
    ]
    parts = df.select(*keys, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Equal addresses are judged once.
    addresses = parts.select("host", "path").distinct()
    shape = F.explode(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes]))
    expressions = (
        addresses.select("host", "path", shape.alias("shape"))
        .where((_labels(F.col("host")) >= F.col("shape.labels")) & (F.length("path") >= F.col("shape.chars")))
        .select(
            "host",
            "path",
            _digest(
                F.expr("substring_index(host, '.', -shape.labels)"), F.expr("substring(path, 1, shape.chars)")
            ).alias("url_full"),
        )
        .withColumn("url_short", F.substring("url_full", 1, PREFIX))
    )
    strength = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("chars"),
        F.length("rule_host").alias("host_chars"),
        (F.col("action") == BLOCK).alias("blocks"),
    )
    best = (
        expressions.join(rules, (F.col("url_short") == F.col("short")) & (F.col("url_full") == F.col("full")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), strength).alias("best"))
    )
    judged = parts.join(best, ["host", "path"], "left")
    return judged.select(
        *keys,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
