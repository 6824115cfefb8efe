"""Explicit schemas of the tables that the operators read and write."""

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("attack_type", T.StringType()),
    ]
)

THREAT_DB = T.StructType(
    [
        T.StructField("indicator", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("last_seen", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

#: One decoded capture record; columns of an absent layer are null.
DISSECTED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("record", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("frame_length", T.LongType()),
        T.StructField("eth_type", T.StringType()),
        T.StructField("ip_proto", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("transport", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("highest_layer", T.StringType()),
        T.StructField("malformed", T.BooleanType()),
    ]
)

REPUTATION_FEED = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("collected_at", T.DoubleType()),
        T.StructField("body", T.StringType()),
    ]
)

#: Parts of the three provider documents that are used.
ABUSE_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("abuseConfidenceScore", T.DoubleType()),
                    T.StructField("countryCode", T.StringType()),
                    T.StructField("isp", T.StringType()),
                    T.StructField("lastReportedAt", T.StringType()),
                    T.StructField(
                        "reports",
                        T.ArrayType(
                            T.StructType(
                                [T.StructField("categories", T.ArrayType(T.IntegerType()))]
                            )
                        ),
                    ),
                ]
            ),
        )
    ]
)

VOTES_BODY = T.StructType(
    [
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "attributes",
                        T.StructType(
                            [
                                T.StructField(
                                    "last_analysis_stats",
                                    T.MapType(T.StringType(), T.DoubleType()),
                                ),
                                T.StructField(
                                    "categories", T.MapType(T.StringType(), T.StringType())
                                ),
                                T.StructField("country", T.StringType()),
                                T.StructField("as_owner", T.StringType()),
                                T.StructField("last_analysis_date", T.StringType()),
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)

FRAUD_BODY = T.StructType(
    [
        T.StructField("fraud_score", T.DoubleType()),
        T.StructField("proxy", T.BooleanType()),
        T.StructField("vpn", T.BooleanType()),
        T.StructField("tor", T.BooleanType()),
        T.StructField("bot_status", T.BooleanType()),
        T.StructField("is_crawler", T.BooleanType()),
        T.StructField("recent_abuse", T.BooleanType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("ISP", T.StringType()),
    ]
)
