"""Outbound documents, read back field by field."""

from pyspark.sql import functions as F

from netspark.functions import payloads
from netspark.operators import alerts as al
from netspark.plans.intel_queries import NOW
from netspark.plans.registry import query

_FIELDS = ["timestamp", "severity", "type", "src_ip", "dst_ip", "protocol"]
_DETAILS = ["alert_id", "timestamp", "type", "severity", "src_ip", "dst_ip", "protocol", "port"]
_STAMP = "strftime(make_timestamp(CAST(round(timestamp * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"

#: Alerts with some fields missing, so the defaults show.
_SPARSE = """s AS (SELECT alert_id, timestamp, CASE WHEN alert_id % 7 = 0 THEN NULL ELSE severity END AS severity,
  CASE WHEN alert_id % 11 = 0 THEN NULL ELSE type END AS type, src_ip, dst_ip, protocol, port FROM alerts)"""


def _sparse(inputs):
    return inputs.view("alerts").withColumns(
        {
            "severity": F.when(F.col("alert_id") % 7 != 0, F.col("severity")),
            "type": F.when(F.col("alert_id") % 11 != 0, F.col("type")),
        }
    )


def _event(inputs, document):
    return _sparse(inputs).select("alert_id", F.to_json(document).alias("j"))


def _fields():
    return {name: F.col(name) for name in _FIELDS}


def _details():
    return F.struct(*_DETAILS)


def _read(df, **paths):
    """Fields of the written JSON text."""
    return df.select(
        "alert_id", *[F.get_json_object("j", path).alias(name) for name, path in paths.items()]
    )


@query(
    "siem_generic",
    oracle=f"""WITH {_SPARSE} SELECT alert_id, coalesce(severity, 'medium') AS severity,
      coalesce(type, 'Unknown') AS type, 'netspark' AS source, CAST(alert_id AS VARCHAR) AS details_id,
      src_ip AS details_src FROM s""",
)
def siem_generic(inputs):
    document = payloads.generic_event(_fields(), _details(), now=NOW)
    return _read(
        _event(inputs, document),
        severity="$.severity",
        type="$.type",
        source="$.source",
        details_id="$.details.alert_id",
        details_src="$.details.src_ip",
    )


@query(
    "siem_hec",
    oracle=f"""WITH {_SPARSE} SELECT alert_id, '1704067200' AS time, 'netspark' AS host, 'threat' AS sourcetype,
      'security' AS index_name, type AS event_type FROM s""",
)
def siem_hec(inputs):
    document = payloads.collector_event(_details(), now=NOW)
    return _read(
        _event(inputs, document),
        time="$.time",
        host="$.host",
        sourcetype="$.sourcetype",
        index_name="$.index",
        event_type="$.event.type",
    )


@query(
    "siem_ecs",
    oracle=f"""WITH {_SPARSE} SELECT alert_id, concat('Network threat detected: ', coalesce(type, 'Unknown'))
        AS message, coalesce(severity, 'medium') AS level, coalesce(severity, '3') AS event_severity,
      coalesce(protocol, 'unknown') AS protocol, coalesce(src_ip, 'unknown') AS source_ip,
      coalesce(dst_ip, 'unknown') AS destination_ip, CAST(port AS VARCHAR) AS indicator_port FROM s""",
)
def siem_ecs(inputs):
    document = payloads.common_schema_event(_fields(), _details(), now=NOW)
    return _read(
        _event(inputs, document),
        message="$.message",
        level="$.log.level",
        event_severity="$.event.severity",
        protocol="$.network.protocol",
        source_ip="$.network.source.ip",
        destination_ip="$.network.destination.ip",
        indicator_port="$.threat.indicator.port",
    )


@query(
    "siem_flat_event",
    oracle=f"""WITH {_SPARSE} SELECT alert_id, '1704067200000' AS event_time,
      CASE severity WHEN 'low' THEN '3' WHEN 'high' THEN '8' WHEN 'critical' THEN '10' ELSE '5' END AS severity,
      concat('Network anomaly detected: ', coalesce(type, 'Unknown')) AS name,
      coalesce(dst_ip, 'unknown') AS destination, src_ip AS custom_src FROM s""",
)
def siem_flat_event(inputs):
    document = payloads.flat_event(_fields(), _details(), now=NOW)
    return _read(
        _event(inputs, document),
        event_time="$.eventTime",
        severity="$.severity",
        name="$.name",
        destination="$.destinationAddress",
        custom_src="$.customFields.src_ip",
    )


def _message_fields(inputs):
    """Alerts with a description and, on some, intelligence."""
    described = _sparse(inputs).withColumns(
        {
            "description": F.when(F.col("alert_id") % 5 != 0, F.concat(F.lit("seen "), "src_ip")),
            "source": F.lit(None).cast("string"),
            "has_intel": F.col("alert_id") % 2 == 0,
            "risk_score": F.col("alert_id") % 100,
            "categories": F.when(
                F.col("alert_id") % 4 == 0, F.array(F.lit("scan"), F.lit("tor"))
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    names = ["timestamp", "severity", "type", "description", "source", "has_intel", "risk_score", "categories"]
    return described, {name: F.col(name) for name in names}


_MESSAGE = f"""{_SPARSE}, m AS (SELECT *, CASE WHEN alert_id % 5 <> 0 THEN 'seen ' || src_ip END AS description,
  alert_id % 2 = 0 AS has_intel, CASE WHEN alert_id % 4 = 0 THEN 'scan, tor' END AS names FROM s)"""


@query(
    "chat_payload",
    oracle=f"""WITH {_MESSAGE} SELECT alert_id, CASE coalesce(severity, 'medium') WHEN 'low' THEN '#36a64f'
        WHEN 'medium' THEN '#ffcc00' WHEN 'critical' THEN '#ff0000' ELSE '#ff9900' END AS color,
      concat('Security Alert: ', coalesce(type, 'Unknown Threat')) AS title,
      coalesce(description, 'Unknown Threat') AS text, upper(coalesce(severity, 'medium')) AS severity_field,
      'Unknown' AS source_field, {_STAMP} AS time_field,
      CASE WHEN has_intel THEN concat(alert_id % 100, '/100') END AS risk_field,
      CASE WHEN has_intel THEN names END AS category_field FROM m""",
)
def chat_payload(inputs):
    df, fields = _message_fields(inputs)
    written = df.select("alert_id", F.to_json(payloads.chat_payload(fields, now=NOW)).alias("j"))
    a = "$.attachments[0]"
    return _read(
        written,
        color=f"{a}.color",
        title=f"{a}.title",
        text=f"{a}.text",
        severity_field=f"{a}.fields[0].value",
        source_field=f"{a}.fields[1].value",
        time_field=f"{a}.fields[2].value",
        risk_field=f"{a}.fields[3].value",
        category_field=f"{a}.fields[4].value",
    )


@query(
    "card_payload",
    oracle=f"""WITH {_MESSAGE} SELECT alert_id, CASE coalesce(severity, 'medium') WHEN 'low' THEN '008000'
        WHEN 'medium' THEN 'FFC000' WHEN 'critical' THEN 'FF0000' ELSE 'FF9900' END AS color,
      concat('Security Alert: ', coalesce(type, 'Unknown Threat')) AS summary,
      concat('Severity: ', upper(coalesce(severity, 'medium'))) AS subtitle,
      coalesce(description, 'Unknown Threat') AS description_fact, {_STAMP} AS time_fact,
      CASE WHEN has_intel THEN concat(alert_id % 100, '/100') END AS risk_fact,
      CASE WHEN has_intel THEN names END AS category_fact FROM m""",
)
def card_payload(inputs):
    df, fields = _message_fields(inputs)
    written = df.select("alert_id", F.to_json(payloads.card_payload(fields, now=NOW)).alias("j"))
    return _read(
        written,
        color="$.themeColor",
        summary="$.summary",
        subtitle="$.sections[0].activitySubtitle",
        description_fact="$.sections[0].facts[0].value",
        time_fact="$.sections[0].facts[2].value",
        risk_fact="$.sections[1].facts[0].value",
        category_fact="$.sections[1].facts[1].value",
    )


@query(
    "email_fields",
    oracle=f"""WITH {_MESSAGE} SELECT alert_id, concat('Security Alert: ', coalesce(type, 'Unknown Threat'),
        ' - ', upper(coalesce(severity, 'medium'))) AS subject,
      concat('Security Alert: ', coalesce(description, 'Unknown Threat')) AS body,
      'soc@example.org, duty@example.org' AS recipients FROM m""",
)
def email_fields(inputs):
    df, fields = _message_fields(inputs)
    columns = payloads.email_fields(fields, ["soc@example.org", "duty@example.org"])
    return df.select("alert_id", *[c.alias(n) for n, c in columns.items()])


@query(
    "batch_outbound",
    oracle="""WITH t AS (SELECT alert_id, CASE WHEN alert_id % 7 = 0 THEN NULL ELSE timestamp END AS time FROM alerts),
        r AS (SELECT alert_id, (row_number() OVER (ORDER BY time NULLS FIRST, alert_id) - 1) // 50 AS batch_id FROM t)
      SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS INT) AS batch_rows,
        string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS alert_ids FROM r GROUP BY batch_id""",
)
def batch_outbound(inputs):
    """Some alerts have no time; they are sent first."""
    document = payloads.generic_event(_fields(), _details(), now=NOW)
    time = F.when(F.col("alert_id") % 7 != 0, F.col("timestamp"))
    batches = al.outbound_batches(inputs.view("alerts").withColumn("timestamp", time), document)
    ids = F.array_join(F.array_sort("alert_ids").cast("array<string>"), ",")
    return batches.select("batch_id", "batch_rows", ids.alias("alert_ids"))
