"""Indicators, blocklists, reputation feeds and description similarity."""

from pyspark.sql import functions as F

from netspark.functions import reputation
from netspark.functions import severity as sev
from netspark.operators import graph, intel, similarity
from netspark.plans.registry import query

NOW = 1704067200.0

_DOUBLE = "CAST(json_extract_string(body, '{0}') AS DOUBLE)"
_TEXT = "json_extract_string(body, '{0}')"
_CODES = " ".join(f"WHEN {c} THEN '{n}'" for c, n in reputation.ABUSE_CATEGORIES.items())

_ABUSE = f"""abuse AS (SELECT ip, {_DOUBLE.format('$.data.abuseConfidenceScore')} AS score,
  {_TEXT.format('$.data.countryCode')} AS country, {_TEXT.format('$.data.isp')} AS isp,
  list_filter(list_transform(flatten(CAST(json_extract(body, '$.data.reports[*].categories') AS INT[][])),
    lambda c: CASE c {_CODES} END), lambda n: n IS NOT NULL) AS names
  FROM reputation_feeds WHERE provider = 'abuse')"""

_VOTES = f"""votes AS (SELECT ip, m, s, CAST(trunc((m + 0.5 * s) / (m + s + h) * 100) AS DOUBLE) AS score,
    country, seen, names FROM (SELECT ip,
      {_DOUBLE.format('$.data.attributes.last_analysis_stats.malicious')} AS m,
      {_DOUBLE.format('$.data.attributes.last_analysis_stats.suspicious')} AS s,
      {_DOUBLE.format('$.data.attributes.last_analysis_stats.harmless')} AS h,
      {_TEXT.format('$.data.attributes.country')} AS country,
      {_TEXT.format('$.data.attributes.last_analysis_date')} AS seen,
      [replace(lower({_TEXT.format('$.data.attributes.categories.a')}), ' ', '_'),
       replace(lower({_TEXT.format('$.data.attributes.categories.b')}), ' ', '_')] AS names
  FROM reputation_feeds WHERE provider = 'votes') v)"""

_FLAGS = ", ".join(
    f"CASE WHEN {_TEXT.format('$.' + field)} = 'true' THEN '{name}' END" for field, name in reputation.FRAUD_FLAGS
)
_FRAUD = f"""fraud AS (SELECT ip, {_DOUBLE.format('$.fraud_score')} AS score,
  {_TEXT.format('$.country_code')} AS country,
  list_filter([{_FLAGS}], lambda n: n IS NOT NULL) AS names
  FROM reputation_feeds WHERE provider = 'fraud')"""


def _feed(inputs, provider, result):
    feeds = inputs.view("reputation_feeds").filter(F.col("provider") == provider)
    return feeds.select("ip", result(F.col("body")).alias("r")).select(
        "ip",
        "r.score",
        "r.is_malicious",
        F.array_join("r.categories", ",").alias("categories"),
        F.col("r.location.country").alias("country"),
        F.col("r.location.isp").alias("isp"),
        "r.last_reported",
    )


@query(
    "reputation_abuse_score",
    oracle=f"""WITH {_ABUSE} SELECT ip, score, score > 50 AS is_malicious,
               array_to_string(names, ',') AS categories, country, isp, CAST(NULL AS VARCHAR) AS last_reported
               FROM abuse""",
)
def reputation_abuse_score(inputs):
    return _feed(inputs, "abuse", reputation.abuse_result)


@query(
    "reputation_vendor_votes",
    oracle=f"""WITH {_VOTES} SELECT ip, score, score > 50 AS is_malicious,
               array_to_string(names, ',') AS categories, country, CAST(NULL AS VARCHAR) AS isp,
               seen AS last_reported FROM votes""",
)
def reputation_vendor_votes(inputs):
    return _feed(inputs, "votes", reputation.votes_result)


@query(
    "reputation_fraud_flags",
    oracle=f"""WITH {_FRAUD} SELECT ip, score, score > 75 AS is_malicious,
               array_to_string(names, ',') AS categories, country, CAST(NULL AS VARCHAR) AS isp,
               CAST(NULL AS VARCHAR) AS last_reported FROM fraud""",
)
def reputation_fraud_flags(inputs):
    return _feed(inputs, "fraud", reputation.fraud_result)


_ROLLUP = f"""WITH {_ABUSE}, {_VOTES}, {_FRAUD}, r AS (
    SELECT ip, score, score > 50 AS bad, names, 0 AS pos, country FROM abuse
    UNION ALL SELECT ip, score, score > 50, names, 1, country FROM votes
    UNION ALL SELECT ip, score, score > 75, names, 2, country FROM fraud
    UNION ALL SELECT ip, 100, TRUE, ['local_blocklist'], NULL, NULL FROM blocklist)
  SELECT ip, bool_or(bad) AS is_malicious, max(score) AS risk_score,
    array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS categories,
    max_by(country, pos) AS country, count(*) AS sources FROM r GROUP BY ip"""


@query("reputation_rollup", oracle=_ROLLUP)
def reputation_rollup(inputs):
    rollup = intel.reputation_rollup(inputs.view("reputation_feeds"), inputs.view("blocklist"))
    return rollup.select(
        "ip",
        "is_malicious",
        "risk_score",
        F.array_join("categories", ",").alias("categories"),
        F.col("location.country").alias("country"),
        F.size("sources").cast("bigint").alias("sources"),
    )


@query(
    "distinct_categories",
    oracle=f"""WITH {_ABUSE} SELECT ip, array_to_string(list_sort(list_distinct(names)), ',') AS categories
               FROM abuse""",
)
def distinct_categories(inputs):
    feeds = inputs.view("reputation_feeds").filter(F.col("provider") == "abuse")
    names = reputation.abuse_result(F.col("body"))["categories"]
    return feeds.select("ip", F.array_join(intel.distinct_categories(names), ",").alias("categories"))


_BEST = """best AS (SELECT * FROM threat_db
  QUALIFY row_number() OVER (PARTITION BY indicator, type ORDER BY confidence DESC, item_id) = 1)"""


@query(
    "risk_display",
    oracle="""SELECT item_id, concat('**Risk: ', CAST(trunc(confidence * 100) AS INT), '%** - ',
                replace(tags, ',', ', ')) AS display FROM threat_db""",
)
def risk_display(inputs):
    return inputs.view("threat_db").select(
        "item_id", sev.risk_display(F.col("confidence"), F.col("tags")).alias("display")
    )


@query(
    "indicator_lookup",
    oracle=f"""WITH {_BEST}, c AS (SELECT alert_id, src_ip AS ip, 0 AS pos FROM alerts
          UNION ALL SELECT alert_id, dst_ip, 1 FROM alerts),
        m AS (SELECT alert_id, best.* FROM c JOIN best ON ip = indicator AND type = 'ip'
          QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY confidence DESC, pos) = 1)
      SELECT alert_id, confidence AS threat_confidence, m.severity AS threat_severity,
        description AS threat_description, tags AS threat_tags,
        CASE WHEN confidence IS NOT NULL THEN concat('**Risk: ', CAST(trunc(confidence * 100) AS INT),
          '%** - ', replace(tags, ',', ', ')) END AS threat_intel_display
      FROM alerts LEFT JOIN m USING (alert_id)""",
)
def indicator_lookup(inputs):
    alerts = inputs.view("alerts").select("alert_id", "src_ip", "dst_ip")
    return intel.enrich_alerts(alerts, inputs.view("threat_db")).drop("src_ip", "dst_ip")


@query(
    "best_match_rank",
    oracle=f"""WITH {_BEST} SELECT indicator, confidence, description FROM best""",
)
def best_match_rank(inputs):
    return intel.best_match(
        inputs.view("threat_db"), "indicator", "confidence", "item_id", "description"
    )


@query(
    "blocklist_flag",
    oracle="""SELECT packet_id, packets.src_ip, ip IS NOT NULL AS is_malicious,
        CASE WHEN ip IS NULL THEN 0e0 ELSE 100e0 END AS risk_score,
        CASE WHEN ip IS NOT NULL THEN 'local_blocklist' END AS category
      FROM packets LEFT JOIN blocklist ON packets.src_ip = ip""",
)
def blocklist_flag(inputs):
    packets = inputs.view("packets").select("packet_id", "src_ip")
    return intel.flag_blocklisted(packets, inputs.view("blocklist"))


@query(
    "blocklist_hits",
    oracle="SELECT packet_id, src_ip FROM packets WHERE src_ip IN (SELECT ip FROM blocklist)",
)
def blocklist_hits(inputs):
    packets = inputs.view("packets").select("packet_id", "src_ip")
    return intel.blocklist_hits(packets, inputs.view("blocklist"))


@query(
    "blocklist_clean",
    oracle="""SELECT packet_id, dst_ip FROM packets
              WHERE dst_ip IS NULL OR dst_ip NOT IN (SELECT ip FROM blocklist)""",
)
def blocklist_clean(inputs):
    packets = inputs.view("packets").select("packet_id", "dst_ip")
    return intel.clean_traffic(packets, inputs.view("blocklist"), column="dst_ip")


@query(
    "reputation_freshness",
    oracle=f"""WITH i AS (SELECT src_ip AS ip FROM packets WHERE src_ip IS NOT NULL
          UNION SELECT dst_ip FROM packets WHERE dst_ip IS NOT NULL),
        l AS (SELECT * FROM reputation_feeds
          QUALIFY row_number() OVER (PARTITION BY ip ORDER BY collected_at DESC, provider) = 1),
        f AS (SELECT i.ip, collected_at, provider, body, coalesce({NOW} - collected_at < 86400, FALSE) AS is_fresh FROM i LEFT JOIN l USING (ip))
      SELECT ip, collected_at, is_fresh, CASE WHEN is_fresh THEN provider END AS provider,
        CASE WHEN is_fresh THEN body END AS body FROM f""",
)
def reputation_freshness(inputs):
    addresses = graph.distinct_endpoints(inputs.view("packets"))
    return intel.fresh_reputation(addresses, inputs.view("reputation_feeds"), now=NOW)


@query(
    "reputation_worklist",
    oracle=f"""WITH i AS (SELECT src_ip AS ip FROM packets WHERE src_ip IS NOT NULL
          UNION SELECT dst_ip FROM packets WHERE dst_ip IS NOT NULL)
      SELECT ip FROM i WHERE ip NOT IN (SELECT ip FROM reputation_feeds
        WHERE {NOW} - collected_at < 86400)""",
)
def reputation_worklist(inputs):
    addresses = graph.distinct_endpoints(inputs.view("packets"))
    return intel.refresh_worklist(addresses, inputs.view("reputation_feeds"), now=NOW)


# --- term vectors and similarity ------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in similarity.STOP_WORDS)


def _tokens(table: str, key: str, text: str) -> str:
    return f"""(SELECT {key} AS id, unnest(regexp_extract_all(lower({text}),
        '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {table})"""


_MODEL = f"""tt AS (SELECT id, term, count(*) AS tf FROM {_tokens('benchmark', 'item_id', 'text')} x
    WHERE term NOT IN ({_STOP}) GROUP BY ALL),
  vocab AS (SELECT term, ln((1.0e0 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf,
      sum(tf) AS cf FROM tt GROUP BY term ORDER BY cf DESC, term LIMIT 1000),
  tw AS (SELECT id, term, tf * idf AS w FROM tt JOIN vocab USING (term)),
  tn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM tw)"""

_DOCS = f"""dt AS (SELECT id, term, count(*) * any_value(idf) AS w
    FROM {_tokens('documents', 'doc_id', 'text')} x JOIN vocab USING (term) GROUP BY id, term),
  dn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM dt)"""


@query(
    "term_statistics",
    oracle=f"""WITH x AS (SELECT id, term, count(*) AS tf FROM {_tokens('documents', 'doc_id', 'text')} x
        WHERE term NOT IN ({_STOP}) GROUP BY ALL)
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM x GROUP BY term""",
)
def term_statistics(inputs):
    return similarity.term_statistics(
        inputs.table("documents"), id_column="doc_id", text_column="text"
    )


@query(
    "tfidf_vectors",
    oracle=f"WITH {_MODEL}, {_DOCS} SELECT id AS doc_id, term, w AS weight FROM dn",
    floats="weight",
)
def tfidf_vectors(inputs):
    model = similarity.fit_terms(
        inputs.table("benchmark"), id_column="item_id", text_column="text"
    )
    return similarity.weights_long(
        model, inputs.table("documents"), id_column="doc_id", text_column="text"
    )


_PAIRS = f"""{_MODEL}, {_DOCS},
  pairs AS (SELECT dn.id AS doc_id, tn.id AS item_id, round(sum(dn.w * tn.w), 12) AS sim
            FROM dn JOIN tn ON dn.term = tn.term GROUP BY ALL),
  top1 AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, item_id) = 1)"""


@query(
    "similarity_top1",
    oracle=f"""WITH {_PAIRS} SELECT d.doc_id, coalesce(item_id, (SELECT min(item_id) FROM benchmark)) AS threat_id,
                 coalesce(sim, 0) AS similarity FROM documents d LEFT JOIN top1 USING (doc_id)""",
    floats="similarity",
)
def similarity_top1(inputs):
    return similarity.most_similar(
        inputs.table("documents"),
        inputs.table("benchmark"),
        alert_id="doc_id",
        alert_text="text",
        threat_id="item_id",
        threat_text="text",
    )


@query(
    "similarity_threshold",
    oracle=f"WITH {_PAIRS} SELECT doc_id, item_id AS threat_id FROM top1 WHERE sim > 0.7",
)
def similarity_threshold(inputs):
    best = similarity_top1(inputs)
    return best.filter(F.col("similarity") > similarity.SIMILARITY_THRESHOLD).select(
        "doc_id", "threat_id"
    )


@query(
    "threat_similarity",
    oracle=f"""WITH {_PAIRS} SELECT d.doc_id, coalesce(sim, 0) AS threat_similarity,
        coalesce(sim > 0.7, FALSE) AS threat_matched, t.type AS threat_type, t.tags AS threat_tags,
        t.severity AS threat_severity, CASE WHEN sim > 0.7 THEN sim END AS threat_confidence
      FROM documents d LEFT JOIN top1 USING (doc_id)
      LEFT JOIN threat_db t ON t.item_id = top1.item_id AND sim > 0.7""",
    floats="threat_similarity threat_confidence",
)
def threat_similarity(inputs):
    return similarity.threat_similarity(
        inputs.table("documents"), inputs.view("threat_db"), alert_id="doc_id", alert_text="text"
    )
