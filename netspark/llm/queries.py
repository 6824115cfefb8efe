"""The registered queries of this package: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.llm import chunks, codebooks, divergence, forest_join, licenses, nearest_tiles, packing, pieces, quality, sharding, templates, url_rules, wavelet
from netspark.llm.workers import prepared, table
from netspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The id behind each document.
END_ID = 1

#: (host, path, action)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learnable())
    return quality.with_scores(docs, model, with_text=False).select(
        "doc_id",
        (~quality.learnable()).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, "url", ["page_id"])


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{0}', '{1}')".format(
    url_rules.UPPER, url_rules.LOWER
)
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in URL_RULES)
ORACLES["op2_url_rules"] = f"""
WITH rules(rule_host, rule_path, act) AS (VALUES {_RULE_ROWS}),
parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, host, path,
  (SELECT rule_host || rule_path FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
   ORDER BY length(rule_host) + length(rule_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT act FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
   ORDER BY length(rule_host) + length(rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, with_ids=False)


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the counts of the eight shards are at most one apart."""
    prepared(spark)
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        "source",
    )
    placed = sharding.interleave(docs, "source", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "fractional_rank",
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "wavelet")
    wavelet.write_shards(docs, path, TOKENIZER, END_ID)
    return wavelet.read_documents(docs, path)


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest_join.similar_texts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents")).drop("row_key")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50; candidates: every other row."""
    return nearest_tiles.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
lang_terms AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM lang_terms GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n
  FROM words w JOIN lang_terms t ON w.lang = t.lang AND w.term = t.term GROUP BY w.lang, w.source, w.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(k.total, 0) + s.v) AS p,
    1 + (1000000000 * (t.n + 1)) // (s.total + s.v) AS q
  FROM groups g
  JOIN sizes s ON g.lang = s.lang
  JOIN lang_terms t ON g.lang = t.lang
  LEFT JOIN totals k ON g.lang = k.lang AND g.source = k.source
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND t.term = c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts, 256 entries each, four rounds."""
    found = codebooks.codes(spark, table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")


def _lloyd_sql(parts: int, size: int, rounds: int, scale: int) -> str:
    """All rounds written out with complete comparisons; a distance and its entry are one number."""
    steps = [
        f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
numbered AS (
  SELECT rid, len(embedding) // {parts} AS width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place
  FROM kept),
x AS MATERIALIZED (
  SELECT rid, place // width AS part, place % width AS pos, floor({scale} * x::DOUBLE)::BIGINT AS v FROM numbered),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, v FROM x WHERE rid <= {size})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, min(d * 256 + entry) AS best
  FROM (SELECT x.rid, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d
        FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY x.rid, x.part, c.entry)
  GROUP BY rid, part)"""
        )
        if k < rounds:
            steps.append(
                f"""
s{k} AS MATERIALIZED (
  SELECT x.part, a.best % 256 AS entry, x.pos, sum(x.v)::BIGINT AS s, count(*) AS n
  FROM x JOIN a{k} a ON x.rid = a.rid AND x.part = a.part GROUP BY x.part, a.best % 256, x.pos),
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.v)::BIGINT AS v
  FROM c{k} c LEFT JOIN s{k} s ON c.part = s.part AND c.entry = s.entry AND c.pos = s.pos)"""
            )
    steps.append(
        f"""
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  h AS codebooks_sha256, label::VARCHAR AS label
FROM kept JOIN coded USING (rid), books
"""
    )
    return ",".join(steps[:-1]) + "," + steps[-1]


ORACLES["op12_vector_codes"] = _lloyd_sql(parts=4, size=256, rounds=4, scale=1024)


@query
def op13_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, PIECES)
