"""Oracle SQL of the isolation forest: trees grow level by level as relations, and rows fall through them.

A split lies at a share of a feature's range, so scaling the features changes neither the trees nor the scores;
the oracle grows them on unscaled features.
"""

from __future__ import annotations

from netspark.ml.forest import AUTO_OFFSET, DRAWS, SAMPLE_ROWS, SEED, TREES

LEVELS = (SAMPLE_ROWS - 1).bit_length()


def _average_path(n: str) -> str:
    return (
        f"CASE WHEN {n} <= 1 THEN 0.0e0 WHEN {n} = 2 THEN 1.0e0 ELSE 2.0e0 * (ln({n} - 1.0e0) + 0.5772156649015329e0)"
        f" - 2.0e0 * ({n} - 1.0e0) / {n} END"
    )


def forest_ctes(train: str, rows: str, contamination: float | None = None) -> str:
    """Relations down to ``forest_scores`` (id, anomaly_score) of ``rows`` by a forest grown on ``train``.

    Both are names of relations with id and features. ``contamination``: the offset is that quantile of the
    scores of ``train``.
    """
    parts = [
        f"fo_trees AS (SELECT unnest(range({TREES})) AS tree)",
        f"fo_size AS (SELECT least({SAMPLE_ROWS}, count(*)) AS n, greatest(1, ceil(log2(greatest(2, least({SAMPLE_ROWS},"
        f" count(*)))))) AS depth FROM {train})",
        f"fo_s0 AS MATERIALIZED (SELECT tree, id, 0 AS node FROM fo_trees CROSS JOIN {train} QUALIFY row_number() OVER"
        f" (PARTITION BY tree ORDER BY md5(concat('{SEED}-', tree, '-', id)), id) <= {SAMPLE_ROWS})",
    ]
    for k in range(LEVELS):
        parts += [
            f"fo_r{k} AS (SELECT tree, node, position, min(x) AS low, max(x) AS high FROM (SELECT tree, node,"
            f" unnest(features) AS x, generate_subscripts(features, 1) AS position FROM fo_s{k} JOIN {train} USING (id))"
            f" GROUP BY ALL HAVING max(x) > min(x))",
            f"fo_u{k} AS (SELECT tree, node, list({{'p': position, 'low': low, 'high': high}} ORDER BY position) AS usable,"
            f" md5(concat('{SEED}-', tree, '-node-', node)) AS digest FROM fo_r{k} WHERE {k} < (SELECT depth FROM fo_size)"
            f" GROUP BY tree, node)",
            f"fo_d{k} AS (SELECT tree, node, usable[CAST('0x' || substr(digest, 25) AS BIGINT) % len(usable) + 1] AS s,"
            f" CAST('0x' || substr(digest, 1, 13) AS BIGINT) / {DRAWS}.0e0 AS share FROM fo_u{k})",
            f"fo_n{k} AS MATERIALIZED (SELECT tree, node, s.p AS p, CASE WHEN s.low + share * (s.high - s.low) < s.high"
            f" THEN s.low + share * (s.high - s.low) ELSE s.low END AS threshold FROM fo_d{k})",
            f"fo_s{k + 1} AS MATERIALIZED (SELECT tree, id, 2 * node + CASE WHEN features[p] <= threshold THEN 1 ELSE 2 END"
            f" AS node FROM fo_s{k} JOIN fo_n{k} USING (tree, node) JOIN {train} USING (id))",
        ]
    leaves = [
        f"SELECT tree, node, {k} + {_average_path('count(*)')} AS path FROM fo_s{k}"
        + (f" ANTI JOIN fo_n{k} USING (tree, node)" if k < LEVELS else "")
        + " GROUP BY tree, node"
        for k in range(LEVELS + 1)
    ]
    parts.append(f"fo_leaves AS MATERIALIZED ({' UNION ALL '.join(leaves)})")
    parts += _scored(rows, "q") if rows == train else _scored(train, "t") + _scored(rows, "q")
    offset = f"{AUTO_OFFSET}e0"
    if contamination is not None:
        offset = f"(SELECT quantile_cont(raw, {contamination}) FROM fo_raw_{'q' if rows == train else 't'})"
    parts.append(f"forest_scores AS (SELECT id, raw - ({offset}) AS anomaly_score FROM fo_raw_q)")
    return ",\n".join(parts)


def _scored(rows: str, tag: str) -> list[str]:
    """Rows fall level by level; path lengths are added in the order of the trees."""
    parts = [f"fo_{tag}0 AS (SELECT tree, id, 0 AS node FROM fo_trees CROSS JOIN {rows})"]
    for k in range(LEVELS):
        parts.append(
            f"fo_{tag}{k + 1} AS MATERIALIZED (SELECT tree, id, CASE WHEN p IS NULL THEN node"
            f" WHEN features[p] <= threshold THEN 2 * node + 1 ELSE 2 * node + 2 END AS node"
            f" FROM fo_{tag}{k} LEFT JOIN fo_n{k} USING (tree, node) JOIN {rows} USING (id))"
        )
    parts.append(
        f"fo_raw_{tag} AS MATERIALIZED (SELECT id, -pow(2.0e0, -(list_reduce(list(path ORDER BY tree), lambda a, b : a + b)"
        f" / {TREES}) / ({_average_path('(SELECT n FROM fo_size)')})) AS raw"
        f" FROM fo_{tag}{LEVELS} JOIN fo_leaves USING (tree, node) GROUP BY id)"
    )
    return parts


#: Columns of a detector's verdict.
VERDICT = (
    "id, anomaly_score, CASE WHEN anomaly_score < 0 THEN -1 ELSE 1 END AS prediction, anomaly_score < 0 AS is_anomaly"
)
