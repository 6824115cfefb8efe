"""Oracle SQL of principal components: a covariance matrix as nested lists, squared until one direction is left.

The power 2^SQUARINGS of a matrix has the first eigenvector as its columns; with that component taken away the next
one follows. Each component's largest entry is positive.
"""

from __future__ import annotations

SQUARINGS = 48


def component_ctes(rows: str, k: str) -> str:
    """Relations down to ``components`` (component from 1, vector, eigenvalue) of ``rows`` (id, features), ``k`` of them.

    For a statement that begins with ``WITH RECURSIVE``. ``pc_mean`` has the means of all features as a list.
    """
    largest = "list_position(diagonal, list_max(diagonal))"
    return f"""pc_long AS MATERIALIZED (SELECT id, unnest(features) AS x, generate_subscripts(features, 1) AS p FROM {rows}),
pc_mean AS MATERIALIZED (SELECT list(m ORDER BY p) AS mean FROM (SELECT p, avg(x) AS m FROM pc_long GROUP BY p)),
pc_cells AS (SELECT a.p AS i, b.p AS j, covar_samp(a.x, b.x) AS c FROM pc_long a JOIN pc_long b USING (id) GROUP BY ALL),
pc_lists AS (SELECT i, list(c ORDER BY j) AS line FROM pc_cells GROUP BY i),
pc_matrix AS MATERIALIZED (SELECT list(line ORDER BY i) AS matrix FROM pc_lists),
pc_steps(step, component, rest, power, vector, eigenvalue) AS (
  SELECT 0, 0, matrix, matrix, CAST(NULL AS DOUBLE[]), CAST(NULL AS DOUBLE) FROM pc_matrix
  UNION ALL
  SELECT * FROM (
    WITH s AS (SELECT *, list_transform(power, lambda line, i : line[i]) AS diagonal FROM pc_steps
               WHERE component < {k}),
      e AS (SELECT *, power[{largest}] AS direction FROM s),
      u AS (SELECT *, list_transform(direction, lambda x : x / sqrt(list_dot_product(direction, direction))
              * sign(list_max(direction) + list_min(direction))) AS unit FROM e),
      v AS (SELECT *, list_dot_product(unit, list_transform(rest, lambda line : list_dot_product(line, unit))) AS l FROM u),
      d AS (SELECT *, step = {SQUARINGS} AS found FROM v)
    SELECT CASE WHEN found THEN 0 ELSE step + 1 END, component + CAST(found AS INT),
      CASE WHEN found THEN list_transform(rest, lambda line, i : list_transform(line, lambda x, j : x - l * unit[i] * unit[j]))
        ELSE rest END,
      CASE WHEN found THEN list_transform(rest, lambda line, i : list_transform(line, lambda x, j : x - l * unit[i] * unit[j]))
        ELSE list_transform(power, lambda line : list_transform(power, lambda other :
          list_dot_product(line, other) / pow(list_max(diagonal), 2))) END,
      CASE WHEN found THEN unit END, CASE WHEN found THEN l END
    FROM d)),
components AS MATERIALIZED (SELECT component, vector, eigenvalue FROM pc_steps WHERE vector IS NOT NULL)"""


def projected(rows: str, columns: int, more: str = "") -> str:
    """A query of ``rows`` along the first components: id, PC1, PC2, ..."""
    parts = ", ".join(
        f"list_dot_product(list_transform(features, lambda x, i : x - mean[i]),"
        f" (SELECT vector FROM components WHERE component = {c})) AS PC{c}"
        for c in range(1, columns + 1)
    )
    return f"SELECT id, {parts}{more} FROM {rows} CROSS JOIN pc_mean"
