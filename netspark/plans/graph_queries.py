"""The IP graph."""

from pyspark.sql import functions as F

from netspark.operators import graph
from netspark.plans.registry import query


def _edges(inputs):
    return graph.weighted_edges(inputs.view("packets"))


@query("weighted_edges", oracle="SELECT * FROM edges")
def weighted_edges(inputs):
    return _edges(inputs)


@query(
    "weighted_edges_bytes",
    oracle="""SELECT src_ip AS src, dst_ip AS dst, CAST(sum(length) AS BIGINT) AS weight FROM packets
              WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY src_ip, dst_ip""",
)
def weighted_edges_bytes(inputs):
    return graph.weighted_edges(inputs.view("packets"), weight="length")


@query(
    "valid_edge_filter",
    oracle="""SELECT packet_id, src_ip, dst_ip FROM packets
              WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL""",
)
def valid_edge_filter(inputs):
    return graph.drop_incomplete(inputs.view("packets")).select("packet_id", "src_ip", "dst_ip")


@query(
    "distinct_endpoints",
    oracle="""SELECT src_ip AS ip FROM packets WHERE src_ip IS NOT NULL
              UNION SELECT dst_ip FROM packets WHERE dst_ip IS NOT NULL""",
)
def distinct_endpoints(inputs):
    return graph.distinct_endpoints(inputs.view("packets"))


_NODES = """p AS (SELECT src AS ip, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
  nodes AS (SELECT ip, count(*) AS degree, CAST(sum(i) AS BIGINT) AS in_degree,
    CAST(sum(o) AS BIGINT) AS out_degree, coalesce(sum(i) / nullif(CAST(sum(o) AS DOUBLE), 0), 0)
    AS in_out_ratio FROM p GROUP BY ip)"""


@query(
    "top_degree_nodes",
    oracle=f"WITH {_NODES} SELECT * FROM nodes ORDER BY degree DESC, ip LIMIT 50",
    floats="in_out_ratio",
)
def top_degree_nodes(inputs):
    return graph.top_degree_nodes(_edges(inputs), 50)


@query(
    "induced_subgraph",
    oracle=f"""WITH {_NODES}, t AS (SELECT ip FROM nodes ORDER BY degree DESC, ip LIMIT 8)
      SELECT * FROM edges WHERE src IN (SELECT ip FROM t) AND dst IN (SELECT ip FROM t)""",
)
def induced_subgraph(inputs):
    edges = _edges(inputs)
    return graph.induced_subgraph(edges, graph.top_degree_nodes(edges, 8))


_CLOSENESS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
        nodes AS (SELECT src AS ip FROM edges UNION SELECT dst FROM edges),
        walk(s, v, d) AS (SELECT ip, ip, 0 FROM nodes
          UNION SELECT s, dst, d + 1 FROM walk JOIN e ON v = src WHERE d < 24),
        best AS (SELECT s, v, min(d) AS d FROM walk GROUP BY s, v HAVING min(d) > 0),
        t AS (SELECT v AS ip, count(*) AS r, sum(d) AS total FROM best GROUP BY v)
      SELECT ip, coalesce(CAST(r AS DOUBLE) / total * r / ((SELECT count(*) FROM nodes) - 1), 0) AS closeness
      FROM nodes LEFT JOIN t USING (ip)"""


@query("closeness", oracle=_CLOSENESS, floats="closeness")
def closeness(inputs):
    return graph.closeness(_edges(inputs))


@query("closeness_sketched", oracle=_CLOSENESS, floats="closeness")
def closeness_sketched(inputs):
    """Sketches of so few nodes are exact."""
    return graph.sketched_closeness(_edges(inputs))


def _betweenness_sql(doublings: int = 5, hops: int = 23) -> str:
    """All-pairs form: distances by repeated min-plus products, path counts hop by hop,
    then the share of shortest paths through each node, for graphs of up to ``hops + 1`` nodes."""
    steps = [
        "e AS MATERIALIZED (SELECT src, dst, CAST(weight AS DOUBLE) AS w FROM edges WHERE src <> dst)",
        "nodes AS MATERIALIZED (SELECT src AS ip FROM edges UNION SELECT dst FROM edges)",
        """d0 AS MATERIALIZED (SELECT src AS s, dst AS v, w AS d FROM e
           UNION ALL SELECT ip, ip, 0 FROM nodes)""",
    ]
    for i in range(doublings):
        steps.append(
            f"""d{i + 1} AS MATERIALIZED (SELECT a.s, b.v, min(a.d + b.d) AS d
                FROM d{i} a JOIN d{i} b ON a.v = b.s GROUP BY a.s, b.v)"""
        )
    dist = f"d{doublings}"
    steps.append(
        f"""dag AS MATERIALIZED (SELECT x.s, e.src AS u, e.dst AS v FROM {dist} x JOIN e ON e.src = x.v
            JOIN {dist} y ON y.s = x.s AND y.v = e.dst AND x.d + e.w = y.d)"""
    )
    steps.append("c0 AS MATERIALIZED (SELECT ip AS s, ip AS v, 1.0e0 AS c FROM nodes)")
    for i in range(hops):
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (SELECT p.s, g.v, sum(p.c) AS c FROM c{i} p
                JOIN dag g ON g.s = p.s AND g.u = p.v GROUP BY p.s, g.v)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(hops + 1))
    steps.append(f"sigma AS MATERIALIZED (SELECT s, v, sum(c) AS c FROM ({union}) GROUP BY s, v)")
    steps.append(
        f"""through AS (SELECT a.v AS ip, sum(sa.c * sb.c / st.c) AS x
            FROM {dist} a JOIN {dist} b ON b.s = a.v JOIN {dist} t ON t.s = a.s AND t.v = b.v AND a.d + b.d = t.d
            JOIN sigma sa ON sa.s = a.s AND sa.v = a.v JOIN sigma sb ON sb.s = b.s AND sb.v = b.v
            JOIN sigma st ON st.s = a.s AND st.v = b.v
            WHERE a.s <> a.v AND b.s <> b.v AND a.s <> b.v GROUP BY a.v)"""
    )
    return f"""WITH {", ".join(steps)} SELECT ip, coalesce(x, 0) / ((SELECT count(*) FROM nodes) - 1.0e0)
      / ((SELECT count(*) FROM nodes) - 2.0e0) AS betweenness FROM nodes LEFT JOIN through USING (ip)"""


@query("betweenness", oracle=_betweenness_sql(), floats="betweenness")
def betweenness(inputs):
    return graph.betweenness(_edges(inputs))


@query("betweenness_sampled", oracle=_betweenness_sql(), floats="betweenness")
def betweenness_sampled(inputs):
    """An error that so few nodes cannot promise: all sources are taken, in batches."""
    found = graph.sampled_betweenness(_edges(inputs), error=0.001, batch=12)
    return found.filter(F.col("error_bound") == 0).select("ip", "betweenness")


def _eigenvector_sql(relative: bool) -> str:
    """Rounds on a matrix as nested lists; every tenth one is tested."""
    most = "SELECT max(w) FROM (SELECT sum(weight) AS w FROM edges GROUP BY {})"
    bound = f"least(({most.format('src')}), ({most.format('dst')}))" if relative else "1.0e0"
    length = "sqrt(list_dot_product({0}, {0}))".format
    return f"""WITH RECURSIVE nodes AS (SELECT src AS ip FROM edges UNION SELECT dst FROM edges),
        cells AS (SELECT i.ip AS i, j.ip AS j, CASE WHEN i.ip = j.ip THEN 1.0e0 ELSE 0.0e0 END
            + coalesce(weight, 0) / CAST({bound} AS DOUBLE) AS c
          FROM nodes i CROSS JOIN nodes j LEFT JOIN edges ON src = j.ip AND dst = i.ip),
        lines AS (SELECT i, list(c ORDER BY j) AS line FROM cells GROUP BY i),
        m AS MATERIALIZED (SELECT list(line ORDER BY i) AS m, list(i ORDER BY i) AS ips FROM lines),
        rounds(round, x, change) AS (
          SELECT 0, list_transform(ips, lambda ip : 1.0e0 / len(ips)), 1.0e0 FROM m
          UNION ALL
          SELECT round + 1, list_transform(y, lambda a : a / {length("y")}), list_sum(list_transform(y, lambda a, i :
            abs(a / {length("y")} - x[i] / {length("x")})))
          FROM (SELECT round, x, list_transform(m, lambda line : list_dot_product(line, x)) AS y FROM rounds CROSS JOIN m
                WHERE round < 100)),
        found AS (SELECT x FROM rounds WHERE round > 0 AND round % 10 = 0 AND change < len(x) * 1e-6 ORDER BY round LIMIT 1)
      SELECT unnest(ips) AS ip, unnest(coalesce((SELECT x FROM found), list_transform(ips, lambda ip : CAST(NULL AS DOUBLE))))
        AS eigenvector, (SELECT count(*) FROM found) > 0 AS converged FROM m"""


@query("eigenvector_centrality", oracle=_eigenvector_sql(relative=False), floats="eigenvector")
def eigenvector_centrality(inputs):
    return graph.eigenvector_centrality(_edges(inputs))


@query("eigenvector_centrality_relative", oracle=_eigenvector_sql(relative=True), floats="eigenvector")
def eigenvector_centrality_relative(inputs):
    """The same centrality by weights that let this graph, which is almost bipartite, converge."""
    return graph.eigenvector_centrality(_edges(inputs), relative=True)


_MEASURES = ("degree", "in_degree", "out_degree", "in_out_ratio", "betweenness", "closeness", "eigenvector")
_ENDS = ", ".join(f"{side}.{name} AS {side}_{name}" for side in ("src", "dst") for name in _MEASURES)


@query(
    "node_metrics_join_all",
    oracle=f"""WITH {_NODES}, measures AS MATERIALIZED (SELECT * FROM nodes JOIN ({_betweenness_sql()}) b USING (ip)
          JOIN ({_CLOSENESS}) c USING (ip) JOIN ({_eigenvector_sql(relative=True)}) v USING (ip))
      SELECT packet_id, src_ip, dst_ip, {_ENDS} FROM packets LEFT JOIN measures src ON src.ip = src_ip
      LEFT JOIN measures dst ON dst.ip = dst_ip""",
    floats=" ".join(f"{side}_{name}" for side in ("src", "dst") for name in _MEASURES[3:]),
)
def node_metrics_join_all(inputs):
    """Every measure at both ends of each packet."""
    packets = inputs.view("packets")
    measures = graph.node_metrics(graph.weighted_edges(packets), relative=True)
    joined = graph.join_node_metrics(packets.select("packet_id", "src_ip", "dst_ip"), measures)
    return joined.drop("src_converged", "dst_converged")


@query(
    "clustering_coefficient",
    oracle="""WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
        nodes AS (SELECT src AS ip FROM edges UNION SELECT dst FROM edges),
        both_ways AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u),
        deg AS (SELECT x AS ip, count(*) AS d FROM both_ways GROUP BY x),
        tri AS (SELECT p.x AS ip, count(*) AS t FROM both_ways p JOIN both_ways q ON p.x = q.x AND p.y < q.y
                JOIN u ON u.a = p.y AND u.b = q.y GROUP BY p.x)
      SELECT ip, coalesce(2.0e0 * coalesce(t, 0) / nullif(d * (d - 1), 0), 0) AS clustering
      FROM nodes LEFT JOIN deg USING (ip) LEFT JOIN tri USING (ip)""",
    floats="clustering",
)
def clustering_coefficient(inputs):
    return graph.clustering_coefficient(_edges(inputs))
