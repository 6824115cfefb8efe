"""Graph measures on hand-made graphs and against brute force."""

import itertools
import random

import numpy as np
import pytest

from netspark.operators import graph

PATH = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]
STAR = [("m", x, 1) for x in "abcd"] + [(x, "m", 1) for x in "abcd"]
CYCLE = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)]
TWO_PARTS = [("a", "b", 2), ("b", "a", 2), ("x", "y", 1)]
LOOP = [("a", "a", 5), ("a", "b", 1), ("b", "c", 1)]
TIES = [("s", "u", 1), ("s", "v", 1), ("u", "t", 1), ("v", "t", 1), ("t", "w", 1)]


def random_graph(seed, nodes=7, edges=16):
    generator = random.Random(seed)
    pairs = list(itertools.permutations("abcdefg"[:nodes], 2))
    return [(s, t, generator.randint(1, 3)) for s, t in generator.sample(pairs, edges)]


GRAPHS = [PATH, STAR, CYCLE, TWO_PARTS, LOOP, TIES, random_graph(1), random_graph(2)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight bigint")


def all_distances(rows, weighted):
    nodes = sorted({n for s, t, _ in rows for n in (s, t)})
    dist = {(a, b): 0 if a == b else float("inf") for a in nodes for b in nodes}
    for s, t, w in rows:
        if s != t:
            dist[s, t] = min(dist[s, t], w if weighted else 1)
    for k, i, j in itertools.product(nodes, nodes, nodes):
        dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    return nodes, dist


def brute_betweenness(rows):
    nodes, dist = all_distances(rows, True)
    links = {(s, t): w for s, t, w in rows if s != t}

    def paths(s, t):
        if s == t:
            return [[t]]
        return [
            [s] + rest
            for (u, v), w in links.items()
            if u == s and w + dist[v, t] == dist[s, t] < float("inf")
            for rest in paths(v, t)
        ]

    total = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t) if dist[s, t] < float("inf") else []
        for path in found:
            for middle in path[1:-1]:
                total[middle] += 1 / len(found)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in total.items()}


def brute_closeness(rows):
    nodes, dist = all_distances(rows, False)
    result = {}
    for v in nodes:
        reach = [dist[u, v] for u in nodes if u != v and dist[u, v] < float("inf")]
        r = len(reach)
        result[v] = (r / sum(reach)) * (r / (len(nodes) - 1)) if r else 0.0
    return result


@pytest.mark.parametrize("rows", GRAPHS)
def test_betweenness(spark, rows):
    found = {r.ip: r.betweenness for r in graph.betweenness(edges_of(spark, rows)).collect()}
    assert found == pytest.approx(brute_betweenness(rows))


@pytest.mark.parametrize("rows", GRAPHS)
def test_closeness(spark, rows):
    found = {r.ip: r.closeness for r in graph.closeness(edges_of(spark, rows)).collect()}
    assert found == pytest.approx(brute_closeness(rows))


def test_betweenness_with_all_pivots(spark):
    edges = edges_of(spark, random_graph(3))
    exact = {r.ip: r.betweenness for r in graph.betweenness(edges).collect()}
    assert {r.ip: r.betweenness for r in graph.betweenness(edges, pivots=100).collect()} == exact


def test_eigenvector(spark):
    rows = random_graph(5, edges=30)
    nodes = sorted({n for s, t, _ in rows for n in (s, t)})
    matrix = np.zeros((len(nodes), len(nodes)))
    for s, t, w in rows:
        matrix[nodes.index(s), nodes.index(t)] = w
    x = np.ones(len(nodes)) / len(nodes)
    for _ in range(200):
        x = x + matrix.T @ x
        x /= np.linalg.norm(x)
    result = graph.eigenvector_centrality(edges_of(spark, rows)).collect()
    assert all(r.converged for r in result)
    found = {r.ip: r.eigenvector for r in result}
    assert [found[n] for n in nodes] == pytest.approx(x.tolist(), abs=1e-4)


def test_eigenvector_without_convergence_is_null(spark):
    result = graph.eigenvector_centrality(edges_of(spark, PATH), max_rounds=2).collect()
    assert all(r.eigenvector is None and not r.converged for r in result)


def test_relative_weights_keep_the_eigenvector(spark):
    """A two-sided graph, whose plain rounds swing; both sides are weighted by the same vector."""
    rows = [(f"a{i}", f"b{j}", 500 + i * 7 + j) for i in range(4) for j in range(3)]
    rows += [(b, a, w) for a, b, w in rows]
    nodes = sorted({n for s, _, _ in rows for n in (s,)})
    matrix = np.zeros((len(nodes), len(nodes)))
    for s, t, w in rows:
        matrix[nodes.index(s), nodes.index(t)] = w
    values, vectors = np.linalg.eigh(matrix)
    expected = np.abs(vectors[:, np.argmax(values)])
    assert not graph.eigenvector_centrality(edges_of(spark, rows)).first().converged
    result = graph.eigenvector_centrality(edges_of(spark, rows), relative=True).collect()
    found = {r.ip: r.eigenvector for r in result if r.converged}
    assert [found[n] for n in nodes] == pytest.approx(expected.tolist(), abs=1e-5)
    assert graph.eigenvector_centrality(edges_of(spark, rows).limit(0), relative=True).count() == 0


def test_clustering(spark):
    square = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("a", "c", 1), ("c", "a", 9), ("z", "a", 1)]
    found = {r.ip: r.clustering for r in graph.clustering_coefficient(edges_of(spark, square)).collect()}
    assert found == pytest.approx({"a": 2 * 2 / 12, "b": 1.0, "c": 2 * 2 / 6, "d": 1.0, "z": 0.0})


def test_self_loop_counts_twice(spark):
    found = {r.ip: (r.degree, r.in_degree, r.out_degree) for r in graph.degrees(edges_of(spark, LOOP)).collect()}
    assert found == {"a": (3, 1, 2), "b": (2, 1, 1), "c": (1, 1, 0)}


def test_node_metrics_keeps_others_when_eigenvector_fails(spark):
    table = graph.node_metrics(edges_of(spark, TIES)).collect()
    assert len(table) == 5 and all(r.closeness is not None for r in table)


def random_edges(spark, nodes, degree, seed):
    draw = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a in range(nodes) for b in draw.integers(0, nodes, degree) if a != b}
    rows = [(f"n{a}", f"n{b}", int(draw.integers(1, 4))) for a, b in sorted(pairs)]
    return spark.createDataFrame(rows, "src string, dst string, weight bigint")


def test_sketches_keep_their_error(spark):
    """With 2^9 bytes sizes beyond some 45 nodes are estimates, with a standard error of 4.6 %."""
    edges = random_edges(spark, 300, 3, 1)
    exact = {r.ip: r.closeness for r in graph.closeness(edges).collect()}
    small = {r.ip: r.closeness for r in graph.sketched_closeness(edges, lg_k=9).collect()}
    whole = {r.ip: r.closeness for r in graph.sketched_closeness(edges).collect()}
    assert small.keys() == whole.keys() == exact.keys()
    assert whole == pytest.approx(exact, rel=1e-9)
    off = [abs(small[k] - v) / v for k, v in exact.items() if v]
    # Closeness goes with the square of a size, so its error is twice as large.
    assert np.sqrt(np.mean(np.square(off))) < 2 * 0.046 and max(off) < 8 * 0.046


def test_sketched_closeness_of_odd_graphs(spark):
    rows = [("a", "b", 1), ("b", "a", 1), ("c", "c", 1), ("d", "e", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight bigint")
    found = {r.ip: r.closeness for r in graph.sketched_closeness(edges).collect()}
    assert found == pytest.approx({r.ip: r.closeness for r in graph.closeness(edges).collect()})
    assert graph.sketched_closeness(edges.where("false")).count() == 0


def test_sampled_betweenness_keeps_its_bound(spark):
    edges = random_edges(spark, 120, 2, 2)
    exact = {r.ip: r.betweenness for r in graph.betweenness(edges).collect()}
    rows = graph.sampled_betweenness(edges, error=0.6, batch=30).collect()
    assert rows[0].sources < 120 and max(r.error_bound for r in rows) <= 0.6
    assert all(abs(r.betweenness - exact[r.ip]) <= r.error_bound for r in rows)
    every = graph.sampled_betweenness(edges, error=0.01, batch=50).collect()
    assert {r.error_bound for r in every} == {0.0} and {r.sources for r in every} == {120}
    assert {r.ip: r.betweenness for r in every} == pytest.approx(exact)
