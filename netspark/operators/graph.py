"""The IP graph: edges, degrees and centralities as joins and aggregations.

Iterative measures work on rows (source, node). Every round is one join and one
aggregation, and its result is checkpointed to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.session import cut_lineage


def weighted_edges(packets: DataFrame, *, weight: str | None = None) -> DataFrame:
    """(src, dst, weight) per ordered pair: packets, or the sum of a column."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        drop_incomplete(packets)
        .groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))
        .agg(measure.alias("weight"))
    )


def drop_incomplete(packets: DataFrame) -> DataFrame:
    """Keep packets with both ends."""
    return packets.dropna(subset=["src_ip", "dst_ip"])


def distinct_endpoints(packets: DataFrame) -> DataFrame:
    """Every address seen at either end."""
    ends = packets.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return ends.filter(F.col("ip").isNotNull()).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, in- and out-degree over distinct edges; a self-loop counts on both sides."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("ip"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("ip"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return (
        ends.groupBy("ip")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.sum("i").alias("in_degree"),
            F.sum("o").alias("out_degree"),
        )
        .withColumn(
            "in_out_ratio", F.coalesce(F.try_divide("in_degree", "out_degree"), F.lit(0.0))
        )
    )


def join_node_metrics(packets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach node metrics for both ends, with ``src_`` and ``dst_`` names."""
    result = packets
    for side in ("src", "dst"):
        renamed = nodes.select(
            *[F.col(name).alias(f"{side}_{name}") for name in nodes.columns]
        )
        result = result.join(renamed, f"{side}_ip", "left")
    return result


def top_degree_nodes(edges: DataFrame, n: int = 50) -> DataFrame:
    """The report of the ``n`` best connected addresses."""
    return degrees(edges).orderBy(F.desc("degree"), "ip").limit(n)


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("ip").alias(side)), side, "left_semi")
    return edges.select("src", "dst", "weight")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()


def _stored(edges: DataFrame) -> DataFrame:
    """Edges as a table, so that packets are aggregated once for all the rounds."""
    return cut_lineage(edges.select("src", "dst", "weight"))


def _without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def closeness(edges: DataFrame, *, pivots: int | None = None) -> DataFrame:
    """(r / D) * (r / (n - 1)) from the hop distances of the r nodes that reach a node.

    Breadth-first search from all nodes at once; a round advances every search one hop. The table of
    distances has nodes x sources rows: ``pivots`` takes that many sources (by hash) and estimates r from
    the share of the others that reach a node.
    """
    edges = _stored(edges)
    hops = cut_lineage(_without_loops(edges).select("src", "dst").distinct())
    nodes = cut_lineage(_nodes(edges))
    n = nodes.count()
    sources = _sources(nodes, n, pivots)
    reached = sources.select(F.col("ip").alias("s"), F.col("ip").alias("v"), F.lit(0).alias("d"))
    frontier, depth = reached, 0
    while True:
        depth += 1
        step = (
            frontier.join(hops, F.col("v") == F.col("src"))
            .select("s", F.col("dst").alias("v"))
            .distinct()
            .join(reached, ["s", "v"], "left_anti")
            .withColumn("d", F.lit(depth))
        )
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    totals = (
        reached.filter(F.col("d") > 0)
        .groupBy(F.col("v").alias("ip"))
        .agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("t"))
    )
    sampled = sources.withColumn("_own", F.lit(1))
    # Sources other than the node itself, of n - 1 in all.
    others = F.lit(min(n, pivots or n)) - F.coalesce("_own", F.lit(0))
    share = (F.col("r") / F.col("t")) * (F.col("r") / F.greatest(others, F.lit(1)))
    return nodes.join(totals, "ip", "left").join(sampled, "ip", "left").select(
        "ip", F.coalesce(share, F.lit(0.0)).alias("closeness")
    )


def _sources(nodes: DataFrame, n: int, pivots: int | None) -> DataFrame:
    if pivots is None or pivots >= n:
        return nodes
    return cut_lineage(nodes.orderBy(F.xxhash64("ip")).limit(pivots))


def _shortest_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, d) for all reachable pairs; only rows that improved go into the next round."""
    known = sources.select(
        F.col("ip").alias("s"), F.col("ip").alias("v"), F.lit(0.0).alias("d")
    )
    frontier = known
    while True:
        offers = (
            frontier.join(edges, F.col("v") == F.col("src"))
            .groupBy("s", F.col("dst").alias("v"))
            .agg(F.min(F.col("d") + F.col("w")).alias("offer"))
        )
        better = (
            offers.join(known, ["s", "v"], "left")
            .filter(F.col("d").isNull() | (F.col("offer") < F.col("d")))
            .select("s", "v", F.col("offer").alias("d"))
        )
        frontier = cut_lineage(better)
        if frontier.isEmpty():
            return known
        known = cut_lineage(
            known.unionByName(frontier).groupBy("s", "v").agg(F.min("d").alias("d"))
        )


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, u, x): the share of shortest paths from s that go through u, added up over their ends.

    Path counts and dependencies are sums over the shortest-path edges of each source,
    built up hop by hop.
    """
    dist = _shortest_distances(links, sources)

    from_end = dist.select("s", F.col("v").alias("src"), F.col("d").alias("du"))
    to_end = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("dv"))
    on_path = cut_lineage(
        from_end.join(links, "src")
        .join(to_end, ["s", "dst"])
        .filter(F.col("du") + F.col("w") == F.col("dv"))
        .select("s", F.col("src").alias("u"), F.col("dst").alias("v"))
    )

    level = sources.select(
        F.col("ip").alias("s"), F.col("ip").alias("v"), F.lit(1.0).alias("c")
    )
    counted = level
    while True:
        level = cut_lineage(
            level.withColumnRenamed("v", "u")
            .join(on_path, ["s", "u"])
            .groupBy("s", "v")
            .agg(F.sum("c").alias("c"))
        )
        if level.isEmpty():
            break
        counted = counted.unionByName(level)
    sigma = cut_lineage(counted.groupBy("s", "v").agg(F.sum("c").alias("c")))

    shares = cut_lineage(
        on_path.join(sigma.select("s", F.col("v").alias("u"), F.col("c").alias("cu")), ["s", "u"])
        .join(sigma.select("s", "v", F.col("c").alias("cv")), ["s", "v"])
        .select("s", "u", "v", (F.col("cu") / F.col("cv")).alias("share"))
    )
    level = cut_lineage(shares.groupBy("s", "u").agg(F.sum("share").alias("x")))
    collected = level
    while True:
        level = cut_lineage(
            level.withColumnRenamed("u", "v")
            .join(shares, ["s", "v"])
            .groupBy("s", "u")
            .agg(F.sum(F.col("share") * F.col("x")).alias("x"))
        )
        if level.isEmpty():
            break
        collected = collected.unionByName(level)
    return collected.filter(F.col("s") != F.col("u")).groupBy("s", "u").agg(F.sum("x").alias("x"))


def _weighted_links(edges: DataFrame) -> DataFrame:
    return _without_loops(edges).select("src", "dst", F.col("weight").cast("double").alias("w"))


def betweenness(edges: DataFrame, *, pivots: int | None = None) -> DataFrame:
    """Directed betweenness with the packet count as distance, divided by (n-1)(n-2).

    The tables have nodes x sources rows: ``pivots`` takes that many sources (by hash) and scales up;
    ``sampled_betweenness`` chooses their number by a stated error.
    """
    edges = _stored(edges)
    nodes = cut_lineage(_nodes(edges))
    n = nodes.count()
    collected = _dependencies(_weighted_links(edges), _sources(nodes, n, pivots))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if pivots is not None and pivots < n:
        scale *= n / pivots
    totals = collected.groupBy(F.col("u").alias("ip")).agg(
        (F.sum("x") * F.lit(scale)).alias("betweenness")
    )
    return nodes.join(totals, "ip", "left").fillna(0.0, subset=["betweenness"])


def sampled_betweenness(
    edges: DataFrame, *, error: float = 0.05, confidence: float = 0.9, batch: int = 64
) -> DataFrame:
    """(ip, betweenness, error_bound, sources): betweenness from as many sources as a stated error needs.

    Sources are taken by their hash, about ``batch`` at a time, so tables have nodes x batch rows. Each gives
    every node a share between 0 and 1; by the empirical Bernstein bound, split over nodes and batches, the mean
    of m shares with variance v is off by at most sqrt(2 v g / m) + 3 g / m, g the logarithm of 3 / (1 -
    confidence) times nodes times batches. Sampling ends when no node's bound exceeds ``error``, or with all
    sources, when results are exact and the bound is 0.
    """
    edges = _stored(edges)
    links = cut_lineage(_weighted_links(edges))
    nodes = cut_lineage(_nodes(edges))
    n = nodes.count()
    if n < 3:
        zero = F.lit(0.0)
        return nodes.select("ip", zero.alias("betweenness"), zero.alias("error_bound"), F.lit(n).alias("sources"))
    batches = -(-n // batch)
    dealt = cut_lineage(nodes.withColumn("part", F.pmod(F.xxhash64("ip"), F.lit(batches))))
    log = math.log(3 * n * batches / (1 - confidence))
    sums = nodes.select("ip", F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
    used = 0
    for number in range(batches):
        sources = cut_lineage(dealt.filter(F.col("part") == number).select("ip"))
        size = sources.count()
        if not size:
            continue
        used += size
        share = F.col("x") / (n - 2)
        seen = _dependencies(links, sources).groupBy(F.col("u").alias("ip")).agg(
            F.sum(share).alias("a1"), F.sum(share * share).alias("a2")
        )
        sums = cut_lineage(
            sums.join(seen, "ip", "left").select(
                "ip",
                (F.col("s1") + F.coalesce("a1", F.lit(0.0))).alias("s1"),
                (F.col("s2") + F.coalesce("a2", F.lit(0.0))).alias("s2"),
            )
        )
        mean = F.col("s1") / used
        spread = F.greatest(F.col("s2") / used - mean * mean, F.lit(0.0))
        bound = F.lit(0.0) if used == n else F.sqrt(spread * (2 * log / used)) + 3 * log / used
        if used == n or sums.agg(F.max(bound)).first()[0] * n / (n - 1) <= error:
            break
    scale = n / (n - 1)  # a node is no source of paths through itself
    return sums.select(
        "ip", (mean * scale).alias("betweenness"), (bound * scale).alias("error_bound"), F.lit(used).alias("sources")
    )


def sketched_closeness(edges: DataFrame, *, lg_k: int = 12, max_rounds: int | None = None) -> DataFrame:
    """Closeness (see ``closeness``) of large graphs: a sketch of the nodes that reach each node.

    A round unites a node's sketch with those of its predecessors that grew in the round before; the growth of
    its estimated size in round t are nodes at distance t. Tables have a row per node of at most 2^lg_k bytes
    and the rounds are as many as the longest distance. Sizes up to some 2^lg_k / 11 are exact, larger ones have a
    relative standard error of about 1.04 / sqrt(2^lg_k), 1.6 % by default.
    """
    edges = _stored(edges)
    hops = cut_lineage(_without_loops(edges).select("src", "dst").distinct())
    nodes = cut_lineage(_nodes(edges))
    n = nodes.count()
    state = cut_lineage(
        nodes.groupBy("ip")
        .agg(F.hll_sketch_agg("ip", lg_k).alias("sketch"))
        .select("ip", "sketch", F.lit(1).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("grew"))
    )
    depth = 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        senders = state.filter("grew").select(F.col("ip").alias("src"), "sketch")
        offers = hops.join(senders, "src").groupBy(F.col("dst").alias("ip")).agg(
            F.hll_union_agg("sketch").alias("offer")
        )
        united = F.when(F.col("offer").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "offer"))
        sized = state.join(offers, "ip", "left").select(
            "ip", united.alias("sketch"), F.col("r").alias("before"), "t"
        ).withColumn("r", F.greatest(F.hll_sketch_estimate("sketch"), F.col("before")))
        grown = F.col("r") - F.col("before")
        state = cut_lineage(
            sized.select("ip", "sketch", "r", (F.col("t") + depth * grown).alias("t"), (grown > 0).alias("grew"))
        )
        if state.filter("grew").isEmpty():
            break
    reached = F.col("r") - 1
    share = F.try_divide(reached, F.col("t")) * (reached / max(n - 1, 1))
    return state.select("ip", F.coalesce(share, F.lit(0.0)).alias("closeness"))


def eigenvector_centrality(
    edges: DataFrame,
    *,
    max_rounds: int = 100,
    tolerance: float = 1e-6,
    rounds_per_checkpoint: int = 10,
    relative: bool = False,
) -> DataFrame:
    """Weighted in-edge eigenvector centrality by power iteration.

    Some rounds are planned together and end in one checkpoint with one test; without
    convergence the column is null and ``converged`` is false. ``relative`` divides all weights by a bound of the
    largest eigenvalue. The centrality stays what it is, but a node's own value then weighs enough in a step for
    graphs without odd cycles, whose largest eigenvalues cancel each other, to converge as well.
    """
    edges = _stored(edges)
    if relative:
        sums = [edges.groupBy(end).agg(F.sum("weight").alias("w")).agg(F.max("w")).first()[0] for end in ("src", "dst")]
        bound = min((float(w) for w in sums if w), default=1.0)
        edges = edges.withColumn("weight", F.col("weight") / F.lit(bound))
    nodes = cut_lineage(_nodes(edges))
    n = nodes.count()
    # A step is x + A'x: every node also sends itself its own value.
    own = nodes.select(
        F.col("ip").alias("src"), F.col("ip").alias("dst"), F.lit(1.0).alias("w"), F.lit(1.0).alias("own")
    )
    links = cut_lineage(
        edges.select(
            "src", "dst", F.col("weight").cast("double").alias("w"), F.lit(0.0).alias("own")
        ).unionByName(own)
    )
    state = nodes.withColumn("x", F.lit(1.0 / max(n, 1)))
    done, converged = 0, n == 0
    while done < max_rounds and not converged:
        steps = min(rounds_per_checkpoint, max_rounds - done)
        for _ in range(steps):
            state = (
                state.join(links, F.col("ip") == F.col("src"))
                .groupBy(F.col("dst").alias("ip"))
                .agg(
                    F.sum(F.col("x") * F.col("w")).alias("x"),
                    F.sum(F.col("x") * F.col("own")).alias("old"),
                )
            )
        state = cut_lineage(state)
        # Both vectors are scaled to length 1 before they are compared.
        norms = state.agg(
            F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("new"),
            F.sqrt(F.sum(F.col("old") * F.col("old"))).alias("old"),
        ).first()
        state = state.select(
            "ip",
            (F.col("x") / F.lit(norms.new)).alias("x"),
            (F.col("old") / F.lit(norms.old)).alias("old"),
        )
        change = state.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        done += steps
        converged = change < n * tolerance
    value = F.col("x") if converged else F.lit(None).cast("double")
    return state.select("ip", value.alias("eigenvector"), F.lit(converged).alias("converged"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """Undirected local clustering 2T / (d(d-1)).

    Edges point from the lower to the higher degree, so even a hub has at most
    sqrt(2m) outgoing edges and no node's neighbours are paired in full.
    """
    edges = _stored(edges)
    pairs = (
        _without_loops(edges)
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("ip"))
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("d"))
    )
    order = lambda side: F.struct(F.col(f"d_{side}"), F.col(side))
    ranked = pairs.join(degree.select(F.col("ip").alias("a"), F.col("d").alias("d_a")), "a").join(
        degree.select(F.col("ip").alias("b"), F.col("d").alias("d_b")), "b"
    )
    oriented = ranked.select(
        F.least(order("a").cast("struct<d:bigint,ip:string>"),
                order("b").cast("struct<d:bigint,ip:string>")).alias("low"),
        F.greatest(order("a").cast("struct<d:bigint,ip:string>"),
                   order("b").cast("struct<d:bigint,ip:string>")).alias("high"),
    )
    first = oriented.select("low", F.col("high").alias("m"))
    second = oriented.select("low", F.col("high").alias("t"))
    closing = oriented.select(F.col("low").alias("m"), F.col("high").alias("t"))
    triangles = (
        first.join(second, "low")
        .filter(F.col("m") < F.col("t"))
        .join(closing, ["m", "t"])
        .select(F.explode(F.array("low.ip", "m.ip", "t.ip")).alias("ip"))
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("triangles"))
    )
    possible = F.col("d") * (F.col("d") - 1)
    share = F.try_divide(F.coalesce("triangles", F.lit(0)) * 2, possible)
    return (
        _nodes(edges)
        .join(degree, "ip", "left")
        .join(triangles, "ip", "left")
        .select("ip", F.coalesce(share, F.lit(0.0)).alias("clustering"))
    )


def node_metrics(edges: DataFrame, *, pivots: int | None = None, relative: bool = False) -> DataFrame:
    """All node measures in one table; a missing eigenvector leaves the others alone.

    ``relative``: see :func:`eigenvector_centrality`.
    """
    edges = _stored(edges)
    return (
        degrees(edges)
        .join(betweenness(edges, pivots=pivots), "ip", "left")
        .join(closeness(edges, pivots=pivots), "ip", "left")
        .join(eigenvector_centrality(edges, relative=relative).drop("converged"), "ip", "left")
    )
