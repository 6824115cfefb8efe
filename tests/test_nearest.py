"""Searches that leave pairs out: inverted index of descriptions, metric index of vectors."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.ml.outlier_factor import OutlierFactor
from netspark.operators import metric_index as mi
from netspark.operators import similarity as sim

OPTIONS = dict(alert_id="doc_id", alert_text="text", threat_id="item_id", threat_text="text")


def descriptions(seed, rows, words):
    """Common and rare words; some texts repeat."""
    draw = np.random.default_rng(seed)
    names = [f"w{k:03d}" for k in range(words)]
    chance = 1 / np.arange(1, words + 1)
    texts = [" ".join(draw.choice(names, draw.integers(1, 12), p=chance / chance.sum())) for _ in range(rows)]
    return [texts[i // 3] if i % 5 == 0 else t for i, t in enumerate(texts)]


def best_by_hand(model, alerts, threats):
    places = {t: k for k, t in enumerate(model.terms)}

    def row(text):
        out = np.zeros(len(places))
        for word in (text or "").lower().split():
            if word in places:
                out[places[word]] += model.idf[places[word]]
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out

    right = np.array([row(t) for t in threats])
    scores = np.round(np.array([row(t) for t in alerts]) @ right.T, 12)
    return [(int(k), scores[i, k]) for i, k in enumerate(scores.argmax(axis=1))]


@pytest.mark.parametrize("champions, salt_rows", [(64, 10_000), (1, 3), (3, 1_000)])
def test_inverted_index_is_exact(spark, champions, salt_rows):
    threats, alerts = descriptions(1, 150, 60), [*descriptions(2, 120, 60), None, "", "unknown words only"]
    right = spark.createDataFrame(list(enumerate(threats)), "item_id long, text string").repartition(3)
    left = spark.createDataFrame(list(enumerate(alerts)), "doc_id long, text string").repartition(3)
    model = sim.fit_terms(right, id_column="item_id", text_column="text")
    found = {
        r.doc_id: (r.threat_id, r.similarity)
        for r in sim.most_similar(left, right, champions=champions, salt_rows=salt_rows, **OPTIONS).collect()
    }
    expected = best_by_hand(model, alerts, threats)
    assert len(found) == len(alerts)
    for k, (item, score) in enumerate(expected):
        assert found[k] == (item, pytest.approx(score, abs=1e-11)), k


def test_prefix_leaves_terms_out(spark):
    """A threat that an alert copies settles most of its terms: few are looked up beyond the strongest."""
    texts = [" ".join(f"w{(k * j) % 40:02d}" for j in range(1, 9)) for k in range(1, 200)]
    right = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    model = sim.fit_terms(right, id_column="item_id", text_column="text")
    index = sim.TermIndex.build(model, right, id_column="item_id", text_column="text", champions=8)
    assert len(index.ids) <= 8 * len(model.terms) and len(index.weights) <= 8 * len(model.terms)
    assert index.rest.count() == sim._long(index.rows, "right_id").count() - len(index.weights)
    rows = sim.sparse_rows(model, right.limit(50), "text").withColumn("row", F.col("item_id"))
    rows = rows.select("row", "terms", "weights")
    shared = sim.TermIndex(index.ids, index.offsets, index.places, index.weights, index.others, None, None, None, None)
    seen = rows.mapInArrow(sim._search(shared), sim._SEARCHED).collect()
    looked_up = sum(len(r.probes or []) for r in seen)
    occurring = sum(len(r.terms) for r in rows.collect())
    assert 0 < looked_up < occurring


def test_sparse_rows_have_occurring_terms_only(spark):
    right = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "item_id long, text string")
    model = sim.fit_terms(right, id_column="item_id", text_column="text")
    rows = sim.sparse_rows(model, right, "text").collect()
    assert [list(r.terms) for r in rows] == [[0, 1], [1, 2]]
    assert all(len(r.weights) == 2 and sum(w * w for w in r.weights) == pytest.approx(1) for r in rows)


def test_no_threats_and_no_alerts(spark):
    some = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    none = some.where("false").withColumnRenamed("doc_id", "item_id")
    assert [tuple(r) for r in sim.most_similar(some, none, **OPTIONS).orderBy("doc_id").collect()] == [
        (1, None, None), (2, None, None)]
    right = some.withColumnRenamed("doc_id", "item_id")
    assert sim.most_similar(some.where("false"), right, **OPTIONS).count() == 0


def points(spark, values):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def nearest_by_hand(left, right, k, skip_self):
    d = np.round(np.sqrt(((left[:, None, :] - right[None, :, :]) ** 2).sum(2)), 12)
    if skip_self:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {
        (i, int(j), round(float(d[i, j]), 9)) for i in range(len(left)) for j in order[i] if d[i, j] < np.inf
    }


@pytest.mark.parametrize("max_pivots, block_rows", [(256, 4096), (5, 17), (1, 40)])
@pytest.mark.parametrize("kind", ["clusters", "ties", "copies"])
def test_metric_index_is_exact(spark, kind, max_pivots, block_rows):
    draw = np.random.default_rng(3)
    if kind == "clusters":
        values = np.concatenate([draw.normal(c, 0.3, (60, 3)) for c in (0, 5, 20)])
    elif kind == "ties":
        values = draw.integers(0, 3, (150, 2)).astype(float)
    else:
        values = np.concatenate([np.zeros((90, 2)), draw.normal(0, 1, (60, 2))])
    df = points(spark, values).repartition(3)
    index = mi.MetricIndex.build(df, neighbours=8, max_pivots=max_pivots)
    found = mi.nearest_links(df, index, k=7, skip_self=True, block_rows=block_rows).collect()
    assert {(r.id, r.right_id, round(r.distance, 9)) for r in found} == nearest_by_hand(values, values, 7, True)
    other = np.concatenate([values[:20], draw.normal(2, 4, (20, values.shape[1]))])
    found = mi.nearest_links(points(spark, other), index, k=8, block_rows=block_rows).collect()
    assert {(r.id, r.right_id, round(r.distance, 9)) for r in found} == nearest_by_hand(other, values, 8, False)


def test_only_cells_in_reach_are_visited(spark):
    draw = np.random.default_rng(4)
    values = np.concatenate([draw.normal(10 * c, 0.5, (50, 3)) for c in range(12)])
    df = points(spark, values)
    index = mi.MetricIndex.build(df, neighbours=6, max_pivots=24)
    queries = df.select(F.col("id").alias("q"), "vector")
    own, visits = mi.visited(queries, index)
    assert own.groupBy("q").count().count() == len(values)
    cells = len(index.bounds.pivots)
    compared = len(values) + visits.count()
    assert compared < 0.25 * len(values) * cells
    # Far clusters are out of every reach.
    assert visits.groupBy("q").count().agg(F.max("count")).first()[0] < cells / 2


def test_few_or_no_rows(spark):
    df = points(spark, np.array([[1.0, 2.0], [3.0, 4.0]]))
    index = mi.MetricIndex.build(df, neighbours=6)
    assert sorted((r.id, r.right_id) for r in mi.nearest_links(df, index, k=5, skip_self=True).collect()) == [(0, 1), (1, 0)]
    none = mi.MetricIndex.build(df.where("false"), neighbours=6)
    assert mi.nearest_links(df, none, k=5).count() == 0
    assert mi.nearest_links(df.where("false"), index, k=5).count() == 0


def test_products_leave_no_neighbour_out():
    """Rows far from the origin, of unequal size, close together, without a finite length: as compared one by one."""
    draw = np.random.default_rng(5)
    plain = draw.normal(0, 1, (3000, 6))
    cases = [plain, plain + 1e6, plain * 1e-7, plain * 1e20, plain * 10.0 ** draw.integers(-3, 6, (3000, 1)),
             draw.integers(0, 3, (3000, 6)).astype(float), plain[:30]]
    odd = plain.copy()
    odd[::700, 2], odd[5, 0] = np.nan, np.inf
    for values in [*cases, odd]:
        queries = values[:40]
        with np.errstate(invalid="ignore", over="ignore"):
            exact = np.round(mi.distances(queries, values), mi.DIGITS)
        reach = np.full(len(queries), np.inf)
        reach[::2] = np.nanmedian(exact[::2], axis=1)
        found = set(zip(*(x.tolist() for x in mi._Points(values).candidates(queries, reach, 5))))
        for i, row in enumerate(exact):
            last = min(np.sort(row[np.isfinite(row)], kind="stable")[:5].max(initial=-1.0), reach[i])
            assert {(i, int(j)) for j in np.flatnonzero(row <= last)} <= found
        if values is plain:
            assert len(found) < 10 * len(queries)


def test_blocks_travel_once_per_block(spark):
    """Where no bound leaves cells out, a query visits blocks of many cells, not one cell after the other."""
    values = np.random.default_rng(6).normal(0, 1, (900, 24))
    df = points(spark, values).repartition(3)
    index = mi.MetricIndex.build(df, neighbours=6)
    _, visits = mi.visited(df.select(F.col("id").alias("q"), "vector"), index, 300)
    assert visits.count() <= 4 * len(values) < len(values) * len(index.bounds.pivots) / 4


def test_searched_vectors_are_not_searched_again(spark, monkeypatch):
    values = np.random.default_rng(7).normal(0, 1, (60, 3))
    df = points(spark, values)
    factor = OutlierFactor.fit(df, k=5)
    asked = []
    search = mi.visited
    monkeypatch.setattr(mi, "visited", lambda q, *rest: (asked.append(q.count()), search(q, *rest))[1])
    more = points(spark, np.concatenate([values[:20], values[:4] + 0.5]))
    found = {r.id: r.raw for r in factor.raw_scores(more).collect()}
    assert asked == [4]
    alone = {r.id: r.raw for r in replace(factor, lists=None).raw_scores(more).collect()}
    assert asked == [4, 24] and found == pytest.approx(alone)


def test_terms_of_repeated_ids_and_of_single_rows(spark):
    rows = [(1, "alpha beta alpha the"), (2, "Beta gamma"), (2, "beta delta"), (None, "alpha"), (None, "alpha"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sim.term_statistics(df, id_column="doc_id", text_column="text")
    assert found.columns == ["term", "df", "cf"]
    assert {r.term: (r.df, r.cf) for r in found.collect()} == {
        "alpha": (2, 4), "beta": (2, 3), "gamma": (1, 1), "delta": (1, 1)}


def test_terms_of_single_rows_are_not_shuffled_by_document(spark, tmp_path):
    """Words of rows whose id does not repeat are shuffled once, as terms."""
    df = spark.createDataFrame([(k, "alpha beta " * 50) for k in range(40)], "doc_id long, text string")
    found = sim.term_statistics(df, id_column="doc_id", text_column="text")
    assert {tuple(r) for r in found.collect()} == {("alpha", 40, 2000), ("beta", 40, 2000)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(term" in plan and "hashpartitioning(_doc" not in plan
