"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names in every operator."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from netspark.llm import chunks, forest_join, licenses, nearest_tiles, packing, quality, sharding, templates
from netspark.llm import url_rules, wavelet
from netspark.llm.queries import END_ID, TOKENIZER
from netspark.session import scratch_path
from tests.llm.conftest import CLASHING, LONG, ODD, text


def labels(spark, rows=((1, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (9, 1, 0), (9, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, text(1, 30)), (2, None), (3, ""), (None, text(5, 20)), (1, text(1, 30)))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_quality(spark, odd_docs, no_docs):
    model = quality.fit(odd_docs, labels(spark), F.lit(True))
    rows = quality.with_scores(odd_docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.rank for r in rows} == {"mine"}
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert by_text[None] == by_text[""]
    blank = quality.fit(no_docs, labels(spark), F.lit(True))
    assert quality.with_scores(no_docs, blank).count() == 0
    assert {r.score for r in quality.with_scores(odd_docs, blank).collect()} == {0.5}


def test_label_ties(spark):
    got = {r._label_id: r.good for r in quality.majority_labels(labels(spark)).collect()}
    assert got == {1: True, 6: False}


def test_urls(spark):
    urls = [
        (1, None),
        (2, ""),
        (3, "no scheme"),
        (4, "http://A.Example.ORG/es/x"),
        (4, "http://A.Example.ORG/es/x"),
        (None, "x://com/fr/?q"),
        (5, "http://com"),
        (6, "http://example.org/en/12#top"),
        (7, "http://notexample.org/en/12"),
        (8, "https://" + "a." * 3000 + "com/de/" + "y" * 50_000),
        (9, "://org/"),
        (10, "http://a.com?x=/de/"),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns(
        {c: F.lit("mine") for c in ("host", "path", "rule", "verdict", "shape", "best")}
    )
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block"), ("net", None, "block")],
        "host string, path string, action string",
    )
    rows = url_rules.judge(df, rules, "url", ["page_id"]).collect()
    assert len(rows) == len(urls)
    got = {r.page_id: (r.host[-20:], r.path[:10], r.rule, r.verdict) for r in rows}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[None] == ("com", "/fr/", "com/fr/", "allow")
    assert got[5] == ("com", "", None, "allow")
    assert got[6][2:] == ("example.org/en/1", "block")
    assert got[7][2:] == ("org/", "allow")
    assert got[8][2:] == ("com/de/", "block")
    assert got[9][2:] == ("org/", "allow")
    assert got[10] == ("a.com", "", None, "allow")
    assert url_rules.judge(df.where("false"), rules, "url", ["page_id"]).count() == 0
    assert {r.verdict for r in url_rules.judge(df, rules.where("false"), "url", ["page_id"]).collect()} == {"allow"}


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 1.0]), (150, None), (200, [0.0, 0.0]), (250, [nan, 1.0]),
        (300, [inf, 1.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, [None, 1.0]),
        (None, [1.0, 0.0]), (6, []), (7, [1.0, 0.0, 0.0]), (8, [1e30, 1e30]), (9, [1e-30, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = {}
    for r in nearest_tiles.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert set(got) == {50, 100}
    assert sorted(got[50]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 9, 1.0), (5, 8, round(0.5**0.5, 9))]
    assert sorted(got[100])[0] == (1, 8, round(0.5**0.5, 9))
    assert sorted(got[100])[1:] == [(2, 1, 0.0), (3, 2, 0.0), (4, 3, 0.0), (5, 4, 0.0)]
    assert nearest_tiles.nearest(df.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    found = templates.contaminated(odd_docs, benchmark(spark)).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(1, 1), (2, 1), (None, 1)]
    kept = templates.without_contaminated(odd_docs, benchmark(spark))
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD) - 4
    assert templates.without_contaminated(odd_docs, benchmark(spark, [(1, None)])).count() == len(ODD)
    assert templates.without_contaminated(no_docs, benchmark(spark)).count() == 0


def test_passages(spark, odd_docs, no_docs):
    found = chunks.repeated_passages(odd_docs).collect()
    assert {r.doc_id for r in found} == {2, None} and all(r.kept_in == 1 for r in found)
    rows = chunks.without_passages(odd_docs).collect()
    assert {r.doc_id for r in rows if r.doc_id} == {1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert next(r.text for r in rows if r.doc_id == 6) == LONG
    assert chunks.without_passages(no_docs).count() == 0


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, TOKENIZER, END_ID).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert sum(r.length for r in rows if r.doc_id == 6) == next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert packing.pack(no_docs, TOKENIZER, END_ID).count() == 0


def test_sharding(odd_docs, no_docs):
    df = odd_docs.drop("shard", "slot")
    rows = sharding.interleave(df, "source", [F.col("doc_id"), F.col("n_chars")], 4).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(4 if s == 0 else 3)]
    assert sharding.interleave(no_docs.drop("shard", "slot"), "source", [F.col("doc_id")], 4).count() == 0


def test_token_files(spark, odd_docs, no_docs):
    path = scratch_path(spark, "wavelet")
    wavelet.write_shards(odd_docs, path, TOKENIZER, END_ID, shard_tokens=1000)
    rows = sorted(wavelet.read_documents(odd_docs, path).collect(), key=lambda r: r.start)
    assert len(rows) == len(ODD)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    path = scratch_path(spark, "wavelet")
    wavelet.write_shards(no_docs, path, TOKENIZER, END_ID)
    assert wavelet.read_documents(no_docs, path).count() == 0


def test_similar(spark, odd_docs, no_docs):
    rows = forest_join.similar_texts(odd_docs).collect()
    assert len(rows) == len(ODD)
    assert {r.n_copies for r in rows if r.doc_id in (1, 2)} == {4}
    assert {(r.class_id, r.copy_id, r.n_links) for r in rows if r.doc_id == 2} == {(1, 1, 0)}
    kept = forest_join.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert forest_join.one_of_each_group(no_docs).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    assert licenses.license_notices(odd_docs).count() == 0
    assert licenses.license_notices(no_docs).count() == 0
    notice = "Released under the MIT License. "
    df = spark.createDataFrame(
        [(1, notice * 2), (1, notice * 2), (None, "a " * 50_000 + notice)], "doc_id long, text string"
    ).withColumns({name: F.lit("mine") for name in CLASHING})
    rows = licenses.license_notices(df).collect()
    assert [r.first_word for r in rows if r.doc_id == 1] == [0, 5, 0, 5]
    assert [r.first_word for r in rows if r.doc_id is None] == [50_000]
    assert {(r.license, r.coverage, r.rank) for r in rows} == {("MIT", 1.0, "mine")}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd_docs, no_docs, number, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    for docs in (odd_docs, no_docs):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{number}-{docs is no_docs}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
