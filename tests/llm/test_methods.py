"""The operators against brute force, exact round trips and held-out labels."""

import itertools
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netspark.llm import chunks, components, forest_join, licenses, nearest_tiles, packing, quality, queries
from netspark.llm import shingles, templates, wavelet
from netspark.llm.tokens import PieceIds
from tests.llm.conftest import SF_DIR, text, words

PIECES = PieceIds(queries.TOKENIZER)
REFERENCE = Tokenizer.from_file(queries.TOKENIZER)


def ids_of(value):
    return [*REFERENCE.encode(value or "", add_special_tokens=False).ids, queries.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokens


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé.,!#' \n\t \x1cß日9<|>İŉ́"), st.characters(codec="utf-8"))))
def test_pieces_give_the_ids_of_the_whole(value):
    assert PIECES.ids(value).tolist() == REFERENCE.encode(value, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("aZé.,!#' \n\t日9<|>İȚȺst"), st.characters(codec="utf-8"))))))
def test_ids_of_many_texts_are_those_of_each(values):
    ids, many = PIECES.ids_of(pa.array(values, pa.string()))
    assert many.tolist() == [len(ids_of(v)) - 1 for v in values]
    assert ids.tolist() == [i for v in values for i in ids_of(v)[:-1]]


@pytest.mark.parametrize("value", ["<|endoftext|> a<|startoftext|>b", "don't we'll. x's,", "A" * 400, "ÉÈÇ, ÄÖÜß."])
def test_pieces_of_odd_texts(value):
    assert PIECES.ids(value).tolist() == REFERENCE.encode(value, add_special_tokens=False).ids


# 1


def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op1_quality_classifier"](spark, SF_DIR.replace("0.001", "0.01")).collect()
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet").collect()
    known = {r.doc_id: r.quality for r in labels}
    judged = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all((r.score >= 0.5) == bool(r.predicted) for r in rows)
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) > 0.95


def test_dual_descent_meets_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 400)
    random = np.random.default_rng(3)
    labels = np.where(random.random(60) < 0.4, 1.0, -1.0)
    rows = [
        (np.array([0, 1, 2 + k % 4], np.int32), np.array([y + random.normal(), 1.0, 0.5])) for k, y in enumerate(labels)
    ]
    weights, bias = quality.fit_hinge(rows, labels)

    def loss(w, b):
        margins = np.array([v @ w[i] + b for i, v in rows])
        return (w @ w + b * b) / 2 + quality.COST * np.maximum(0, 1 - labels * margins).sum()

    best = loss(weights, bias)
    for _ in range(200):
        step = np.zeros(quality.BUCKETS)
        step[:6] = random.normal(size=6) * 0.05
        assert loss(weights + step, bias + random.normal() * 0.05) > best - 0.02


# 3


def test_nearest_by_brute_force(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(700, 12)).round(1)
    vectors[100:400] = vectors[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest_tiles.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 700, 50):
        scores = nearest_tiles.cosines(vectors[q], vectors)
        expected = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in expected]


def test_tiles_bound_the_cosines():
    random = np.random.default_rng(6)
    unit = random.normal(size=(50, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    codes, scale, lost = nearest_tiles.quantised(unit)
    near = nearest_tiles.products(codes, codes) * scale[:, None] * scale
    error = lost[:, None] + lost + lost[:, None] * lost
    assert (np.abs(near - unit @ unit.T) <= error + nearest_tiles.SLACK).all()


# 4


def test_templates_by_example(spark):
    item = "A train leaves Paris at 9 km from John Smith and travels 120 km in 2 hours before it stops for good"
    changed = item.replace("Paris", "Rome").replace("John Smith", "Ada Byron").replace("120", "75").replace("9 ", "3 ")
    mixed = "A train leaves Paris at 9 km and then Paris meets 9 men while Paris rests near 9 more trains at noon"
    broken = mixed.replace("then Paris", "then Rome")
    docs = spark.createDataFrame(
        [(1, f"First things. {item}. The end."), (2, f"So it goes. {changed}. The end."), (3, text(3, 200)),
         (4, f"x. {broken}"), (5, item.upper()), (6, f"y. {mixed.replace('Paris', 'Rome')}")],
        "doc_id long, text string",
    )
    benchmark = spark.createDataFrame([(1, item), (2, mixed)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.verbatim for r in templates.contaminated(docs, benchmark).collect()}
    assert found == {(1, 1): True, (2, 1): False, (6, 2): False}


def test_windows_of_many_texts_are_those_of_each():
    texts = [text(80, 40), None, "", "\n", "ends in New", "York begins. Take 7", "km more of it", "A b. \"C\" d", text(81, 9)]
    texts += ["Éa _x_ 12.5 7kg, (in) x٣km 日本. Of 10:30 USA\n% $ a:b"] * 2

    def windows_of(part):
        found = Counter()
        for width, hashes, owner, places, at, values in templates.document_windows(pa.array(part, pa.string()), [2, 5], [1, 3]):
            for h, k, place, begin in zip(hashes.tolist(), owner.tolist(), places.tolist(), at.tolist()):
                found[part[k], width, h, place, str(templates._slots(values, begin, width))] += 1
        return found

    assert windows_of(texts) == sum((windows_of([t]) for t in texts), Counter())


def test_one_conflict_leaves_the_rest_of_an_alignment(spark):
    head, tail = " ".join(words(70, 20)), " ".join(words(71, 20))
    item = f"{head} near Paris {tail} to Paris and 5 or 7 more"
    texts = [item.replace("to Paris", "to Rome"), item.replace("7", "5"), item, text(72, 60)]
    docs = spark.createDataFrame([(k, f"So. {t}.") for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: (r.n_covered == r.n_item, r.verbatim) for r in templates.contaminated(docs, benchmark).collect()}
    assert found == {0: (True, False), 1: (False, True), 2: (True, True)}


def test_items_inside_a_sentence(spark):
    items = ["Which of the rivers runs north today", "Does Paris lie on some big river", "where does it all end then now"]
    items += ["Take 7 of the nine red apples home"]
    texts = [f"He asked her: well {i[0].upper()}{i[1:]}, and so on." for i in items]
    texts += [f"So, {items[3].replace('7', '12')} and go.", "Which of the rivers runs south today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.share for r in templates.contaminated(docs, benchmark).collect()}
    assert {(0, 0), (1, 1), (3, 3), (4, 3)} <= set(found) <= {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}
    assert set(found.values()) == {1.0}


def test_exact_copies_of_short_and_numeric_items(spark):
    items = ["What is 12 + 34?", "Which number follows next: 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096?"]
    items += ["Name it", "Rome", "1 2 3 4 5 6 7 8 9 10", "+ - +"]
    texts = [f"He said: well {i} And so on." for i in items]
    texts += ["What is 12 - 34?", "Next: 2, 4, 8, 16, 32, 64", "Name of it", "1 2 3 4 5 6 7 8 9 11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = templates.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, k) for k in range(6)}
    assert all(r.verbatim and r.share == 1 for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.one_of(st.none(), st.tuples(st.integers(0, 2), st.integers(0, 2)))))
def test_consistent_spans_by_brute_force(slots):
    places, pairs = sorted(slots), {k: v for k, v in slots.items() if v}

    def sound(a, b):
        own = {pairs[k] for k in range(a, b + 1) if k in pairs}
        return all(k in slots for k in range(a, b + 1)) and len({x for x, _ in own}) == len({y for _, y in own}) == len(own)

    spans = [(a, b) for a in places for b in places if a <= b and sound(a, b)]
    longest = {(a, b) for a, b in spans if not any((c, d) != (a, b) and c <= a and b <= d for c, d in spans)}
    got = list(templates.consistent_spans(places, pairs))
    assert {(a, b) for a, b, _ in got} == longest
    assert all(c == any(pairs[k][0] != pairs[k][1] for k in range(a, b + 1) if k in pairs) for a, b, c in got)


def test_every_planted_item_is_found(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in documents.collect() for i in items if i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontamination"](spark, SF_DIR).collect()}
    assert planted and planted <= found and len(found - planted) <= 1


# 5


def shared_windows(docs, width):
    first = {}
    for i, own in sorted(docs.items()):
        for k in range(len(own) - width + 1):
            first.setdefault(tuple(own[k : k + width]), i)
    return first


def test_repeated_passages_by_brute_force(spark):
    passage = " ".join(words(50, 51))
    short = " ".join(words(51, 18))
    texts = {i: text(i, 80 + 13 * i) for i in range(1, 12)}
    texts |= {20: f"{text(20, 33)} {passage} {text(21, 70)}", 21: f"{passage} {text(22, 40)}"}
    texts |= {22: f"{text(23, 90)}\n{passage}", 23: f"{text(24, 50)} {short} {text(25, 50)}", 24: f"{short} {text(26, 9)}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs = {i: t.split() for i, t in texts.items()}
    found = chunks.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == {21, 22} and {r.kept_in for r in found} == {20}
    first = shared_windows(docs, 15)
    assert all(first[tuple(docs[r.doc_id][r.first_word : r.first_word + 15])] == 20 for r in found)
    rows = {r.doc_id: r.text for r in chunks.without_passages(df).collect()}
    assert all(rows[i] == t for i, t in texts.items() if i not in (21, 22))
    assert passage not in rows[21] and passage not in rows[22]
    assert rows[21].endswith(text(22, 40)) and rows[22].startswith(text(23, 90))


def test_documents_hold_no_long_repeat_unseen(spark, documents):
    docs = {r.doc_id: r.text.split() for r in documents.collect()}
    first = shared_windows(docs, 51)
    found = defaultdict(list)
    for r in chunks.repeated_passages(documents).collect():
        found[r.doc_id].append((r.first_word, r.first_word + r.n_words))
    for i, own in docs.items():
        for k in range(len(own) - 50):
            if first[tuple(own[k : k + 51])] != i:
                assert any(a < k + 51 and k < b for a, b in found[i])


# 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=11))
def test_packing_is_the_cheapest(steps):
    places = np.cumsum([0, *(s for s, _ in steps)])
    costs = np.array([0, *(c for _, c in steps)])
    costs[-1] = 0
    length = 12

    def cost(cuts):
        sizes = [b - a for a, b in zip(cuts, cuts[1:])]
        if max(sizes) > length:
            return None
        price = {int(p): int(c) for p, c in zip(places, costs)}
        return sum(length - s for s in sizes) + sum(price[c] for c in cuts[1:])

    inner = [int(p) for p in places[1:-1]]
    every = [
        cost([0, *some, int(places[-1])]) for n in range(len(inner) + 1) for some in itertools.combinations(inner, n)
    ]
    got = packing.best_windows(places, costs, length)
    assert cost([int(p) for p in got]) == min(c for c in every if c is not None)


def test_packing_round_trip(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.QUERIES["op6_packing"](spark, SF_DIR).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids, at = ids_of(texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == crc(ids[r.start : at])
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    total = sum(r.length for r in rows)
    assert len(sequences) * packing.LENGTH < total * 1.05


# 7


def test_shards_have_the_mixture(spark):
    rows = queries.QUERIES["op7_sharding"](spark, SF_DIR.replace("0.001", "0.01")).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size))
    for source in {r.source for r in rows}:
        own = Counter(r.shard for r in rows if r.source == source)
        assert max(own[s] for s in range(8)) - min(own[s] for s in range(8)) <= 2
    ranks = defaultdict(list)
    for r in rows:
        ranks[r.source].append(r.fractional_rank)
    for own in ranks.values():
        assert np.allclose(sorted(own), (np.arange(len(own)) + 0.5) / len(own))


# 8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(0, 2**32))
def test_wavelet_matrix(values, seed):
    ids = np.array(values + values[:50], np.uint16)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert matrix.ids().tolist() == ids.tolist()
    for at in np.random.default_rng(seed).integers(0, max(1, len(ids)), 10 if len(ids) else 0).tolist():
        token = int(ids[at])
        before = int((ids[:at] == token).sum())
        assert matrix.access(at) == token and matrix.count(token, 0, at) == before
        assert matrix.select(token, before) == at


def test_wavelet_matrix_over_rank_blocks():
    ids = np.random.default_rng(1).zipf(1.4, 9000).clip(0, 60_000).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.build(ids)
    for at in range(0, 9000, 371):
        token = int(ids[at])
        assert matrix.access(at) == token and matrix.select(token, int((ids[:at] == token).sum())) == at
        assert matrix.count(token, at, 9000) == int((ids[at:] == token).sum())
    with pytest.raises(IndexError):
        matrix.access(9000)
    with pytest.raises(IndexError):
        matrix.select(65_000, 0)


def test_token_files_round_trip(spark, documents):
    rows = sorted(queries.QUERIES["op8_token_files"](spark, SF_DIR).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in documents.collect()}
    at = 0
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(texts)


# 9


def brute_links(docs, similarity=0.8):
    """Classes of equal shingle sets, their links, and the smallest id of each group."""
    classes = defaultdict(list)
    for i, t in docs.items():
        classes[shingles.shingle_set(t, 5).tobytes()].append(i)
    sets = [set(np.frombuffer(k, np.uint64).tolist()) for k in classes]
    parent, links = list(range(len(sets))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and sets[a] and sets[b]:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    members = list(classes.values())
    for k, own in enumerate(members):
        groups[find(k)] += own
    return {
        i: (min(own), min(groups[find(k)]), len(own), links[k]) for k, own in enumerate(members) for i in own
    }


def near_copies():
    docs = {i: text(i, 60 + i) for i in range(40)}
    for i in range(40, 90):
        base = words(i % 4, 150)
        for place in range(i % 7):
            base[(place * 31 + i) % 150] = f"new{i}"
        docs[i] = " ".join(base)
    return docs


def test_similar_texts_by_brute_force(spark, monkeypatch):
    docs = near_copies()
    expected = brute_links(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for blocks in (1000, 7):  # small blocks: groups that are compared in parts
        monkeypatch.setattr(forest_join, "NODE_BLOCK", blocks)
        monkeypatch.setattr(forest_join, "VERIFY_BLOCK", blocks)
        rows = forest_join.similar_texts(df).collect()
        assert {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in rows} == expected
    assert max(e[3] for e in expected.values()) > 3


def test_documents_by_brute_force(spark, documents):
    expected = brute_links({r.doc_id: r.text for r in documents.collect()})
    rows = queries.QUERIES["op9_ngram_jaccard"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in rows} == expected


def test_prefix_depth():
    assert forest_join.prefix_depth(0.8, 24, 6, 0.9999) == 5
    assert forest_join.prefix_depth(0.8, 24, 6, 0.9) == 6
    assert forest_join.prefix_depth(0.1, 4, 6, 0.9999) == 1


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (8, 10), (3, 1), *((100 + k, 101 + k) for k in range(30))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8} | {100 + k: 100 for k in range(31)}


# 10


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(7)))
def test_rising_is_the_longest(places):
    anchors = [(p, k) for k, p in enumerate(places)]
    best = max(
        n for n in range(8) for some in itertools.combinations(places, n) if list(some) == sorted(some)
    )
    found = licenses.rising(anchors)
    assert len(found) == best and found == sorted(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_alignment_pairs_equal_words_in_order(left, right):
    pairs = licenses.align(left, right)
    assert all(left[i] == right[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_notices_in_documents(spark, documents):
    lines = {
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    }
    planted = Counter(
        {(r.doc_id, k): r.text.count(line) for r in documents.collect() for k, line in lines.items() if line in r.text}
    )
    rows = queries.QUERIES["op10_license_scan"](spark, SF_DIR).collect()
    assert planted and not planted - Counter((r.doc_id, r.license) for r in rows)
    assert {r.doc_id for r in rows} == {i for i, _ in planted}


@pytest.mark.parametrize("before", ["", "the x y ", "under x y ", "License, the ", "Licensed the a 4.0 "])
@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_exact_notices_are_covered_in_full(before, name):
    notice = licenses.TEMPLATES[name]
    found = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).found(f"{before}{notice}. And so on.")
    assert found == [(name, 1.0, len(before.split()), len(notice.split()))]


@pytest.mark.parametrize(
    "notice",
    ["Released under the BSD License", "Released under the GPL License", "Licensed under CC BY-ND 4.0",
     "Licensed under CC BY 3.0", "Licensed under the Apache License, Version 1.1",
     "This work is licensed under the GNU Lesser General Public License, version 3",
     "This work is licensed under the GNU General Public License, version 2"],
)
def test_notices_of_other_licenses_are_not_taken(notice):
    assert licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).found(f"So. {notice}. And so on.") == []


def test_notices_with_a_common_word_changed():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for notice, name in [("Distributed under the MIT License", "MIT"), ("Released under CC BY-NC 4.0", "CC-BY-NC-4.0")]:
        assert [(r[0], r[1]) for r in scanner.found(notice)] == [(name, 0.8)]
    own = licenses.Scanner({"a": "given under terms of A", "b": "given under terms of B"}, 0.8)
    assert [r[0] for r in own.found("given under terms of B x y given under terms of C z")] == ["b"]


# The pipeline


def test_pipeline_by_brute_force(spark, documents):
    """Each stage's decisions on the rows it got."""
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs, kept = documents, [{r.doc_id: r.text for r in documents.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()}
    assert good & set(kept[0]) <= set(kept[1]) and len(kept[1]) < len(kept[0])
    groups = brute_links(kept[1])
    assert set(kept[2]) == {i for i, (_, group, _, _) in groups.items() if i == group}
    assert set(kept[3]) <= set(kept[2])
    assert set(kept[4]) == {i for i, t in kept[3].items() if not any(item in t for item in items)}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(kept[4])
    totals = Counter()
    for r in packed:
        totals[r.doc_id] += r.length
    assert totals == Counter({i: len(ids_of(t)) for i, t in kept[4].items()})
