"""Source divergence, vector codes, SentencePiece ids: brute force, edge cases, round trips."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from netspark.llm import codebooks, divergence, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# --- source divergence ------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def divergence_by_hand(rows, top=200, min_docs=3):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs, counts = Counter(), {s: Counter() for s in {r[1] for r in mine}}
        for _, source, text in mine:
            found = TERM.findall(low(text))
            counts[source].update(found)
            docs.update(set(found))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def some_rows(seed, n):
    random.seed(seed)
    names = ["The", "the", "fox", "élan", "Ünï", "日本", "a1b", "x", "Zz", "zz", "naïve", "don't"]
    return [
        (
            random.choice(["en", "de", None]),
            random.choice(["s1", "s2", "s3", "", None]),
            random.choice([None, "", " ".join(random.choices(names, weights=range(1, 13), k=random.randint(1, 30)))]),
        )
        for _ in range(n)
    ]


def audited(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    docs = docs.withColumns({c: F.lit("mine") for c in ("digest", "p", "rank", "item", "split", "n")})
    return sorted(map(tuple, divergence.audit(docs, **options).collect()))


@pytest.mark.parametrize("bits", [64, 2])
def test_divergence_equals_brute_force(spark, bits):
    """With digests of two bits nearly all terms share one and are told apart by their strings."""
    rows = some_rows(5, 150) + [("fr", "only", "un deux"), ("it", "a", None), ("it", "b", "uno")]
    assert audited(spark, rows, bits=bits) == divergence_by_hand(rows)


def test_divergence_keeps_the_first_of_ties(spark):
    rows = [("en", s, " ".join(f"{w}{chr(97 + i)}" for i in range(20))) for s, w in [("s", "aa"), ("t", "bb")] * 3]
    found = audited(spark, rows, top=7)
    assert found == divergence_by_hand(rows, top=7)
    assert sum(r[2] == "term" for r in found) == 14


def test_divergence_in_small_steps(spark, monkeypatch):
    """Tables of a task, stored batches and blocks of pairs that end early change nothing."""
    for name, value in [("TASK_TERMS", 5), ("OUT_ROWS", 3), ("PAIR_BLOCK", 4)]:
        monkeypatch.setattr(divergence, name, value)
    rows = some_rows(6, 120)
    assert audited(spark, rows) == divergence_by_hand(rows)


def test_divergence_of_long_texts_and_nothing(spark):
    rows = [("en", s, "word " * 100_000 + "x" * 200_000) for s in ("a", "b", "b")]
    assert audited(spark, rows) == divergence_by_hand(rows)
    assert audited(spark, [(None, None, None)]) == []
    assert audited(spark, [r for r in rows if r[0] == "none"]) == []


def test_terms_of_many_texts():
    texts = ["", " .a. ", "The the\tÉa\n日本 x1y", "don't--", "123", "\x00A\x7fb"] * 2
    terms, many = divergence._terms(pa.array(texts))
    expected = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t)) for t in texts]
    assert terms.to_pylist() == [t for found in expected for t in found]
    assert many.tolist() == list(map(len, expected))


def test_shares_of_large_counts(spark):
    values = [(n, t, v) for n in (0, 7, 10**12, 10**13 - 1) for t in (n, 10**13 + 3) for v in (1, 999_999_937)]
    df = spark.createDataFrame(values, "n long, t long, v long")
    for r in df.select("*", divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect():
        assert r.p == 1 + 10**9 * (r.n + 1) // (r.t + r.v)


# --- vector codes -----------------------------------------------------------------------


def lloyd_by_hand(vectors, parts=4, size=256, rounds=4):
    """Complete comparisons in plain integers; vectors in order of their ids."""
    rows = [[int(np.floor(1024.0 * x)) for x in v] for v in vectors]
    width = len(rows[0]) // parts
    cut = [[tuple(r[p * width : (p + 1) * width]) for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:size]] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for c in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    found = assign()
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return (
        ["".join(f"{k:02x}" for _, k in f) for f in found],
        [sum(d for d, _ in f) for f in found],
        hashlib.sha256(text.encode()).hexdigest(),
    )


def vectors_table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.withColumns({c: F.lit("mine") for c in ("code", "error", "vector", "parts")})


@pytest.mark.parametrize("spread", [0.5, 0.002])
def test_codes_equal_complete_lloyd(spark, spread):
    """The small spread makes very many equal distances."""
    draw = np.random.default_rng(8)
    values = draw.normal(0, spread, (320, 8)).astype(np.float32)
    values[40:80] = values[:40]
    rows = [(i, [float(x) for x in v], i % 5 or None) for i, v in enumerate(values)]
    found = {r.vec_id: r for r in codebooks.codes(spark, vectors_table(spark, rows), size=16).collect()}
    code, error, sha = lloyd_by_hand(values, size=16)
    assert [found[i].code for i in range(320)] == code and [found[i].error for i in range(320)] == error
    assert {r.codebooks_sha256 for r in found.values()} == {sha}
    for label in (None, 1, 2, 3, 4):
        own = [i for i in range(320) if (i % 5 or None) == label]
        assert {found[i].label_error for i in own} == {sum(error[i] for i in own)}


def test_active_comparison_keeps_ties_and_skips_work():
    draw = np.random.default_rng(9)
    for _ in range(200):
        rows, before = draw.integers(-2, 3, (40, 2)), draw.integers(-2, 3, (8, 2))
        after = before.copy()
        moved = np.flatnonzero(draw.random(8) < 0.3)
        after[moved] = draw.integers(-2, 3, (len(moved), 2))
        moved = np.flatnonzero((after != before).any(axis=1))
        own, kept = codebooks.nearest(rows, before)
        got, near, work = codebooks.reassigned(rows, after, moved, own, kept)
        want, far = codebooks.nearest(rows, after)
        assert (got == want).all() and (near == far).all()
        assert work <= len(rows) * len(after)
        assert len(moved) in (0, 8) or work < len(rows) * len(after)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1),
            (4, [inf, 0.0, 0.0, 0.0], None), (5, [None, 0.0, 0.0, 0.0], None), (None, [0.0, -0.5, 0.0, 0.1], None)]
    found = codebooks.codes(spark, vectors_table(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in found) == [
        (0, "02020202", 0), (1, "00000000", 0), (1, "00000000", 0)]
    none = codebooks.codes(spark, vectors_table(spark, rows).where("vec_id = 9"))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    only = vectors_table(spark, rows).where("vec_id = 1").drop("label")
    assert [r.label_error for r in codebooks.codes(spark, only, label=None).collect()] == [0, 0]
    with pytest.raises(ValueError):
        codebooks.codes(spark, vectors_table(spark, [(1, [1.0, 2.0], 0)]))


def test_large_components_are_exact(spark):
    rows = np.array([[-3e5, 2e5], [1e5, -1e5]])
    whole = codebooks.integers(rows, 1024)
    assert codebooks.distances(whole, whole)[0, 1] == sum((int(a) - int(b)) ** 2 for a, b in zip(*whole.tolist()))
    with pytest.raises(ArithmeticError):
        codebooks.integers(np.array([[1e200, 0.0]]), 1024)


# --- SentencePiece ids ------------------------------------------------------------------


@pytest.fixture(scope="module")
def cache():
    return pieces.SegmentIds(pieces.PieceVocabulary(MODEL))


def test_ids_equal_the_library(cache):
    random.seed(1)
    signs = "ab the▁  \n\t0123.,é日本🙂ß\x00​—'\"()[]{}ing<s>ﬁ①Å"
    texts = ["".join(random.choices(signs, k=random.randint(0, 80))) for _ in range(4000)]
    texts += ["", " ", "  ", "▁", "a" * 500, " " * 300, "ing" * 200, "<0x41>", "</s>", "a  b   c", "\r\n\r\n"]
    ids = [cache.ids(t) for t in texts]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids == library.encode(texts, add_eos=True)
    assert [cache.vocabulary.decode(i) for i in ids] == library.decode(ids)


def test_both_agendas_agree(cache):
    random.seed(2)
    for _ in range(300):
        symbols = list("▁" + "".join(random.choices("aeinorst", k=random.randint(1, 39))))
        pieces_of_it = cache.vocabulary._merged_few(symbols.copy())
        assert pieces_of_it == cache.vocabulary._merged_many(symbols.copy())
        known = [cache.vocabulary.characters[c] for c in "".join(symbols).replace("▁", " ")]
        assert cache.vocabulary._merged_ids(known) == [cache.vocabulary.ids[p] for p in pieces_of_it]


def test_generations_of_the_cache(cache, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 3)
    small = pieces.SegmentIds(cache.vocabulary)
    text = "one two three four one two five six one seven, eight 99 two"
    for _ in range(3):
        assert small.ids(text) == cache.ids(text)
    assert len(small) <= 3 and len(small.older) <= 3


def test_a_difference_is_an_error(cache, monkeypatch):
    ids = cache.ids("some text")
    pieces.check_batch(cache, ["some text"], [ids], ["some text"])
    with pytest.raises(RuntimeError):
        pieces.check_batch(cache, ["some text"], [ids[:-1]], ["some text"])
    with pytest.raises(RuntimeError):
        pieces.check_batch(cache, ["some text"], [ids], ["other text"])
    fresh = pieces.SegmentIds(cache.vocabulary)
    texts = ["one two,three  4four ", "one two"]
    ids = [fresh.ids(t) for t in texts]
    assert " one" in fresh.fresh and "," in fresh.fresh
    pieces.check_batch(fresh, texts, ids, texts)
    assert not fresh.fresh
    # A segment that was encoded wrongly is found although its text is not the one compared whole.
    fresh.ids("wrong")
    fresh[" wrong"] = fresh[" one"]
    with pytest.raises(RuntimeError):
        pieces.check_batch(fresh, texts, ids, texts)


def test_pieces_of_odd_documents(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd_docs.withColumn("n_tokens", F.lit("mine"))
    found = pieces.digests(docs, MODEL)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["_n_tokens", "ids_sha256", "decoded_sha256"]
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd_docs.select("doc_id", "text").collect())
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text, add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        expected.append((doc_id, len(ids), *sha))
    rows = found.select("doc_id", "_n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((r[0] or 0, *r[1:]) for r in rows) == sorted(expected)
    assert pieces.digests(no_docs, MODEL).count() == 0


def test_encoded_texts_come_back(spark, odd_docs):
    found = pieces.encoded(odd_docs, MODEL).select("text", "ids", "ids_text").collect()
    assert len(found) == 13
    for row in found:
        assert row.ids_text == (row.text or "") and row.ids[-1] == 2
