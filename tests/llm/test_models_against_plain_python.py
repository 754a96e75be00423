"""Packing, language profiles, quality rules and vector search against plain Python."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewise.llm import language_id, packing, quality, vector_search
from cubewise.llm.scratch import Scratch
from tests.llm.test_text_operators import ODD

# ---------------------------------------------------------------- op1: pieces


def test_pieces_against_the_library(spark):
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("ab  \n▁é日.'\tst<>") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["word " * 3000, "x" * 5000, "ab " * 341, "a b " * 512]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    library = packing._tokens(packing.TOKENIZER, packing.RANKS).library
    expected = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END]
        head = len(ids) % packing.CAPACITY or packing.CAPACITY
        cuts = [0, *range(head, len(ids), packing.CAPACITY), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = packing.pack_documents(docs, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    assert max(n for _, _, _, n, _ in expected) == packing.CAPACITY and len({r.doc_id for r in rows if r.piece > 0}) >= 2


# ---------------------------------------------------------------- op3: profiles


def plain_bundle(text):
    """Sum of bound trigram vectors, one by one."""
    low = text.lower()
    vector = {c: language_id.letter_vectors(np.array([ord(c) if c.isalpha() else 0]))[0].astype(int) for c in set(low) | {" "}}
    out = np.zeros(language_id.DIM)
    for i, c in enumerate(low):
        if c.isalpha():
            a, b = low[i - 1] if i else " ", low[i + 1] if i + 1 < len(low) else " "
            out += np.roll(vector[a], 2) * np.roll(vector[c], 1) * vector[b]
    return out


@pytest.mark.parametrize("block", [language_id.BLOCK, 7])
def test_bundles_are_sums_of_bound_letters(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = random.Random(4)
    texts = ["Abc dé, x1y!", "", "日本語 と 漢字", "aaaa", "Γειά σου", None, "-- 12 --"]
    texts += ["".join(chr(rng.choice((rng.randint(97, 122), rng.randint(0x4E00, 0x5E00), 32))) for _ in range(60)) for _ in range(6)]
    keys, of = language_id.trigrams(texts)
    got = language_id.bundles(keys, of, len(texts))
    for t, row in zip(texts, got):
        assert np.array_equal(row, plain_bundle(t or "").astype(np.float32))


def test_letters_of_all_scripts_have_vectors_of_their_own():
    codes = np.array([*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x4E00, 0x4F00)])
    v = language_id.letter_vectors(codes).astype(int)
    assert set(np.unique(v)) == {-1, 1}
    near = v @ v.T / language_id.DIM
    np.fill_diagonal(near, 0)
    assert abs(near).max() < 0.2  # alike by chance only, also where code points agree modulo 37


def test_scripts_that_agree_modulo_37_are_told_apart(spark):
    """Two scripts, letter by letter 37 apart, in the same patterns."""
    rng = random.Random(1)
    letters = [0x0561 + k for k in range(30)]  # and 37 code points on, letters too
    other = [next(d for d in range(0x10D0, 0x10FB) if d % 37 == c % 37) for c in letters if any(d % 37 == c % 37 for d in range(0x10D0, 0x10FB))]
    letters = [c for c in letters if any(d % 37 == c % 37 for d in range(0x10D0, 0x10FB))]
    rows = []
    for i in range(240):
        pattern = [[rng.randrange(len(letters)) for _ in range(rng.randint(2, 8))] for _ in range(30)]
        script = (letters, other)[i % 2]
        rows.append((i, " ".join("".join(chr(script[k]) for k in w) for w in pattern), ("one", "two")[i % 2]))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 30 and all(r.lang_pred == ("one", "two")[r.doc_id % 2] for r in got)


def test_memory_of_many_letters_is_bounded():
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 20_000))) for _ in range(50)]
    language_id._letters()
    tracemalloc.start()
    keys, of = language_id.trigrams(texts)
    language_id.bundles(keys, of, len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6


# ---------------------------------------------------------------- op10: rules


def test_compiled_column_equals_the_rules(spark):
    """The Spark column of a fitted ensemble against its rules, one by one."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d"]
    x = rng.normal(size=(800, 4)).round(2)
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (x[:, 2] > 1.0)).astype(float)
    model = quality.fit(x, y, names)
    assert len(model.rules) > 5
    margin = np.full(len(x), model.base)
    for i, row in enumerate(x):
        for rule in model.rules:
            if all((row[names.index(n)] > limit) == above for n, limit, above in rule.limits):
                margin[i] += rule.weight
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "i int, a double, b double, c double, d double")
    got = {r.i: r.score for r in df.select("i", model.score().alias("score")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)
    assert (((1 / (1 + np.exp(-margin))) >= 0.5) == (y == 1)).mean() > 0.95


def test_a_repeated_id_does_not_crowd_out_other_labels(spark):
    """One doc_id on many rows is one labelled row."""
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + "."
    rows = [(0, "!!! " * 30)] * 500 + [(i, good() if i % 2 else "!!! " * 40) for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    scratch = Scratch(spark, "t")
    model = quality.learn(scratch.save(quality.text_statistics(docs)), labels, sample=200)
    assert model.rules
    scored = quality.quality_scores(docs, labels, scratch)
    assert scored.where("predicted <> doc_id % 2").count() == 0


# ---------------------------------------------------------------- op6: recall


def tables(n, d=32, seed=5):
    rng = np.random.default_rng(seed)
    sphere = rng.normal(size=(n, d))
    sphere /= np.linalg.norm(sphere, axis=1, keepdims=True)
    yield "sphere", sphere
    copies = sphere.copy()
    copies[rng.random(n) < 1 / 3] = sphere[0]
    yield "copies", copies
    yield "uneven norms", sphere * np.exp(rng.normal(size=(n, 1)))
    long = sphere.copy()
    long[rng.random(n) < 0.05] *= 5
    yield "some long", long
    centres = rng.normal(size=(200, d))
    yield "tight clusters", centres[rng.integers(0, 200, n)] + 0.1 * rng.normal(size=(n, d))


@pytest.mark.parametrize("name", ["sphere", "copies", "uneven norms", "some long", "tight clusters"])
def test_recall_against_brute_force(spark, name):
    n, k = 12_000, 20
    x = dict(tables(n))[name]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, n, 100))
    got = {}
    for r in vector_search.nearest(df, df.where("vec_id % 100 = 0"), Scratch(spark, "t"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        limit = np.sort(scores)[-k]
        rows = sorted(got[q])
        assert [r for r, *_ in rows] == list(range(1, k + 1))
        for _, v, s in rows:
            assert s == pytest.approx(scores[v], abs=1e-9)
        hits += sum(scores[v] >= limit - 1e-12 for _, v, _ in rows)
    assert hits / (k * len(asked)) >= 0.9


def test_search_on_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.5, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 1.0]),
            (7, [inf, 0.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, c1 string, part int")
    got = vector_search.nearest(df, df.where("vec_id in (20, 1, 4)"), Scratch(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {1, 20} and sorted(by[20]) == [1, 1, 2]  # fewer than 20 candidates: all
    assert set(by[1]) == {2, 20}  # a repeated query is answered, another row of its id is not its neighbour
    assert vector_search.nearest(df.where("vec_id = 4"), df, Scratch(spark, "t")).count() == 0
    assert vector_search.nearest(df, df.limit(0), Scratch(spark, "t")).agg(F.count("*")).first()[0] == 0
