"""Operators across texts or vectors, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np

import corpus_pipeline
from cubewise.llm import decontaminate, near_dedup, passages, stages, vector_search
from cubewise.llm.components import connected_components
from cubewise.llm.scratch import Scratch

from .test_text_operators import words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, base = text(70), text(200)
    out = [text(rng.randint(30, 150)) for _ in range(15)]
    out += [text(20) + shared + text(20) for _ in range(3)]
    for edits in (1, 1, 2, 2, 3, 4, 5, 6, 8):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        out.append(copy)
    texts = [" ".join(x) for x in out]
    return texts + [texts[3], texts[3].upper(), "a b", "A  b", "", None, "one two three four five"], shared


def frame(spark, texts):
    return spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 9), (20, 21), (21, 22), (22, 20), (5, 3), (30, 29)]
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 29: 29, 30: 29}


def test_near_duplicates_against_all_pairs(spark):
    texts, _ = corpus()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(a):
        return a if parent[a] == a else find(parent[a])

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts), Scratch(spark, "t")).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i + 10].n_shingles, got[i + 10].component_id) == (len(s), find(i) + 10)
        assert got[i + 10].kept == (find(i) == i)
    assert near_dedup.near_duplicates(frame(spark, texts).limit(0), Scratch(spark, "t")).count() == 0


def test_exact_passages_are_all_found(spark):
    texts, shared = corpus()
    found = passages.repeated_passages(frame(spark, texts), Scratch(spark, "t")).collect()
    cover = {}
    for r in found:
        assert r.source_id < r.doc_id and r.n_words >= 51
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    seen = {}
    for i, t in enumerate(texts):
        w = lower(t).split()
        runs = [tuple(w[k:k + 51]) for k in range(len(w) - 50)]
        for k, run in enumerate(runs):
            if seen.get(run, i) != i:
                assert set(range(k, k + 51)) <= cover.get(i + 10, set())
        for run in runs:
            seen.setdefault(run, i)
    cut = {r.doc_id: r.text for r in passages.without_repeats(frame(spark, texts), Scratch(spark, "t")).collect()}
    line = " ".join(shared)
    assert sum(line in (t or "") for t in cut.values()) == 1 and cut[10] == texts[0] and None in cut.values()


def covered(found, doc_id, start, n):
    """Share of the words start to start + n that passages of doc_id hold."""
    own = {k for r in found if r.doc_id == doc_id for k in range(r.start_word, r.start_word + r.n_words)}
    return len(own & set(range(start, start + n))) / n


def shingle_set(w):
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_recall_of_near_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    texts, planted = [], []
    for n in range(600):
        base = [word() for _ in range(rng.randint(51, 120))]
        copy, k = list(base), (12, len(base) // 2)[n % 2]
        if n % 3 == 0:
            copy[k] = word()
        elif n % 3 == 1:
            copy.insert(k, word())
        else:
            del copy[k]
        texts += [" ".join([word() for _ in range(rng.randint(0, 80))] + x + [word() for _ in range(40)]) for x in (base, copy)]
        x, y = shingle_set(base), shingle_set(copy)
        if len(copy) >= 51 and len(x & y) >= 0.8 * len(x | y):  # by brute force
            planted.append((2 * n + 11, texts[-1].split().index(copy[0]), len(copy)))
    found = passages.repeated_passages(frame(spark, texts), Scratch(spark, "t")).collect()
    by_doc = {}
    for r in found:
        assert r.source_id < r.doc_id and r.n_words >= 51 and r.similarity >= 0.8
        by_doc.setdefault(r.doc_id, []).append(r)
    recall = sum(covered(by_doc.get(d, []), d, a, n) >= 0.9 for d, a, n in planted) / len(planted)
    print(f"recall {recall:.4f} of {len(planted)} near passages")
    assert recall >= 0.97


def test_passages_that_no_leader_is_in(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    texts = []
    for _ in range(30):  # the last text repeats the fourth, and shares every minimum with the first three, but no passage
        base = [word() for _ in range(55)]
        copies = [list(base) for _ in range(4)]
        for c, changed in zip(copies, [(9, 40), (14, 45), (20, 35), (27,)]):
            for k in changed:
                c[k] = word()
        texts += [" ".join([word() for _ in range(50)] + x + [word() for _ in range(50)]) for x in (*copies, base)]
    found = passages.repeated_passages(frame(spark, texts), Scratch(spark, "t")).collect()
    assert all(r.source_id < r.doc_id for r in found)
    done = sum(covered(found, k + 10, 50, 55) >= 0.9 for k in range(4, 150, 5))
    print(f"{done} of 30 found")
    assert done >= 29


def test_exact_passages_behind_an_opening(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    texts = []
    for _ in range(40):  # the first text holds most of the passage before the whole of it
        passage = [word() for _ in range(51)]
        first = [word() for _ in range(30)] + passage[:48] + [word() for _ in range(30)] + passage + [word() for _ in range(30)]
        texts += [" ".join(first), " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])]
    found = passages.repeated_passages(frame(spark, texts), Scratch(spark, "t")).collect()
    done = sum(covered(found, k + 10, 30, 51) == 1 for k in range(1, 80, 2))
    print(f"{done} of 40 found")
    assert done == 40


def test_decontamination_against_plain_search(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(60)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (25, 14, 10, 4, 1)] + ["", None, "never seen words here"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [text(80), text(5) + " " + items[0] + ", " + text(9), items[1].upper(), items[0].split(" ", 8)[8] + " " + items[3], "", None, items[2] + " " + items[2], text(3)]
    docs.append(docs[1])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, docs), bench, Scratch(spark, "t")).collect()}
    windows = {}
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    for i, t in enumerate(docs):
        w, hit, held = words(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    held |= own
        r = got[i + 10]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(held), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest()
    assert not any(r.contaminated for r in decontaminate.decontaminate(frame(spark, docs), bench.limit(0), Scratch(spark, "t")).collect())


def test_nearest_against_all_rows(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(scale=0.3, size=(100, 16)) for c in rng.normal(size=(10, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2020, [float("nan")] * 16), (2040, [1.0]), (2041, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.nearest(df, df.where("vec_id % 20 = 0"), Scratch(spark, "t")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    every, ids = np.concatenate([x, x[:1]]), np.array([*range(1000), 2041])
    right = 0
    for q, found in got.items():
        s = every @ x[q]
        order = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert sorted(found) == list(range(1, 21))
        right += len({r.vec_id for r in found.values()} & set(order))
    assert set(got) == set(range(0, 1000, 20)) and right >= 0.9 * 20 * len(got)
    assert vector_search.nearest(df.limit(0), df, Scratch(spark, "t")).count() == 0


def test_one_of_repeated_rows_stays(spark):
    line = "one two three four five six seven eight"
    rows = [(1, line), (1, line), (1, line + " other"), (2, "a b c d e f g h i"), (None, line), (None, line), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in stages._one_row(docs).collect()))
    assert got == sorted([(1, line), (1, line + " other"), (2, rows[3][1]), (0, line), (0, ""), (3, ""), (3, "")])
    hot = spark.createDataFrame([(7, line)] * 50 + [(8, "x y z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, hot, "").collect()) == [7, 8]


def test_op4_gives_proximity_matches(spark):
    item = [f"w{n}" for n in range(10)]
    rng = random.Random(11)
    docs = [" ".join(["a", *item, "b"]), " ".join(["a", *item[:5], "zz", *item[5:], "b"]), "a b", " ".join(item[::-1]), None]
    docs += [" ".join([item[k] for k in range(2, 10) for _ in range(2)]) for _ in range(3)]
    rng.shuffle(docs)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    read = decontaminate.read_table
    try:
        decontaminate.read_table = lambda s, d, name: bench if name == "benchmark" else frame(spark, docs)
        got = {r.doc_id: r for r in decontaminate.op4(spark, "").collect()}
    finally:
        decontaminate.read_table = read
    counts = {w: sum(w in words(t) for t in docs) for w in item}
    total = {w: sum(words(t).count(w) for t in docs) for w in item}
    first, second = sorted(item, key=lambda w: (total[w], item.index(w)))[:2]
    for i, t in enumerate(docs):  # by brute force: places of the rarest word with the second within the width, but not the phrase
        w = words(t)
        near = [k for k in range(len(w)) if w[k] == first and second in w[max(0, k - 10):k + 11]
                and w[max(0, k - item.index(first)):k - item.index(first) + 10] != item]
        assert got[i + 10].n_near == len(near)
    assert counts[first] and sum(r.n_near for r in got.values()) > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scratch, before = Scratch(spark, "t"), docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, "/root/testdata/sf0.001"))
        if name != "pack":
            assert after.columns == docs.columns and 0 < after.count() <= before
            before, docs = after.count(), after
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
