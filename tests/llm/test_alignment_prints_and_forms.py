"""Alignment, fingerprints and fill-in-middle, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cubewise.llm import alignment, fim, fingerprints
from cubewise.llm.scratch import Scratch
from tests.oracle_compare import compare, duck

ODD = ["", None, " ", "  ", "a", "a  b ", "don't we'll\n\n  b", "日本 語 é", "x <|endoftext|> </s> y", "a▁b", "a\x00b", "same", "same", "trail  ", "é́ ǅ ​😀😀 <0x41>",
       "<P> x", "y<S", "z<M>", "line\nother\r\nline\n"]


def random_texts(n, letters, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def frame(spark, texts, more="row string, text_2 string, form string, hash string"):
    names = more.count(",") + 1
    return spark.createDataFrame([(i * 3 + 1, t, *["x"] * names) for i, t in enumerate(texts)], "doc_id long, text string, " + more)


# ---------------------------------------------------------------- alignment


def aligned_by_hand(texts):
    va, vb = alignment.vocabularies(alignment.TOKENIZER, alignment.RANKS, alignment.MODEL)
    of_a, of_b = va.entries.to_pylist(), vb.entries.to_pylist()
    docs = []
    for t in texts:
        docs.append([])
        whole = " " + (t or "")
        a, b = va.tokenizer.library.encode(whole, add_special_tokens=False).ids, vb.tokenizer.model.encode(t or "")
        if not t or b"".join(of_a[i] for i in a) != whole.encode() or b"".join(of_b[i] for i in b) != whole.encode():
            continue
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b[i]) for i in b]).tolist()
        last = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            docs[-1].append(([i for i, e in zip(a, ends_a) if last < e <= end], [i for i, e in zip(b, ends_b) if last < e <= end]))
            last = end
    count = Counter(p for d in docs for p in {(a, b) for ga, gb in d for a in ga for b in gb})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d in docs:
        links = [(a, b) for ga, gb in d for a in ga for b in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in d)
        out.append((sum(len(g[0]) for g in d), sum(len(g[1]) for g in d), len(d), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return docs, out


@pytest.mark.parametrize("hot", [alignment.HOT, 3])
def test_aligned_counts_against_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)  # 3: nearly all pairs take the shuffled join
    texts = ODD + random_texts(150, "ab  \n▁é日.'\tst<>😀", 40) + ["word " * 700 + "x" * 900]
    groups, expected = aligned_by_hand(texts)
    got = sorted(alignment.aligned_counts(frame(spark, texts), Scratch(spark, "t")).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in got] == expected
    assert got[9].n_a == 0 and got[9].groups_sha256 == ""  # a mark character is not given back
    found = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.token_groups(frame(spark, texts)).collect()}
    assert [found[i * 3 + 1] for i in range(len(texts))] == groups
    assert alignment.aligned_counts(frame(spark, texts).limit(0), Scratch(spark, "t")).count() == 0
    assert alignment.aligned_counts(frame(spark, [None, "", "▁"]), Scratch(spark, "t")).where("n_a + n_links + count_sum = 0").count() == 3


def test_pieces_of_a_model_that_joins_words_are_its_own():
    _, vb = alignment.vocabularies(alignment.TOKENIZER, alignment.RANKS, alignment.MODEL)
    texts = [t or "" for t in ODD] + random_texts(300, "ab  \n▁é日.'\tst<>", 40)
    expected = [vb.tokenizer.model.encode(t) for t in texts]
    for split in (True, False):
        vb.tokenizer.splits = split
        ids, at = vb.tokenizer.encode(pa.array(texts, pa.large_string()))
        got = [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
        same = [i for i, t in enumerate(texts) if "▁" not in t or not split]  # with a mark inside, only the library's bytes matter: they differ from the text
        assert [got[i] for i in same] == [expected[i] for i in same]
    vb.tokenizer.splits = True


def test_a_batch_of_long_texts_is_aligned_a_few_at_a_time():
    """What a task holds does not grow with its batch."""
    texts = random_texts(800, "abcdefghijklmno    ", 12_000)
    batch = pa.record_batch([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], names=["row", "doc_id", "text"])
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        rows = [sum(r["n_a"] is not None for r in b.select(["n_a"]).to_pylist()) for b in alignment._counted(alignment.TOKENIZER, alignment.MODEL)([batch])]
    finally:
        pa.set_memory_pool(before)
    assert sum(rows) == 800 and batch.nbytes > 4_000_000
    assert pool.max_memory() < 64 << 20


# ---------------------------------------------------------------- fingerprints


def prints(texts):
    return fingerprints.Prints.of(fingerprints.parts(pa.array(texts, pa.large_string())), len(texts))


def test_fingerprints_are_sums_of_paragraphs():
    a, b = "first line, long enough that it is cut into several pieces by its bytes", "second\tline é"
    p = prints([f"{a}\n{b}", f"{b}\n\n{a}\n", a, b, "", f"{a}\n{b}x", f"{a}\n{a}\n{b}"])
    s = p.strings()
    assert s[0] == s[1] and len(set(s)) == 6
    assert (p.wide[0] == p.wide[2] + p.wide[3]).all() and (p.lanes[0] == p.lanes[2] + p.lanes[3]).all()
    again = fingerprints.Prints.read(s)
    assert (again.wide == p.wide).all() and (again.lanes == p.lanes).all()
    like = fingerprints.likeness(p, prints([f"{a}\n{b}"] * 7))
    assert like[0] == like[1] == 1 and 0 < like[2] < 1 and like[4] == 0 and like[6] > 0.7


def test_edits_update_fingerprints_exactly():
    texts = [t or "" for t in ODD] + random_texts(80, "abcd \n", 400)
    after = texts[1:] + texts[:1]
    known = fingerprints.parts(pa.array(texts, pa.large_string()))
    edited = fingerprints.Prints.of(known, len(texts)).edited(known, fingerprints.parts(pa.array(after, pa.large_string())))
    assert edited.strings() == prints(after).strings()


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_edited_fingerprints_against_plain_python(spark, partitions):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(900)]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(100, 400))) for _ in range(12)]
    texts += [texts[-1]]
    docs = frame(spark, texts)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[i - 1]  # the next smaller doc_id; after the smallest the largest
        edit = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i * 3 + 1]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == prints([t, edit]).strings()
        assert (r.near_edited == 1) >= (t == edit) and (r.near_next == 1) >= (t == after)
        if len(ODD) < i < len(texts) - 1:
            assert 0.3 < r.near_edited < 0.7 and r.near_next < 0.3
    assert got[(len(texts) - 1) * 3 + 1].near_next == 1


def test_edges_of_edited_fingerprints(spark):
    run = lambda df: fingerprints.edited_fingerprints(df, Scratch(spark, "t")).collect()
    assert run(frame(spark, ODD).limit(0)) == []
    one = run(frame(spark, ["only"]))
    assert one[0].edited_sha256 == hashlib.sha256(b"onon").hexdigest() and one[0].near_next == 1
    # repeated ids and rows, null ids: each row once, whatever the partitions
    rows = [(1, "same text")] * 30 + [(1, "other"), (None, "null id"), (None, None), (2, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda df: sorted((r.doc_id is None, r.doc_id, r.edited_sha256, r.near_next) for r in run(df))
    assert len(digest(docs)) == len(rows) and digest(docs) == digest(docs.repartition(5))


def test_groups_of_fingerprints(spark):
    texts = [t for t in ODD if t] * 2
    got = fingerprints.merged(fingerprints.fingerprints(frame(spark, texts)).selectExpr("doc_id % 2 AS side", "fingerprint"), ["side"]).collect()
    expected = {side: prints(["\n".join(t for i, t in enumerate(texts) if (i * 3 + 1) % 2 == side)]).strings()[0] for side in (0, 1)}
    assert {r.side: r.fingerprint for r in got} == expected
    assert fingerprints.merged(fingerprints.fingerprints(frame(spark, texts)), []).collect()[0].fingerprint == prints(["\n".join(texts)]).strings()[0]


# ---------------------------------------------------------------- fill-in-middle


def formatted_by_hand(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [fim.BLOCK, 5])
def test_scattered_bytes_against_slices(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(2)
    for _ in range(60):
        texts = [t for t in random_texts(rng.randint(1, 12), "ab<é日😀P>S", 30, rng.random()) if not any(m in t for m in ("<P>", "<S>", "<M>"))]
        forms = np.array([rng.randint(0, 2) for _ in texts], np.int64)
        cuts = [sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))) if f else (0, 0) for t, f in zip(texts, forms)]
        a, m = (np.array(c, np.int64) for c in ([x for x, _ in cuts], [y - x for x, y in cuts]))
        out = fim.scatter(pa.array(texts, pa.large_string()), forms, a, m)
        parts = [(t[:x], t[x:y], t[y:]) for t, (x, y) in zip(texts, cuts)]
        assert out.to_pylist() == [t if not f else f"<P>{p}<S>{s}<M>{m}" if f == 1 else f"<S>{s}<P>{p}<M>{m}" for t, f, (p, m, s) in zip(texts, forms, parts)]
        assert fim.gather(out, forms).to_pylist() == texts


def test_formatted_rows(spark):
    texts = ODD + random_texts(80, "ab <é日😀P>S", 30) + ["long é" * 60_000]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "no id")] * 2, "doc_id long, text string"), allowMissingColumns=True)
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    ids = [i * 3 + 1 for i in range(len(texts))] + [None] * 2
    whole = texts + ["no id"] * 2
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == \
        sorted(((i, *formatted_by_hand(i, t)) for i, t in zip(ids, whole)), key=key)
    assert {(r.doc_id, r.restored) for r in got} == {(i, t or "") for i, t in zip(ids, whole)}
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_restore_refuses_what_it_cannot_read(spark):
    for output, form in (("no marks", "psm"), ("<P>a<S>b<S>c<M>", "psm"), ("x", "other"), (None, "plain")):
        with pytest.raises(Exception, match="must"):
            fim.restore(spark.createDataFrame([(output, form)], "output string, form string")).collect()


def test_op13_and_its_sql(spark):
    same, why = compare(fim.op13(spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), fim.ORACLE)
    assert same, why
