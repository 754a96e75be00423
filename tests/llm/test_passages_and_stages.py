"""Passages at the edge of similarity, repetitive texts, and stages on tables of any shape."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewise.llm import passages, stages
from cubewise.llm.scratch import Scratch


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def hashes(words):
    return np.array([hash(tuple(words[i:i + 5])) & (2**63 - 1) for i in range(len(words) - 4)], np.uint64)


@pytest.mark.parametrize("lost", [(0, 5), (5, 0), (2, 3)])
def test_stretches_are_widened_by_unequal_shingles(lost):
    """42 equal shingles in passages of 47: similarity 42 / 52."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 2**60, 47).astype(np.uint64), rng.integers(1, 2**60, 47).astype(np.uint64)
    y[lost[0]:47 - lost[1]] = x[lost[0]:47 - lost[1]]
    start, n, source, similarity = passages._stretch(x, y, 20, 20)
    assert (start, n, source) == (0, 47, 0) and similarity == pytest.approx(42 / 52)
    y[20 - 15] += 1  # one more is unequal
    assert passages._stretch(x, y, 20, 20) is None
    # there is no room to widen them in a shorter text
    assert passages._stretch(x[:46], y[:46], 20, 20) is None


def test_seeds_on_one_way_give_what_each_gives_alone():
    rng = random.Random(4)
    words = vocabulary(rng)
    for case in range(30):
        a = [rng.choice(words) for _ in range(rng.randint(80, 300))]
        b = list(a)
        for _ in range(rng.randint(1, 12)):
            i = rng.randrange(len(b))
            b[i:i + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        x, y = hashes(a), hashes(b)
        paths = passages._Paths(x, y)
        where = {int(v): i for i, v in enumerate(x)}
        seeds = [(where[int(v)], j) for j, v in enumerate(y) if int(v) in where]
        for cx, cy in rng.sample(seeds, min(12, len(seeds))):
            alone, shared = passages._stretch(x, y, cx, cy), paths.stretch(cx, cy)
            assert (alone is None) == (shared is None)
            if alone:
                assert shared[1] >= passages.SHINGLES and shared[3] >= 0.8 and shared[0] <= cy < shared[0] + shared[1]


def windows_by_hand(h, width):
    """Of each run of equal values: its first and last place and every ``width``-th, and how far values are no smaller (equal ones before end it)."""
    out, a = set(), 0
    while a < len(h):
        b = a
        while b + 1 < len(h) and h[b + 1] == h[a]:
            b += 1
        low, high = a, b
        while low and h[low - 1] > h[a]:
            low -= 1
        while high + 1 < len(h) and h[high + 1] >= h[a]:
            high += 1
        if high - low + 1 >= width:
            out |= {(p, min(p - low, passages.FAR), min(high - p, passages.FAR), p == b > a) for p in {a, b, *range(a, b, width)}}
        a = b + 1
    return out


@pytest.mark.parametrize("width", [5, passages.SHINGLES])
def test_windows_of_runs(width):
    rng = np.random.default_rng(width)
    for most in (1, 3, 120):
        texts = [np.repeat(rng.integers(1, k, 300), rng.integers(1, most + 1, 300))[:n] for k in (2, 6, 10**6) for n in (0, width - 1, width, 300)]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        h = passages.K.mix(np.concatenate(texts).astype(np.uint64))
        text, place, left, right, last = passages.window_centres(h, at, passages._intervals(at, width), width)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            own = text == i
            got = list(zip((place[own] - a).tolist(), np.minimum(left, passages.FAR)[own].tolist(), np.minimum(right, passages.FAR)[own].tolist(), last[own].tolist()))
            assert len(set(got)) == len(got) and set(got) == windows_by_hand(h[a:b].tolist(), width)


def test_repeated_words_make_few_windows():
    """A word said again and again is one minimum: all its places were windows."""
    rng = random.Random(12)
    words = vocabulary(rng)
    texts = {"one": ["the"] * 20_000, "lines": [w for _ in range(1000) for w in [rng.choice(words[:5])] * 20], "none": [rng.choice(words) for _ in range(20_000)]}
    for name, most in (("one", 10_000), ("lines", 20_000), ("none", 10_000)):  # of 160,000 shingles hashed (kind 0 counts twice)
        batch = passages.pa.record_batch([passages.pa.array([1]), passages.pa.array([" ".join(texts[name])])], names=["doc_id", "text"])
        assert sum(b.num_rows for b in passages._windows([batch])) <= most, name


@pytest.mark.parametrize("large", [False, True])
def test_exact_repeats_among_runs_of_words(spark, monkeypatch, large):
    """All passages of 51 words that an earlier text holds are found, in texts of words said 1 to 70 times."""
    if large:  # as with many keys
        for bound in ("HASHED", "KEYS"):
            monkeypatch.setattr(passages, bound, 0)
    rng = random.Random(11)
    words = vocabulary(rng, 12)
    runs = lambda n: [w for _ in range(n) for w in [rng.choice(words)] * rng.choice([1, 2, 5, 20, 60, 70])]
    shared = [runs(8) for _ in range(6)]
    texts = []
    for _ in range(30):
        own = rng.choice(shared)
        a = rng.randrange(len(own))
        texts.append(runs(3) + own[a:a + rng.randint(51, 150)] + runs(3))
    rows = passages.repeated_passages(frame(spark, [" ".join(t) for t in texts]), Scratch(spark, "t")).collect()
    covered = {}
    for r in rows:
        assert r.source_id < r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    before = set()
    for i, t in enumerate(texts):
        parts = [tuple(t[a:a + 51]) for a in range(len(t) - 50)]
        missed = {k for a, p in enumerate(parts) if p in before for k in range(a, a + 51)} - covered.get(i, set())
        assert not missed, i
        before.update(parts)


def similar_by_hand(texts):
    """Words of later texts that lie in a window of 51 words or up to 60 with an
    equally long window of an earlier text, 0.8 similar."""
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        for n in (51, 55, 60):
            for a in range(len(w) - n + 1):
                sets.setdefault((i, n), []).append((a, {tuple(w[k:k + 5]) for k in range(a, a + n - 4)}))
    return sets


def test_similar_passages_without_their_leader(spark):
    """B and C share a passage with one word changed; A, with a smaller id,
    holds only its minimum shingles in other surroundings."""
    rng = random.Random(8)
    words = vocabulary(rng)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    found = 0
    cases = 12
    docs = []
    for _ in range(cases):
        shared = text(60)
        changed = list(shared)
        changed[30] = "other"
        decoys = [text(3) + shared[k:k + 9] + text(30) for k in range(0, 52, 4)]  # every shingle stands in a smaller document
        docs += [" ".join(d) for d in decoys] + [" ".join(text(40) + shared + text(40)), " ".join(text(25) + changed + text(60))]
    rows = passages.repeated_passages(frame(spark, docs), Scratch(spark, "t")).collect()
    size = len(docs) // cases
    for c in range(cases):
        last = (c + 1) * size - 1
        covered = set()
        for r in rows:
            if r.doc_id == last and r.source_id == last - 1:
                covered |= set(range(r.start_word, r.start_word + r.n_words))
        found += len(covered & set(range(25, 85))) >= 55
    assert found == cases
    assert not [r for r in rows if r.doc_id % size != size - 1]


def test_repetitive_texts(spark):
    """Texts of one word, of one line again and again, and of lines in another
    order: exact repeats are found, what is no repeat is left alone."""
    rng = random.Random(3)
    words = vocabulary(rng)
    line = [rng.choice(words) for _ in range(12)]
    lines = [[rng.choice(words) for _ in range(20)] for _ in range(8)]
    order = lambda *k: list(itertools.chain(*(lines[i] for i in k)))
    texts = [["the"] * 500, ["the"] * 300, line * 30, line * 7, line * 4, order(0, 1, 2, 3, 4, 5, 6, 7), order(7, 6, 5, 4, 3, 2, 1, 0), order(4, 5, 6)]
    rows = passages.repeated_passages(frame(spark, [" ".join(t) for t in texts]), Scratch(spark, "t")).collect()
    covered = {}
    for r in rows:
        assert r.source_id < r.doc_id and r.n_words >= 51
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert covered[1] == set(range(300)) and covered[3] == set(range(84)) and covered[7] == set(range(60))
    assert 4 not in covered and 6 not in covered  # 48 words; lines of 20 words in another order


CLASHES = "cuts string, cut_id long, row string, keep boolean, leader long, place long, open boolean, key long, content long, tags map<string,string>, n_chars long"


def clashing(spark, texts):
    rows = [(i, t, "c", 1, "r", True, 2, 3, False, 4, 5, {"a": "b"}, len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASHES)


def test_cutting_keeps_columns_of_any_name_and_type(spark):
    rng = random.Random(6)
    words = vocabulary(rng)
    shared = " ".join(rng.choice(words) for _ in range(70))
    docs = clashing(spark, [(1, f"first {shared} end"), (2, f"second {shared} last"), (3, None), (4, ""), (None, shared), (2, f"second {shared} last")])
    out = stages.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns and out.schema["tags"].dataType == docs.schema["tags"].dataType
    got = sorted(((r.doc_id or 0, r.text, r.n_chars, r.tags, r.cuts, r.cut_id) for r in out.collect()), key=str)
    assert got == sorted([(1, f"first {shared} end", len(shared) + 10, {"a": "b"}, "c", 1), (2, "second last", 11, {"a": "b"}, "c", 1), (2, "second last", 11, {"a": "b"}, "c", 1),
                          (3, None, 0, {"a": "b"}, "c", 1), (4, "", 0, {"a": "b"}, "c", 1), (0, shared, len(shared), {"a": "b"}, "c", 1)], key=str)
    assert stages.repeated_passages(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_keep_one_of_repeated_rows_with_maps(spark):
    line = "one two three four five six seven eight nine ten"
    docs = clashing(spark, [(1, line), (1, line), (2, line + " x"), (2, None), (5, None), (5, None), (None, line), (None, line), (3, ""), (3, "")])
    out = stages.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # rows of a doc_id stay or go together: 2 is a near-duplicate of 1
    assert got == sorted([(1, line), (5, None), (5, None), (None, line), (3, ""), (3, "")], key=str)
    assert stages.near_duplicates(spark, docs.limit(0), "").count() == 0


@pytest.fixture
def small_tables(tmp_path, spark):
    rng = random.Random(2)
    words = vocabulary(rng)
    item = " ".join(rng.choice(words) for _ in range(30))
    spark.createDataFrame([("i1", item), ("i2", None), (None, "a b c")], "item_id string, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), item, words


def test_benchmark_stage_on_odd_rows(spark, small_tables):
    folder, item, words = small_tables
    clean = " ".join(words[:40])
    docs = clashing(spark, [(1, f"x {item} y"), (1, clean), (2, clean), (2, clean), (3, None), (4, ""), (None, f"x {item} y")])
    out = stages.benchmark_passages(spark, docs, folder)
    assert out.columns == docs.columns
    # rows that share a doc_id go together, a row without an id stays
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, clean), (2, clean), (3, None), (4, ""), (None, f"x {item} y")], key=str)
    assert stages.benchmark_passages(spark, docs.limit(0), folder).count() == 0


def test_quality_stage_on_odd_rows(spark, small_tables):
    folder, _, words = small_tables
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(words) for _ in range(60)).capitalize() + "."
    bad = lambda: "!!! " * 40
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    docs = clashing(spark, rows + [(None, bad()), (500, None), (1, rows[1][1])])
    out = stages.quality_filter(spark, docs, folder)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert {i for i in kept if i is not None and i < 200} == set(range(1, 200, 2)) and kept.count(1) == 2 and None in kept
    assert stages.quality_filter(spark, docs.limit(0), folder).count() == 0


def test_pack_stage_on_odd_rows(spark):
    docs = clashing(spark, [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x" * 5000)])
    out = stages.pack(spark, docs, "")
    rows = out.collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert (p == o + n) if s == t else p == 0
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert stages.pack(spark, docs.limit(0), "").count() == 0


def test_a_saved_table_lets_go_of_the_shuffles_behind_it(spark, monkeypatch):
    from cubewise.llm import scratch as S

    own, asked = S.Scratch(spark, "saved"), []
    monkeypatch.setattr(S, "tidy", asked.append)
    assert own.save(spark.range(3)).count() == 3 and asked == [spark]


def test_stages_leave_only_what_their_rows_are_read_from(spark, small_tables, monkeypatch):
    """Tables of an operator are gone when its stage returns; the disk is the next one's."""
    from cubewise.llm import scratch as S

    folder, item, words = small_tables
    rng, saved, save = random.Random(9), [], S.Scratch.save
    text = lambda: " ".join(rng.choice(words) for _ in range(70))
    same = text()
    docs = spark.createDataFrame([(1, f"{same} {text()}"), (2, f"{text()} {same}"), (3, same), (4, same), (5, f"{text()} {item}"), (6, text())], "doc_id long, text string")

    def recorded(self, df):
        out = save(self, df)
        saved.append((out._scratch_path, set(out.columns)))
        return out

    monkeypatch.setattr(S.Scratch, "save", recorded)
    for stage, ids in ((stages.near_duplicates, {1, 2, 3, 5, 6}), (stages.repeated_passages, {1, 2, 3, 4, 5, 6}), (stages.benchmark_passages, {1, 2, 3, 4, 6})):
        saved.clear()
        out = stage(spark, docs, folder)
        left = [columns for path, columns in saved if os.path.exists(path.removeprefix("file:"))]
        assert left and all(c in ({"doc_id"}, {"k", "d"}, {"doc_id", "start_word", "n_words"}) for c in left), left
        assert {r.doc_id for r in out.collect()} == ids


def packed(windows, buckets, at=None):
    """Rows of buckets of windows (key, doc_id, place, kind), sorted by bucket as Spark gives them."""
    held = [tuple(np.array(c, t) for c, t in zip(zip(*windows[i:i + 50]), (np.int64, np.int64, np.int64, np.int8))) for i in range(0, len(windows), 50)]
    rows = passages.pa.Table.from_batches([passages._packed([h], buckets) for h in held]).sort_by("bucket")
    return rows.to_batches(max_chunksize=7)


@pytest.mark.parametrize("held", [500_000, 20])
def test_windows_meet_in_buckets(held, monkeypatch):
    monkeypatch.setattr(passages, "HELD", held)
    monkeypatch.setattr(passages, "SPOOLED", 24 * held)
    r = random.Random(held)
    keys = [r.getrandbits(63) - (1 << 62) for _ in range(60)]
    windows = [(k, r.randrange(-3, 40), r.randrange(1 << 40), r.randrange(7) + passages.LAST * (r.random() < 0.3)) for k in keys + keys[:30] * 5 + keys[:1] * 200]
    groups = {k: [w for w in windows if w[0] == k] for k in keys}
    expected = []
    for k, own in groups.items():
        leader = min(w[1] for w in own)
        if leader == max(w[1] for w in own):
            continue
        px = [min((p for _, d, p, kind in own if d == leader and (kind >= passages.LAST) == last), default=None) for last in (False, True)]
        for _, d, p, kind in own:
            given = [x for x in px if x is not None] if d != leader else []
            expected += [(k, leader, len(own), d, p, kind % passages.LAST, x, n > 0) for n, x in enumerate(given or [None])]
    got = [tuple(row.values()) for b in passages._shared(packed(windows, 3)) for row in b.to_pylist()]
    order = lambda row: tuple((x is not None, x or 0) for x in row)
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_bits_never_hide_shingles_in_common():
    r = np.random.default_rng(5)
    windows = [r.integers(0, most, r.integers(47, 190)).astype(np.uint32) for most in [3, 60, 200, 1 << 32] * 10]
    windows += [np.concatenate((w[:40], w[20:])) for w in windows]
    at = np.concatenate(([0], np.cumsum([len(w) for w in windows])))
    sets, none = passages._marks(np.concatenate(windows), at)
    for i, j in itertools.combinations(range(len(windows)), 2):
        x, y = (dict(zip(*np.unique(windows[k], return_counts=True))) for k in (i, j))
        common = sum(min(n, y.get(v, 0)) for v, n in x.items())
        assert common <= int(np.bitwise_count(sets[i] & sets[j]).sum()) + min(none[i], none[j])


def test_open_places_meet_in_buckets_and_in_blocks(spark, monkeypatch):
    """Copies of a passage with a word changed, of different texts, in two groups, by both ways."""
    r = random.Random(11)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(200)]
    texts, members = [], []
    for d in range(40):
        own = list(base)
        own[r.choice([60, 75, 140])] = f"x{d % 17}"
        own[:40] = [f"y{d}z{n}" for n in range(40)]
        texts.append(" ".join(own))
        members.append([{"key": 7 + d % 2 * (1 << 40), "place": passages._place(100, 60, 60), "open": d % 3 > 0}])
    kind = passages.pa.list_(passages.pa.struct([("key", passages.pa.int64()), ("place", passages.pa.int64()), ("open", passages.pa.bool_())]))
    batch = passages.pa.record_batch([passages.pa.array(range(40), passages.pa.int64()), passages.pa.array(members, kind), passages.pa.array(texts)], names=["doc_id", "members", "text"])
    around = passages.pa.Table.from_batches(passages._surroundings([batch]), passages.AROUND)
    rows = passages.pa.Table.from_batches(passages._packed_surroundings(4)([batch])).sort_by("bucket")
    near = [row for b in passages._near(rows.to_batches(max_chunksize=1)) for row in b.to_pylist()]
    found = {(row["leader"], row["doc_id"], row["x"], row["place"]) for row in near}
    assert len(found) == len(near) and all(row["key"] is None for row in near)
    # each open place but those without an earlier one in its group
    assert {d for _, d, _, _ in found} == {d for d in range(2, 40) if d % 3} and all((d - lead) % 2 == 0 and lead < d and x == y == 100 for lead, d, x, y in found)
    schema = "key long, doc_id long, place long, centre int, open boolean, content long, around binary"
    blocks = passages._in_large_groups(spark.createDataFrame([tuple(row.values()) for row in around.to_pylist()], schema), Scratch(spark, "t"))
    assert {tuple(row) for row in blocks.collect()} == found
    # groups that are too large, and buckets that are, are passed on whole
    for name in ("BLOCK", "SPOOLED"):
        with monkeypatch.context() as m:
            m.setattr(passages, name, 3)
            passed = passages.pa.Table.from_batches([b for b in passages._near(rows.to_batches())]).drop_columns(["leader", "x"])
        for_order = [("doc_id", "ascending")]
        assert passed.sort_by(for_order).to_pylist() == around.sort_by(for_order).to_pylist()


def test_equal_texts_are_searched_once(spark, monkeypatch):
    r = random.Random(3)
    new = lambda n: [f"w{r.randrange(10 ** 6)}" for _ in range(n)]
    first, passage = new(80), new(60)
    copied = " ".join(new(30) + passage + new(30))
    docs = [(0, " ".join(first + passage)), (1, copied), (2, copied), (3, copied), (4, copied), (4, " ".join(first)), (5, " ".join(new(20))), (6, " ".join(new(20))), (3, copied)]
    docs += [(7, docs[6][1]), (8, ""), (9, ""), (None, copied), (10, None)]
    searched = []
    distinct_passages = passages._distinct_passages
    monkeypatch.setattr(passages, "_distinct_passages", lambda base, scratch: (searched.extend(base.collect()), distinct_passages(base, scratch))[1])
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t")).collect()
    # a document of two texts is searched with both
    assert sorted(row["doc_id"] for row in searched) == [0, 1, 4, 4, 5, 6, 8]
    rows = sorted((row["doc_id"], row["start_word"], row["n_words"], row["source_id"], row["source_word"], row["similarity"]) for row in rows if row["similarity"] == 1)
    for d in (2, 3):
        assert (d, 0, 120, 1, 0, 1.0) in rows
        assert [row[1:] for row in rows if row[0] == d and row[3] == 0] == [row[1:] for row in rows if row[0] == 1]
    assert (1, 30, 60, 0, 80, 1.0) in rows and any(row[0] == 4 and row[3] == 1 for row in rows) and any(row[0] == 4 and row[3] == 0 for row in rows)
    assert len(rows) == len(set(rows)) and not [row for row in rows if row[0] > 4]


def test_open_seeds_of_another_text_of_the_doc_id():
    """Open seeds are gathered by doc_id: a shorter text of it has none beyond its end."""
    text = " ".join(f"w{n}" for n in range(70))
    columns = [[text, text], [1, 2], [[531], [20, 531]], [None, None]]
    kinds = [passages.pa.string(), passages.pa.int64(), passages.pa.list_(passages.pa.int64()), passages.pa.list_(passages.pa.struct([("start_word", passages.pa.int64()), ("n_words", passages.pa.int64())]))]
    batch = passages.pa.record_batch([passages.pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "doc_id", "seeds", "known"])
    rows = [row for b in passages._all_runs([batch]) for row in b.to_pylist()]
    assert {row["doc_id"] for row in rows} == {2} and {row["start"] for row in rows} == set(range(20))
