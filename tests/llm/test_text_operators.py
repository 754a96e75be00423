"""Operators on single texts, against libraries or plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cubewise.llm import chat, language_id, licenses, packing, quality, textkit, token_counts
from cubewise.llm.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, texts, extra=True):
    """Repeated rows, and a column whose name clashes with results."""
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")


ODD = ["", None, " ", "a", "  a  b ", "don't we'll 's x''s\n\n  b", "日本 語 é", "x <|endoftext|> </s> y", "a▁b", "a\x00b", "same", "same"]


def test_word_hashes_agree_only_for_equal_words():
    texts = pa.array(["Ab cd", None, "cd ef", "x" * 3000 + " ab"])
    raw, off = textkit.buffers(texts)
    starts, ends, at = textkit.word_spans(raw, off, textkit.SPACE)
    h = textkit.word_hashes(textkit.LOWER[raw], starts, ends)
    assert at.tolist() == [0, 2, 2, 4, 6]
    assert h[1] == h[2] and h[0] == h[5] and len(set(h.tolist())) == 4


def test_tokens_are_those_of_the_library():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab  \n▁é日.'\tst<>") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    counter = token_counts.PieceCounter(token_counts.tokenizer_path(token_counts.MODEL))
    assert counter.count(pa.array(texts)).tolist() == [len(counter.model.encode(t or "")) for t in texts]
    tokens = packing._tokens(packing.TOKENIZER, packing.RANKS)
    ids, at = tokens.encode(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == tokens.library.encode(t or "", add_special_tokens=False).ids


def test_token_counts_of_rows(spark):
    got = token_counts.token_counts(frame(spark, ODD), limit=1).collect()
    assert len(got) == len(ODD) and got[0].n_tokens == 0 and not got[0].over_limit and got[5].over_limit
    assert token_counts.token_counts(frame(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[1024], [700, 324, 600, 424], [400, 400, 400, 300, 300, 300] * 20, list(range(1, 200)), []])
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, int)
    plan = packing.pack(counts)
    used = np.zeros(1025, int)
    for p in plan:
        assert sum(p.lengths) <= 1024
        for n in p.lengths:
            used[n] += p.bins
    assert (used == counts).all()
    assert sum(p.bins for p in plan) >= packing.least_bins(counts, 1024)


def test_packing_goes_back_to_other_fillings():
    rng, lengths = random.Random(50), []
    while len(lengths) < 60:
        a, b = rng.randint(20, 49), rng.randint(20, 49)
        if 20 <= 100 - a - b:
            lengths += [a, b, 100 - a - b]
    counts = np.bincount(lengths, minlength=101)
    assert sum(p.bins for p in packing.pack(counts, 100)) < sum(p.bins for p in packing.pack(counts, 100, steps=0))
    assert sum(p.bins for p in packing.pack(counts, 100)) == 21


def test_packed_sequences_have_no_gaps(spark):
    texts = ODD + ["word " * n for n in (10, 500, 1023, 3000)]
    rows = packing.pack_documents(frame(spark, texts), Scratch(spark, "t")).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert packing.pack_documents(frame(spark, texts).limit(0), Scratch(spark, "t")).count() == 0


def test_licences_against_plain_search(spark):
    texts = ODD + ["CC-BY 4.0 and all RIGHTS reserved, all rights reserved", "the GNU General Public License", "Licensed under CC BY-NC 4.0.",
                   "Released under the MIT License.", "rights all reserved"]
    got = licenses.license_scan(frame(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        w = words(text)
        found = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
    assert got[-2].labels == "mit" and got[-3].labels == "cc-by,cc-by-nc" and got[-2].score == 1.0


def test_licences_with_any_word_altered(spark):
    full = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    texts, keys = [], (*range(0, 4), *range(4, 7))
    for k in range(len(full)):
        texts.append(" ".join(["see", *full[:k], "zzz", *full[k + 1:]]))
    got = licenses.license_scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["" if k in keys else "mit" for k in range(len(full))]
    assert [(p.label, p.start) for r in got for p in r.places] == [("mit", 1)] * (len(full) - len(keys))
    # half the agreement of a template without its key phrases
    assert all(abs(r.score - (0.5 if k in keys else 1) * 15 / 16) < 1e-9 for k, r in enumerate(got))


def test_chats_read_back(spark):
    rows = [(1, 2, "user", "a<|end|>\n[b]\\"), (1, 1, "user", None), (1, 3, "assistant", "</s>[INST]"), (1, 4, "assistant", "x"),
            (2, 1, "assistant", ""), (None, 1, None, "t"), (3, 1, "user\n<|text|>", "é\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learnt = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(learnt) and r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(w) for _ in range(30)), lang) for i in range(60)
            for lang, w in (("en", ["the", "house", "with", "thing"]), ("de", ["das", "schön", "über", "nicht"]))]
    rows += [(1000, None, "en"), (1001, "12 !", "en"), (1002, "the thing with", None)]
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (1000, "und") in got and (1001, "und") in got and (1002, "en") in got
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty).count() == 0


def test_quality_rules_learn_a_limit(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(20)) + (" !!" * 30 if i % 2 else "."), "z") for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, "z"), (901, "", "z")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(400)] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id < 400)
    none = quality.quality_scores(docs, labels.limit(0), Scratch(spark, "t")).collect()
    assert {r.score for r in none} == {0.5}
