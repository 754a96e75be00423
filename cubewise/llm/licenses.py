"""Licence scans with a positional index of rare words.

Templates and key phrases are short word lists. Of a phrase, the word that the
fewest documents hold (the highest inverse document frequency, counted over
all documents) is its anchor; of a template, its rarest words are, one more
than may be missing. A file is searched only at the places of anchor words: the template postings of an anchor, shifted by its place in the
template, give the starts to compare word by word. A phrase must stand there
whole; a template must agree in ``COVER`` of its words, and its mandatory key
phrases must have been found whole in the file.

Every place of a phrase holds its anchor, and every place of a template one of
its anchors where it should be, so no place is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table
from .words import word_array

#: Share of a template's words that must stand in their places.
COVER = 0.8

# The base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# First words of public licence notices, each with its label and mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]


@dataclass(frozen=True)
class Entry:
    """Words to find in place; ``label`` of a base phrase or template."""

    words: tuple[str, ...]
    label: str
    base: bool
    needs: tuple[int, ...]


def entries(base: dict[str, str] = BASE, templates=TEMPLATES) -> list[Entry]:
    """Phrases first (base and mandatory ones), then templates."""
    phrases = list(dict.fromkeys([*base, *(p for _, _, keys in templates for p in keys)]))
    out = [Entry(tuple(p.split()), base.get(p, ""), p in base, ()) for p in phrases]
    return out + [Entry(tuple(t.split()), label, False, tuple(phrases.index(k) for k in keys)) for label, t, keys in templates]


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each licence word, over all ``docs(text)``: at most
    one row for each word of the templates reaches the driver."""
    held = F.array_intersect(word_array(F.col("text")), F.lit(vocabulary))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``n_words``,
    ``n_base`` (all places of base phrases), ``first_word`` and ``last_word``
    (their smallest and largest start; null without any), ``base_labels``,
    ``labels`` (base ones and those of the templates; distinct, sorted, comma
    joined), ``score`` (0 to 1: the best agreement of a found phrase or
    template, half of it where key phrases are missing) and ``places`` (label,
    start and agreement of every find).

    A null or empty text has no words and no finds. Repeated rows are scanned
    each; other columns are ignored; an empty table gives no rows.
    """
    table = entries(base, templates)
    vocabulary = sorted({w for e in table for w in e.words})
    found_in = document_frequencies(docs, vocabulary)
    anchors: dict[str, list[tuple[int, int]]] = {}
    for i, e in enumerate(table):
        size = len(e.words)
        missing = max(k for k in range(size) if (size - k) / size >= COVER) if e.needs else 0
        for w, at in sorted(((w, at) for at, w in enumerate(e.words)), key=lambda p: (found_in[p[0]], p))[:missing + 1]:
            anchors.setdefault(w, []).append((i, at))

    postings = F.create_map(*[x for w, ps in anchors.items() for x in (
        F.lit(w), F.array(*[F.struct(F.lit(i).alias("entry"), F.lit(at).alias("at")) for i, at in ps]))])
    expected = F.array(*[F.lit(list(e.words)) for e in table])
    labels = F.lit([e.label for e in table])
    is_base = F.lit([e.base for e in table])
    needs = F.array(*[F.lit(list(e.needs)) if e.needs else F.array().cast("array<int>") for e in table])
    phrases = sum(not e.needs for e in table)

    words = F.col("words")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda h: h["word"].isin(list(anchors)))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(
        F.element_at(postings, h["word"]), lambda p: F.struct(p["entry"].alias("entry"), (h["i"] - p["at"]).alias("start"))))))
    agree = F.transform("starts", lambda s: F.struct(
        s["entry"].alias("entry"), s["start"].alias("start"),
        F.aggregate(F.transform(F.get(expected, s["entry"]), lambda w, k: F.when((s["start"] + k >= 0) & (F.get(words, s["start"] + k) == w), 1).otherwise(0)),
                    F.lit(0), lambda a, b: a + b).alias("same"), F.size(F.get(expected, s["entry"])).alias("size")))
    finds = F.filter(F.transform(agree, lambda a: F.struct(
        a["entry"].alias("entry"), a["start"].cast("long").alias("start"), (a["same"] / a["size"]).alias("agreement"))),
        lambda a: F.when(a["entry"] < phrases, a["agreement"] == 1).otherwise(a["agreement"] >= COVER))
    none = F.array().cast("array<struct<entry:int,start:int>>")
    held = docs.select("doc_id", word_array(F.col("text")).alias("words")) \
        .select("doc_id", "words", F.when(F.arrays_overlap(words, F.lit(list(anchors))), starts).otherwise(none).alias("starts")) \
        .select("doc_id", F.size("words").cast("long").alias("n_words"), finds.alias("finds"))
    whole = F.transform(F.filter("finds", lambda f: f["entry"] < phrases), lambda f: f["entry"])
    held = held.withColumn("whole", F.array_distinct(whole)) \
        .withColumn("base", F.filter("finds", lambda f: F.get(is_base, f["entry"]))) \
        .withColumn("sure", F.filter("finds", lambda f: (F.get(labels, f["entry"]) != "") & (F.size(F.array_except(F.get(needs, f["entry"]), F.col("whole"))) == 0))) \
        .withColumn("unsure", F.filter("finds", lambda f: (F.get(labels, f["entry"]) != "") & (F.size(F.array_except(F.get(needs, f["entry"]), F.col("whole"))) > 0)))

    def joined(of: str):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda f: F.get(labels, f["entry"])))), ",")

    def best(of: str):
        return F.coalesce(F.array_max(F.transform(of, lambda f: f["agreement"])), F.lit(0.0))

    places = F.transform("sure", lambda f: F.struct(F.get(labels, f["entry"]).alias("label"), f["start"].alias("start"), f["agreement"].alias("agreement")))
    return held.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda f: f["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda f: f["start"])).alias("last_word"),
        joined("base").alias("base_labels"), joined("sure").alias("labels"),
        F.greatest(best("sure"), best("unsure") / 2).alias("score"), places.alias("places"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan of all documents."""
    return license_scan(read_table(spark, sf_dir, "documents")).drop("places")
